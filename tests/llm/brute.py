"""Plain versions of the operators, for small inputs."""

import hashlib
import re

UPPER = {c: c + 32 for c in range(65, 91)}
BLANKED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = BLANKED.findall((text or "").translate(UPPER))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(rows):
    """{id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substring(rows, k=13):
    words = {i: BLANKED.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - k + 1):
            if least[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def decontaminate(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for item, text in items:
        w = word.findall((text or "").translate(UPPER))
        n = min(k, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w = word.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                of = grams.get(tuple(w[s : s + n]))
                if of:
                    hit.update(range(s, s + n))
                    found |= of
        out[i] = (len(w), len(hit), sorted(found))
    return out


KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def base_secrets(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(kind, start, stop) for start, _, stop, kind in sorted(found)]


def removed_lines(rows, k=3):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = [] if text is None else text.split("\n"), set()
        for s in range(len(lines) - k + 1):
            window = tuple(lines[s : s + k])
            if not "".join(window).strip():
                continue
            if window in seen:
                gone.update(range(s, s + k))
            seen.add(window)
        out[i] = sorted(gone)
    return out


def thue_morse(n=12):
    """Two complementary words over a and b, of 2^n characters: equal under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def mixture(rows, share, block):
    """{id: (source, slot, offset)}, slot by slot: the released block of the earliest deadline is next."""
    period = sum(share.values())
    queues = {}
    for i, source in sorted(rows):
        queues.setdefault(source if source in share else "*", []).append(i)
    done, out, slot = dict.fromkeys(share, 0), {}, 0
    while len(out) < len(rows):
        ready = [(-(-(done[s] + 1) * period // n), -n, s) for s, n in share.items() if done[s] * period // n <= slot]
        if ready:
            s = min(ready)[2]
            for offset, i in enumerate(queues.get(s, [])[done[s] * block : (done[s] + 1) * block]):
                out[i] = (s, slot, offset)
            done[s] += 1
        slot += 1
    return out
