"""Suffix deduplication, filter audit and clustering against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from srcgraph.llm import clustering, filter_audit, suffix_dedup
from srcgraph.llm._store import Scratch

from . import brute

SCHEMA = "doc_id long, text string, source string, bytes string, id long, ord int, lo long, print string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3, "y", 4) for i, t, s in rows], SCHEMA).repartition(3)


# Suffixes


def removed_bytes(rows, width=100):
    """{id: (bytes, removed, runs, kept)}"""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            string = data[s : s + width]
            if string in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(string)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, bytes(x for x, g in zip(data, gone) if not g))
    return out


def passages(seed=1, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(60)]
    bases = [" ".join(r.choice(vocab) for _ in range(r.randint(30, 150))) for _ in range(10)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    odd = [None, "", "a" * 300, "ab" * 200, "é" * 180, "x y z " * 50, "b" * 99, "b" * 100, "b" * 101]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3:
            words = r.choice(bases).split(" ")
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        elif kind < 0.5:
            text = "é" * r.randint(0, 50) + " ".join(r.choice(vocab) for _ in range(r.randint(0, 20))) + passage[r.randint(0, 60) :] + " ".join(r.choice(vocab) for _ in range(9))
        elif kind < 0.6:
            text = r.choice(odd)
        elif kind < 0.7:
            part = passage[r.randint(0, 20) : r.randint(110, 160)]
            text = part + " " + r.choice(vocab) + part + r.choice(vocab) * r.randint(0, 4) + part
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.randint(1, 120)))
        rows.append((i, text))
    rows.append((-3, "".join(r.choice("ab") for _ in range(2000))))
    rows.append((n + 1, "q" * 200 + rows[-1][1][900:1300]))
    return rows


def deduped(spark, rows):
    out = suffix_dedup.dedup_bytes(frame(spark, [(i, t, None) for i, t in rows]))
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    return out.collect()


@pytest.mark.parametrize("piece", [1 << 18, 700])
def test_suffixes(spark, monkeypatch, piece):
    """Small pieces cut long texts as a piece of 256 KB cuts very long ones."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = passages()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in deduped(spark, rows)}
    assert got == removed_bytes(rows)


def test_suffixes_of_very_long_texts(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, long[250_000:400_000]), (3, "x y z " * 60_000), (4, "head " + long[262_100:262_300] + " tail")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in deduped(spark, rows)}
    assert got == {1: (600_000, 0, 0), 2: (150_000, 150_000, 1), 3: (360_000, 360_000 - 6, 1), 4: (210, 200, 1)}


def test_suffixes_at_each_distance_from_an_edge(spark):
    """Shared strings of 95 to 130 bytes between different surroundings: those of 100 and more go, to the byte."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k, n in enumerate(range(95, 131)):
        shared = word(n)
        rows += [(2 * k, "A" + word(80) + "." + shared + ";" + word(80)), (2 * k + 1, word(30) + "," + shared + ":" + word(120))]
    got = {x.doc_id: x.n_removed for x in deduped(spark, rows)}
    assert got == {i: v[1] for i, v in removed_bytes(rows).items()}
    assert sum(v > 0 for v in got.values()) == 31


def test_suffixes_repeated_rows_and_null_identifiers(spark):
    a, b = "first text " * 3 + "".join(map(str, range(100))), "other text " * 3 + "".join(map(str, range(400, 480)))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (3, b), (3, a + b), (4, None), (None, None)]
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed) for x in deduped(spark, rows))
    n, m = len(a), len(b)
    assert got[:3] == [(-1, 0, 0), (-1, n, 0), (-1, n, 0)]
    assert got[3:6] == [(1, n, 0), (1, n, 0), (2, n, n)]
    # Of two texts of one identifier, that with the smaller hash comes first; the other loses what they share.
    assert sorted(x[1] for x in got[6:8]) == [m, n + m] and sum(x[2] for x in got[6:8]) == n + m
    assert got[8] == (4, 0, 0)


def test_suffixes_empty_table_and_hot_passage(spark, monkeypatch):
    assert deduped(spark, []) == []
    from srcgraph.llm import _hot

    monkeypatch.setattr(_hot, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(_hot, "HOT", 30)
    r = random.Random(2)
    notice = "all rights reserved, whoever copies this notice keeps it whole and unchanged, in every copy and in every part of it; "
    rows = [(i, " ".join(str(r.random()) for _ in range(6)) + (notice if i % 3 == 0 else "") + str(r.random())) for i in range(150)] + [(i, "same " * 40) for i in range(200, 260)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in deduped(spark, rows)}
    assert got == removed_bytes(rows)


# Filters

CHECKS = {
    "A": lambda t, w, first: len(w) < 50,
    "B": lambda t, w, first: 100 * len(set(w)) < 65 * len(w),
    "C": lambda t, w, first: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
    "D": lambda t, w, first: bool(re.search(r"[#$%&*|]", t)),
    "E": lambda t, w, first: not first,
}


def audited(rows, labels):
    quality, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, t, s in rows:
        text = t or ""
        words = brute.BLANKED.findall(text)
        facts.append((s or "", {f for f, c in CHECKS.items() if c(text, words, i is None or i <= least[text])}, i in quality, i in toxic))
    out, total = {}, {}
    for part in {x[0] for x in facts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in facts if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(x[0] == part and f in x[1] for x in facts) - len(gone)
                left = [x for x in left if f not in x[1]]
                alone = sum(x[0] == part and x[1] == {f} for x in facts)
                out[part, order, step] = (len(left), len(gone), redundant, alone, sum(x[2] for x in gone), sum(x[3] for x in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(seed=3, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(["one", "Two", "THREE", "x#", "four", "fünf", "six", "$7"] if r.random() < 0.1 else [f"w{k}" for k in range(r.choice([8, 90]))]) for _ in range(r.choice([5, 49, 50, 51, 120]))]
        rows.append((i, " ".join(words), r.choice(["a", "a", "b", "", None])))
    texts = [t for _, t, _ in rows]
    rows += [(n + k, r.choice(texts), "a") for k in range(30)] + [(500, None, "b"), (501, "", "b"), (502, "A" * 100_000, "c"), (502, "A" * 100_000, "c"), (None, texts[0], "a"), (503, "﻿ a\n" * 60, None)]
    return rows


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 140, 3)] + [(3, 1, None), (None, 1, 1), (9999, 1, 1), (502, None, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS part")
    out = filter_audit.audit_documents(frame(spark, [(i, t, s) for i, t, s in rows]), marked)
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.collect()}
    assert got == audited(rows, labels)
    assert len(got) == 4 * 600


def test_filter_audit_of_nothing(spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(frame(spark, []), no_labels).count() == 0
    rows = [(1, None, None)]
    got = filter_audit.audit_documents(frame(spark, rows), no_labels).collect()
    assert len(got) == 600 and {x.part for x in got} == {""} and sum(x.removed for x in got) == 120


def test_filter_audit_shares_states_and_gives_them_back(spark):
    """Other filters, with conditions that are null; each unordered prefix is counted once, and nothing stays persisted."""
    rows = spark.createDataFrame([("p", i, None if i % 5 == 0 else i % 3) for i in range(60)], "part string, x int, y int")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with Scratch(spark, "audit") as scratch:
        out = filter_audit.audit(rows, {"P": "x < 10", "Q": "y = 1", "R": "x > 50"}, {"odd": "x % 2 = 1"}, scratch).collect()
        assert sum("-state" in t for t in scratch.tables) == 7
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    got = {(x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.odd) for x in out}
    assert len(got) == 18
    for order in itertools.permutations("PQR"):
        left = [(i, None if i % 5 == 0 else i % 3) for i in range(60)]
        tests = {"P": lambda x, y: x < 10, "Q": lambda x, y: y == 1, "R": lambda x, y: x > 50}
        everything = left
        for step, f in enumerate(order, 1):
            gone = [v for v in left if tests[f](*v)]
            left = [v for v in left if not tests[f](*v)]
            assert got["".join(order), step] == (len(left), len(gone), sum(tests[f](*v) for v in everything) - len(gone), sum(v[0] % 2 for v in gone))


# Clusters


def clustered(rows, k=40, rounds=5, dimensions=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign() if centroids else []
    inertia = {j: sum(d for d, a in at if a == j) for _, j in at}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    key = lambda x: str(x)
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha(centroids[j])) for (i, _), (d, j) in zip(kept, at)), key=key)


def vectors(seed=1, n=300):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, 64))
    rows = [(int(i), [float(np.float32(x)) for x in middle[i % 12] + r.normal(scale=0.3, size=64)]) for i in range(n)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] * 64, [1.0] * 63 + [None], [float("inf")] + [0.0] * 63, [0.0] * 63 + [float("-inf")]]
    rows += [(1000 + k, v) for k, v in enumerate(bad)]
    return rows + [rows[5], rows[5], (7, rows[9][1]), (2000, rows[9][1]), (2001, [0.0] * 64), (2002, [-0.0] * 64), (None, rows[3][1]), (2003, [1e-9] * 32 + [-1e-9] * 32)]


def grouped(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int, norms string").repartition(4)
    out = clustering.cluster(df, **options)
    return sorted(((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in out.collect()), key=str), out


def test_clusters(spark):
    rows = vectors()
    got, out = grouped(spark, rows)
    assert got == clustered(rows)
    # Screening leaves out most distances on vectors that lie in groups.
    taken = out.agg({"exact": "sum"}).first()[0]
    assert taken < 0.8 * 40 * out.count()


def test_clusters_few_vectors_ties_and_none(spark):
    assert grouped(spark, [])[0] == []
    assert grouped(spark, [(1, None), (2, [1.0])])[0] == []
    rows = [(i, [float(i % 3)] * 64) for i in range(10)]
    assert grouped(spark, rows)[0] == clustered(rows)
    same = [(i, [1.5] * 64) for i in range(60)]
    got = grouped(spark, same)[0]
    assert {(x[1], x[2]) for x in got} == {(0, 0)} and got == clustered(same)


def test_clusters_refuse_what_has_no_exact_distance(spark):
    with pytest.raises(Exception, match="too large"):
        grouped(spark, [(1, [1e30] * 64)])


def test_screening_never_changes_the_nearest():
    r = np.random.default_rng(8)
    for scale in (3, 1000, 1 << 26):
        v, c = r.integers(-scale, scale + 1, (200, 64)), r.integers(-scale, scale + 1, (15, 64))
        c[7] = c[3]
        v[:15] = c
        at, best, taken = clustering.nearest(v, clustering.segment_norms(v), c)
        full = np.array([[int(((x.astype(object) - y.astype(object)) ** 2).sum()) for y in c] for x in v], dtype=object)
        assert best.tolist() == full.min(axis=1).tolist() and at.tolist() == [row.tolist().index(min(row)) for row in full]
        assert taken <= full.size
