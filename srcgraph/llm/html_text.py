"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs as many
characters as it has outside links: none where most of it is links or it stands
in page furniture, a quarter in blocks that are only perhaps furniture. In an
element that marks the article a line weighs all its characters and SURGE, links
or not, and beside it other lines weigh nothing, unless most prose of the page
stands there: then the mark was a teaser's. A form is furniture, but not one
that holds most prose of the page. Weights are summed over sliding windows of
three lines. The text lies between the first surge, where a window exceeds
SURGE, and the last dive, where the windows fall to nothing; stretches in which
they have fallen to nothing are passed over. So a short paragraph, a linked
heading and a list of references of an article stay, and outside a marked
article a run of links goes while one between paragraphs stays.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

WINDOW = 3
#: Characters in a window that begin the text.
SURGE = 80

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_BOILERPLATE = frozenset("head nav aside footer button select menu dialog label fieldset audio video canvas map".split())
#: Words of class names and identifiers: of furniture, of what may be furniture, and those that say nothing beside them.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs "
    "comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended "
    "newsletter subscribe subscription signup login search toolbar pagination pager copyright hidden".split()
)
_PERHAPS = frozenset("legal disclaimer side foot widget".split())
_NEUTRAL = frozenset("container wrapper wrap box block list item items left right top bottom main primary secondary inner outer section area body bar link links text title unit slot global site page content thread form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


class Line(NamedTuple):
    text: str
    links: int  # characters in links
    tag: str
    skipped: bool  # in furniture
    perhaps: bool  # in what may be furniture
    inside: bool  # in an element that marks the article
    form: int = 0  # number of the outermost form around it, from 1


def _kind(names: str) -> int:
    """2 if classes or an identifier name furniture and nothing else, 1 if perhaps or if only some of several names do, else 0."""
    best, others = 0, False
    for name in names.lower().split():
        parts = [x for x in re.split(r"[_-]+", name) if x and not x.isdigit()]
        if all(x in _FURNITURE or x in _PERHAPS or x in _NEUTRAL for x in parts):
            best = max([best, *(2 if x in _FURNITURE else 1 if x in _PERHAPS else 0 for x in parts)])
        else:
            others = True
    return min(best, 1) if others else best


class _Tags:
    """Finds where tags end, in a time that grows with the page: the places of all marks are listed once, and a quote that is found to close nowhere is not followed again."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.places: dict[str, list[int]] = {mark: [] for mark in "\"'>"}
        for found in _SPECIAL.finditer(page):
            self.places[found[0]].append(found.start())

    def _next(self, mark: str, at: int) -> int:
        places = self.places[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else len(self.page)

    def end(self, pos: int) -> int:
        """The place after the tag whose attributes begin at pos. Where its quotes leave it open, it ends at the next < or >."""
        page, at, seen = self.page, pos, []
        while True:
            at = min(self._next(mark, at) for mark in self.places)
            if at == len(page) or at in self.dead:
                break
            if page[at] == ">":
                return at + 1
            seen.append(at)
            closing = self._next(page[at], at + 1)
            if closing == len(page):
                break
            at = closing + 1
        self.dead.update(seen)
        found = _BRACKET.search(page, pos)
        return len(page) if found is None else found.end() if found[0] == ">" else found.start()


_SPECIAL, _BRACKET = re.compile("[>\"']"), re.compile("[<>]")


def _lines(page: str) -> tuple[list[Line], bool]:
    """Each block in page order, and whether an element marks the article.

    Where most prose lies is known at the end of the page: then forms that hold less become furniture, and
    the mark of an element goes if more than twice its prose stands in paragraphs beside it.
    """
    lines = _blocks(page)
    prose = lambda x: 0 if x.skipped or x.perhaps else len(x.text) - x.links
    whole, held = sum(map(prose, lines)), Counter()
    for x in lines:
        held[x.form] += prose(x)
    lines = [x._replace(skipped=x.skipped or (x.form > 0 and 2 * held[x.form] <= whole)) for x in lines]
    marked = [x for x in lines if x.inside and not x.skipped]
    if sum(prose(x) for x in lines if x.tag == "p" and not x.inside) > 2 * sum(len(x.text) for x in marked):
        return [x._replace(inside=False) for x in lines], False
    return lines, bool(marked)


def _blocks(page: str) -> list[Line]:
    out: list[Line] = []
    parts: list[str] = []
    link_chars = 0
    stack: list[tuple[str, int, bool]] = []  # name, kind of furniture, article
    depth: Counter = Counter()  # open elements by name
    tags = _Tags(page)
    kinds = [0, 0, 0]  # open elements that are no, perhaps and surely furniture
    inside = forms = 0
    tag = ""

    def flush():
        nonlocal link_chars, parts
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Line(text, link_chars, tag, kinds[2] > 0, kinds[1] > 0, inside > 0, forms if depth["form"] else 0))
        parts, link_chars = [], 0

    def leave():
        nonlocal inside
        name, kind, article = stack.pop()
        depth[name] -= 1
        kinds[kind] -= 1
        inside -= article
        return name

    pos, size = 0, len(page)
    while pos < size:
        if page[pos] != "<":
            end = page.find("<", pos)
            end = size if end < 0 else end
            parts.append(page[pos:end])
            link_chars += end - pos if depth["a"] > 0 else 0
            pos = end
            continue
        found = _NAME.match(page, pos)
        if found is None:
            other = _OTHER.match(page, pos)
            if other is None:
                parts.append("<")
                link_chars += depth["a"] > 0
            pos = other.end() if other else pos + 1
            continue
        name, begin = found[2].lower(), found.end()
        pos = tags.end(begin)
        if not found[1]:
            attrs = page[begin:pos].removesuffix(">")
            if name in _RAW:
                if not attrs.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                    pos = end.end() if end else size
                if name in ("textarea", "iframe"):
                    parts.append(" ")
                continue
            if name in _BLOCK:
                flush()
            elif name in ("br", "td", "th", "img", "hr"):
                parts.append(" ")
            if name in _VOID or attrs.endswith("/"):
                continue
            while stack and stack[-1][0] == name == "p" or (stack and name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack[-1][0] == name):
                leave()
            pairs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)} if "=" in attrs else {}
            role = pairs.get("role", "").lower()
            article = name in ("article", "main") or role in ("main", "article") or "articlebody" in pairs.get("itemprop", "").lower()
            names = f"{pairs.get('class', '')} {pairs.get('id', '')}"
            if article and name == "article" and _kind(names) == 2:
                article = False  # of a reader's comment, or of what is promoted
            if name in _BOILERPLATE or (name == "header" and not inside) or role in _ROLES or "hidden" in attrs.split():
                kind = 2
            else:
                kind = 0 if article or name in ("html", "body") else _kind(names)
            forms += name == "form" and depth["form"] == 0
            stack.append((name, kind, article))
            depth[name] += 1
            kinds[kind] += 1
            inside += article
            if name in _BLOCK:
                tag = name
        else:
            if name in _BLOCK:
                flush()
            elif name in ("td", "th"):
                parts.append(" ")
            if depth[name] > 0:
                while leave() != name:
                    pass
            if name in _BLOCK:
                tag = ""
    flush()
    return out


def weights(lines: list[Line], marked: bool) -> list[int]:
    """What each line adds to the windows it is in."""
    out = []
    for line in lines:
        prose = len(line.text) - line.links
        if line.skipped or (marked and not line.inside) or (2 * line.links > len(line.text) and (line.perhaps or not line.inside)):
            out.append(0)
        elif line.perhaps:
            out.append(-(-prose // 4))
        else:
            out.append(len(line.text) + SURGE if line.inside else prose)
    return out


def stretches(weight: list[int], surge: int) -> list[tuple[int, int]]:
    """Lines from each surge to its dive."""
    n = len(weight)
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] <= surge:
            i += 1
            continue
        begin = end = next(j for j in range(i, n) if weight[j])
        while end < n and sums[end] > 0:
            end += 1
        last = max(j for j in range(max(begin, end - WINDOW), end) if weight[j]) + 1
        out.append((begin, last))
        i = end
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by two line feeds; empty for a null, an empty page or a page without text."""
    if not page:
        return ""
    lines, marked = _lines(page)
    weight = weights(lines, marked)
    found = stretches(weight, SURGE) or stretches(weight, 0)
    if not found:
        return ""
    # All from the first surge to the last dive is text, but what weighs nothing between stretches.
    begin, end = found[0][0], found[-1][1]
    while begin and weight[begin - 1] and lines[begin - 1].tag in ("h1", "h2", "h3"):
        begin -= 1  # headings just above the surge belong to the text
    kept = [x > 0 for x in weight]
    for lo, hi in found:
        for i in range(lo, hi):
            kept[i] = not lines[i].skipped and (not marked or lines[i].inside)
    return "\n\n".join(lines[i].text for i in range(begin, end) if kept[i])


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The input's rows and columns with the main text of each page; a column of that name is replaced.

    Pages are independent: no shuffle, whole pages whatever their length, and a
    page of any length takes a time that grows with it. Malformed markup never
    fails; a null or empty page has an empty text. Repeated rows each get their
    text, and an empty table stays one.
    """
    names = [c for c in pages.columns if c != out_col]
    rows = pages.select(*names)
    where = names.index(html_col)
    schema = StructType(list(rows.schema.fields)).add(out_col, StringType())

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, out_col])

    return rows.mapInArrow(run, schema)
