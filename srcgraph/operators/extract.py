"""Symbols, relations and chunks from source texts.

One pass per file in a Python worker. Python is read with its own syntax tree;
languages with braces by a lexer that knows strings, comments and templates and
matches braces; languages whose blocks end with a word, and shell scripts, by
one that matches these words; all else only gives text chunks. Identifiers
derive from offsets in UTF-16 units.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..schema import SCHEMAS, Snapshot
from ..sources.staging import unstaged

#: Longer texts are not parsed, in UTF-16 units.
MAX_PARSE = 4 << 20
CHUNK_LINES, CHUNK_CHARS = 100, 4000
BRACED = frozenset("typescript javascript java csharp go rust kotlin scala swift php c cpp dart solidity".split())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


@dataclass
class Parsed:
    symbols: list[tuple] = field(default_factory=list)
    relations: list[tuple] = field(default_factory=list)
    chunks: list[tuple] = field(default_factory=list)
    error: bool = False


class _Builder:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.out = path, text, Parsed()
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        #: Places of characters of two units, looked for once.
        self.wide = [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)] if not text.isascii() else []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def offset(self, at: int) -> int:
        """In UTF-16 units."""
        return at + bisect.bisect_left(self.wide, at)

    def symbol(self, kind: str, name: str, start: int, end: int, parent: str | None, exported: bool = False) -> str:
        name = re.split(r"::|\.", name)[-1]
        sid = sha(f"{self.path}:{kind}:{name}:{self.offset(start)}")[:24]
        first, last = self.line(start), self.line(max(start, end - 1))
        self.out.symbols.append((sid, self.path, name, kind, first, last, start - self.lines[first - 1], end - self.lines[last - 1], parent))
        if parent:
            self.relation(f"{self.path}:contains:{parent}:{sid}", "contains", parent, sid, name, start, 1.0)
        if exported:
            self.relation(f"{self.path}:exports:{sid}", "exports", None, sid, name, start, 1.0)
        body = self.text[start:end]
        digest = sha(body)
        self.out.chunks.append((sha(f"{sid}:{digest}")[:24], self.path, sid, first, last, digest, body))
        return sid

    def relation(self, key: str, kind: str, source: str | None, to: str | None, target: str, at: int, confidence: float) -> None:
        self.out.relations.append((key, kind, self.path, source, to, target, self.line(at), confidence))

    def edge(self, kind: str, target: str, at: int, source: str | None, confidence: float, extra: int | None = None) -> None:
        key = f"{self.path}:{kind}:{self.offset(at)}:{target if extra is None else self.offset(extra)}"
        self.relation(key, kind, source, None, target, at, confidence)


_LEX = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<name>[#@]?[\w$]+)|(?P<arrow>=>|::|->)|(?P<mark>.)",
    re.S,
)
_KEYWORDS = frozenset(
    "if for while switch catch return new typeof await async function class interface enum const let var else do try finally throw import export from default extends implements "
    "public private protected static readonly abstract override get set in of instanceof void null undefined true false this super type namespace module declare package func fn def struct trait impl "
    "use pub mut match where as is case break continue yield delete with int string boolean char float double long bool final".split()
)
_KIND = {"class": "class", "interface": "interface", "enum": "enum", "struct": "class", "trait": "interface", "namespace": "namespace", "module": "module", "record": "class", "object": "class", "protocol": "interface"}


def _parse_braced(b: _Builder, language: str) -> None:
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(b.text) if m.lastgroup not in ("space", "comment")]
    n = len(tokens)
    match: dict[int, int] = {}
    stack: list[int] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, (group, text, _, _) in enumerate(tokens):
        if group == "mark" and text in "([{":
            stack.append(i)
        elif group == "mark" and text in pairs:
            while stack and tokens[stack[-1]][1] != pairs[text]:
                stack.pop()
            if stack:
                match[stack.pop()] = i
    word = lambda i: tokens[i][1] if 0 <= i < n else ""
    is_name = lambda i: 0 <= i < n and tokens[i][0] == "name" and not tokens[i][1][0].isdigit()

    def end_of(i: int) -> int:
        """Past the block or statement that begins at token i."""
        depth = 0
        for k in range(i, n):
            t = word(k)
            if tokens[k][0] == "mark":
                if t == "{" and depth == 0:
                    return match.get(k, n - 1)
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth -= 1
                    if depth < 0:
                        return k - 1
                elif t == ";" and depth == 0:
                    return k
        return n - 1

    declared: set[int] = set()
    skipped: set[int] = set()

    def heritage(i: int, stop: int, source: str) -> None:
        kind = None
        for k in range(i, stop):
            t = word(k)
            if t in ("extends", "implements") or (t == ":" and language in ("csharp", "kotlin", "cpp", "swift") and kind is None):
                kind, head = ("implements" if t == "implements" else "extends"), k
            elif kind and is_name(k) and t not in _KEYWORDS and word(k + 1) not in (".", "::"):
                b.edge(kind, t, tokens[head][2], source, 0.7, tokens[k][2])

    def walk(i: int, stop: int, parent: str | None, parent_kind: str | None) -> None:
        while i < stop:
            group, text, start, _ = tokens[i]
            exported = text == "export" or (text == "pub" and language == "rust")
            first = start
            j = i
            while word(j) in ("export", "default", "async", "public", "private", "protected", "static", "abstract", "final", "readonly", "declare", "pub", "override", "const") and is_name(j + 1) and word(j) != "const" or (word(j) == "const" and word(j + 1) == "enum"):
                j += 1
            t = word(j)
            if t == "import" or (t == "export" and "from" in (word(j + 1), word(match.get(j + 1, -2) + 1), word(j + 2))) or (t == "use" and language in ("rust", "php")):
                k = j
                while k < stop and tokens[k][0] != "string" and word(k) != ";" and tokens[k][2] - tokens[j][2] < 4000:
                    if k > j and word(k) in ("import", "const", "class", "function"):
                        break
                    k += 1
                if k < stop and tokens[k][0] == "string":
                    b.edge("imports", word(k)[1:-1], tokens[j][2], parent, 0.7)
                    skipped.update(range(j, k + 1))
                    i = k + 1
                    continue
            if t in _KIND and is_name(j + 1) and word(j - 1) != ".":
                close = end_of(j + 2)
                brace = next((k for k in range(j + 2, close + 1) if word(k) == "{"), close)
                sid = b.symbol(_KIND[t], word(j + 1), first, tokens[min(close, n - 1)][3], parent, exported)
                heritage(j + 2, brace, sid)
                declared.add(j + 1)
                skipped.update(range(j + 2, brace))
                walk(brace + 1, close, sid, t)
                i = close + 1
                continue
            if t in ("function", "func", "fn", "fun", "def") and (is_name(j + 1) or word(j + 1) in ("*", "(")):
                k = j + 1
                if t == "func" and word(k) == "(":  # a receiver
                    k = match.get(k, k) + 1
                k += word(k) == "*"
                if is_name(k):
                    close = end_of(k + 1)
                    method = parent_kind in _KIND or word(j + 1) == "("
                    sid = b.symbol("method" if method else "function", word(k), first, tokens[close][3], parent, exported)
                    declared.add(k)
                    walk(k + 1, close + 1, sid, "function")
                    i = close + 1
                    continue
            if t == "type" and is_name(j + 1) and word(j + 2) in ("=", "<", "struct", "interface"):
                close = end_of(j + 2)
                kind = {"struct": "class", "interface": "interface"}.get(word(j + 2), "type")
                b.symbol(kind, word(j + 1), first, tokens[close][3], parent, exported)
                declared.add(j + 1)
                i = close + 1
                continue
            if t in ("const", "let", "var", "val") and is_name(j + 1):
                close = end_of(j + 1)
                k = close
                while word(k) == "}" and word(k + 1) in (")", ",", "."):
                    k = end_of(k + 2)
                sid = b.symbol("constant" if t == "const" else "variable", word(j + 1), tokens[j + 1][2] if not exported else first, tokens[max(close, k)][3], parent, exported)
                declared.add(j + 1)
                walk(j + 2, max(close, k) + 1, sid, "variable")
                i = max(close, k) + 1
                continue
            if parent_kind in _KIND and is_name(j) and word(j + 1) == "(" and word(j) not in ("if", "for", "while", "switch", "catch", "return"):
                after = match.get(j + 1, j + 1)
                brace = next((k for k in range(after, min(n, after + 60)) if word(k) in ("{", ";", "}")), after)
                if word(brace) == "{":
                    close = match.get(brace, n - 1)
                    sid = b.symbol("constructor" if word(j) == "constructor" else "method", word(j), first, tokens[close][3], parent)
                    declared.add(j)
                    walk(j + 1, close + 1, sid, "method")
                    i = close + 1
                    continue
            if is_name(i) and i not in skipped and i not in declared and text not in _KEYWORDS:
                if word(i + 1) == "(" and word(i - 1) not in ("function", "func", "fn"):
                    b.edge("calls", text, start, parent, 0.55)
                else:
                    b.edge("references", text, start, parent, 0.45)
            i += 1

    walk(0, n, None, None)


def _parse_python(b: _Builder) -> None:
    tree = ast.parse(b.text)
    starts = b.lines
    raw = [line.encode() for line in b.text.split("\n")]
    at = lambda line, col: starts[line - 1] + len(raw[line - 1][:col].decode("utf-8", "ignore"))

    def visit(node: ast.AST, parent: str | None, inside: str | None, callee: bool = False) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside == "class" else "function"
            start = at(node.lineno, node.col_offset)
            sid = b.symbol(kind, node.name, start, at(node.end_lineno, node.end_col_offset), parent)
            for base in getattr(node, "bases", ()):
                name = base.attr if isinstance(base, ast.Attribute) else getattr(base, "id", None)
                if name:
                    b.edge("extends", name, start, sid, 0.7, at(base.lineno, base.col_offset))
            for child in ast.iter_child_nodes(node):
                visit(child, sid, kind)
            return
        if isinstance(node, ast.ImportFrom):
            b.edge("imports", "." * node.level + (node.module or ""), at(node.lineno, node.col_offset), parent, 0.7)
            return
        if isinstance(node, ast.Import):
            for name in node.names:
                b.edge("imports", name.name, at(node.lineno, node.col_offset), parent, 0.7)
            return
        if isinstance(node, ast.Assign) and inside is None:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    b.symbol("variable", target.id, at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), parent)
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
            if name:
                b.edge("calls", name, at(node.lineno, node.col_offset), parent, 0.55)
            visit(node.func, parent, inside or "", True)
            for child in [*node.args, *node.keywords]:
                visit(child, parent, inside or "")
            return
        if isinstance(node, ast.Name) and not callee and isinstance(node.ctx, ast.Load):
            b.edge("references", node.id, at(node.lineno, node.col_offset), parent, 0.45)
        for child in ast.iter_child_nodes(node):
            visit(child, parent, inside if isinstance(node, ast.Module) else (inside or ""))

    visit(tree, None, None)


@dataclass(frozen=True)
class _Worded:
    """A language whose blocks end with a word."""

    lexer: re.Pattern
    opens: frozenset[str]  # words that open a block wherever they stand
    heads: frozenset[str]  # words that open a block at the head of a statement only
    declares: dict[str, str]  # word before a name, and the symbol's kind
    imports: frozenset[str]
    closes: frozenset[str] = frozenset(["end"])


def _lexer(comment: str, name: str = r"[A-Za-z_][\w]*[?!]?") -> re.Pattern:
    return re.compile(rf"(?P<comment>{comment})|(?P<string>\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|(?P<name>{name})|(?P<line>[\n;])|(?P<space>[^\S\n]+)|(?P<mark>.)", re.S)


_WORDED = {
    "ruby": _Worded(_lexer(r"\#[^\n]*|(?:(?<=\n)|\A)=begin.*?(?:\n=end|\Z)"), frozenset(["do"]), frozenset("class module def if unless case while until for begin".split()), {"class": "class", "module": "module", "def": "function"}, frozenset(["require", "require_relative", "load"])),
    "lua": _Worded(_lexer(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*"), frozenset("function if do repeat".split()), frozenset(), {"function": "function"}, frozenset(["require", "dofile"]), frozenset(["end", "until"])),
    "elixir": _Worded(_lexer(r"\#[^\n]*"), frozenset("do fn".split()), frozenset(), {"defmodule": "module", "defprotocol": "interface", "def": "function", "defp": "function", "defmacro": "function"}, frozenset("import alias use require".split())),
    "julia": _Worded(_lexer(r"\#=.*?(?:=\#|\Z)|\#[^\n]*"), frozenset("function struct module if for while let begin do try quote macro".split()), frozenset(), {"function": "function", "struct": "class", "module": "module", "macro": "function"}, frozenset("import using include".split())),
    "bash": _Worded(_lexer(r"(?:(?<=\s)|\A)\#[^\n]*", r"[A-Za-z_][\w-]*"), frozenset(["{"]), frozenset(), {"function": "function"}, frozenset(["source"]), frozenset(["}"])),
}


def _parse_worded(b: _Builder, language: str) -> None:
    """Blocks by their words. A name after a declaring word is a symbol, one before a bracket a call, others are references."""
    rules = _WORDED[language]
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in rules.lexer.finditer(b.text) if m.lastgroup not in ("space", "comment")]
    n = len(tokens)
    word = lambda i: tokens[i][1] if 0 <= i < n else ""
    group = lambda i: tokens[i][0] if 0 <= i < n else ""
    head = lambda i: i == 0 or group(i - 1) == "line" or word(i - 1) in ("=", "then", "else", "do", "local")
    known = rules.opens | rules.heads | rules.closes | rules.imports | set(rules.declares) | {"then", "else", "elsif", "elseif", "local", "return", "nil", "true", "false", "self", "and", "or", "not", "in", "end", "fi", "done", "esac"}

    def opening(i: int) -> bool:
        if word(i) in rules.opens and group(i) in ("name", "mark"):
            after_word = word(i + 1) == ":" or word(i - 1) in (":", ".")  # a keyword argument or a member
            # `for .. do` and `while .. do` are one block where the head of the statement opens it already.
            return not after_word and not (language == "ruby" and word(i) == "do" and any(word(k) in ("while", "until", "for") for k in range(*_statement(i))))
        return word(i) in rules.heads and group(i) == "name" and head(i)

    def _statement(i: int) -> tuple[int, int]:
        k = i
        while k > 0 and group(k - 1) != "line":
            k -= 1
        return k, i

    close: dict[int, int] = {}
    stack: list[int] = []
    for i in range(n):
        if opening(i):
            stack.append(i)
        elif word(i) in rules.closes and group(i) in ("name", "mark") and stack and word(i - 1) != ".":
            close[stack.pop()] = i
    for i in stack:
        close[i] = n - 1

    def block(i: int) -> int:
        """The token that ends what is declared at token i: its own block, or the first that opens in its statement, or the statement."""
        if i in close:
            return close[i]
        k = i
        while k < n and group(k) != "line":
            if k in close:
                return close[k]
            k += 1
        return min(k, n) - 1

    owners: list[tuple[int, str, str]] = []  # last token, symbol, kind
    i = 0
    while i < n:
        while owners and owners[-1][0] < i:
            owners.pop()
        kind, text, start, _ = tokens[i]
        parent = owners[-1][1] if owners else None
        shell = language == "bash" and kind == "name" and head(i) and word(i + 1) == "(" and word(i + 2) == ")"
        if kind == "name" and (text in rules.declares and group(i + 1) == "name" and word(i - 1) not in (".", ":") or shell):
            k = i if shell else i + 1
            while word(k + 1) in (".", ":") and group(k + 2) == "name":  # Module.name, self.name or object:name
                k += 2
            name = word(k)
            last = block(i if i in close else k)
            inside = owners[-1][2] if owners else ""
            what = "function" if shell else rules.declares[text]
            what = "method" if what == "function" and language in ("ruby", "lua") and (inside in ("class", "module") or (language == "lua" and k > i + 1)) else what
            symbol = b.symbol(what, name, start, tokens[last][3], parent)
            if language == "ruby" and text == "class" and word(k + 1) == "<" and group(k + 2) == "name":
                b.edge("extends", word(k + 2), start, symbol, 0.7, tokens[k + 2][2])
                k += 2
            owners.append((last, symbol, what))
            i = k + 1
            continue
        if kind == "name" and text in rules.imports and (head(i) or word(i - 1) in ("(", "=")):
            k = i + 1 + (word(i + 1) == "(")
            if group(k) == "string":
                b.edge("imports", word(k).strip("\"'"), start, parent, 0.7)
                i = k + 1
                continue
            if group(k) == "name" or (language == "bash" and group(k) == "mark"):
                end = k
                while end + 1 < n and group(end + 1) != "line" and tokens[end + 1][2] == tokens[end][3]:
                    end += 1
                b.edge("imports", b.text[tokens[k][2] : tokens[end][3]], start, parent, 0.7)
                i = end + 1
                continue
        if kind == "name" and text not in known:
            b.edge("calls" if word(i + 1) == "(" else "references", text, start, parent, 0.55 if word(i + 1) == "(" else 0.45)
        i += 1


def parse(path: str, text: str, language: str) -> Parsed | None:
    """None for texts that are too long or in a language without a parser."""
    if units(text) > MAX_PARSE or not (language == "python" or language in BRACED or language in _WORDED):
        return None
    b = _Builder(path, text)
    try:
        _parse_python(b) if language == "python" else _parse_worded(b, language) if language in _WORDED else _parse_braced(b, language)
    except (SyntaxError, RecursionError, ValueError):
        return Parsed(error=True)
    return b.out


_HEADING = re.compile(r"#{1,6}\s")


def text_chunks(path: str, text: str) -> list[tuple]:
    """Sections that end before headings, at 100 lines or 4,000 characters, and at two blank lines; blank ones drop out."""
    lines = re.split(r"\r?\n", text)
    out: list[tuple] = []

    def close(first: int, last: int) -> None:
        section = "\n".join(lines[first : last + 1]).strip()
        if section:
            digest = sha(section)
            out.append((sha(f"{path}:{first}:{digest}")[:24], path, None, first + 1, last + 1, digest, section))

    start = used = 0
    for i, line in enumerate(lines):
        size = units(line)
        if i > start and (_HEADING.match(line) or i - start >= CHUNK_LINES or used + 1 + size > CHUNK_CHARS):
            close(start, i - 1)
            start, used = i, size
        elif i > start and not line.strip() and not lines[i - 1].strip():
            close(start, i - 1)
            start, used = i + 1, -1
        else:
            used = size if i <= start else used + 1 + size
    if start < len(lines):
        close(start, len(lines) - 1)
    return out


_S = "array<struct<id:string,filePath:string,name:string,kind:string,startLine:int,endLine:int,startColumn:int,endColumn:int,parentId:string>>"
_R = "array<struct<id:string,kind:string,filePath:string,fromSymbolId:string,toSymbolId:string,targetName:string,line:int,confidence:double>>"
_C = "array<struct<id:string,filePath:string,symbolId:string,startLine:int,endLine:int,hash:string,text:string>>"


def extract(files: DataFrame, stage=unstaged) -> Snapshot:
    """files(path, language, hash, size, modifiedAt, text) to a snapshot without metadata and vectors.

    `ord` keeps the records of a file together and in position; with_order puts the files in order of path.
    With `stage` each file is parsed once, however often its records are read.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                got = parse(path, text or "", language)
                chunks = got.chunks if got and got.chunks else text_chunks(path, text or "")
                rows.append((path, got.symbols if got else [], got.relations if got else [], chunks, bool(got and got.error)))
            yield pd.DataFrame(rows, columns=["path", "s", "r", "c", "parseError"])

    parsed = stage(files.select("path", "language", "text").mapInPandas(run, f"path string, s {_S}, r {_R}, c {_C}, parseError boolean"), "parsed")
    # Within a file records keep their position; files are ordered by path.
    place = F.pmod(F.xxhash64("path"), F.lit(1 << 40))

    def rows(column: str, name: str) -> DataFrame:
        part = parsed.select("path", F.posexplode(column).alias("pos", "x")).select("x.*", (place * (1 << 20) + F.col("pos")).alias("ord"))
        return part.dropDuplicates(["id"]).select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")])

    out = files.withColumn("terms", terms(F.col("text"))).withColumn("ord", place * (1 << 20))
    spark = files.sparkSession
    empty = Snapshot.empty(spark)
    return empty.with_(files=out.select(*[c.split(" ")[0] for c in SCHEMAS["files"].split(", ")]), symbols=rows("s", "symbols"), relations=rows("r", "relations"), chunks=rows("c", "chunks"))


def path_ranks(files: DataFrame, stage=unstaged) -> DataFrame:
    """(path, rank) from 0 in order of path.

    With `stage` ranks are found range by range, each counted from where the one before ends, so no task sorts all
    paths. Ranges are sampled anew in each evaluation, hence the single window without it.
    """
    paths = files.select("path")
    if stage is unstaged:
        return paths.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("rank"))
    mask = (1 << 33) - 1  # monotonically_increasing_id: the partition above 33 bits of position
    dealt = paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id())
    dealt = stage(dealt.select("path", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(mask)).alias("within")), "ranked")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return dealt.join(sizes.select("part", before.alias("before")), "part").select("path", (F.col("before") + F.col("within")).alias("rank"))


#: Numbers of records within a file, and of files that may yet come between two.
RECORDS, GAP = 1 << 20, 1 << 16
#: Files that may come at once between those that have numbers; each is held by the driver and by every task.
NEW_FILES = 100_000


def _placed(s: Snapshot, places: DataFrame) -> Snapshot:
    def put(df: DataFrame, key: str) -> DataFrame:
        return df.join(places.withColumnRenamed("path", key), key, "left").withColumn("ord", F.col("place") * RECORDS + F.pmod(F.col("ord"), F.lit(RECORDS))).select(*df.columns)

    return s.with_(files=put(s.files, "path"), symbols=put(s.symbols, "filePath"), relations=put(s.relations, "filePath"), chunks=put(s.chunks, "filePath"))


def with_order(s: Snapshot, stage=unstaged) -> Snapshot:
    """ord anew: files by path, other records by file and position. For one index. Numbers of files leave gaps for files that come later."""
    return _placed(s, path_ranks(s.files, stage).select("path", ((F.col("rank") + 1) * GAP).alias("place")))


def with_order_among(fresh: Snapshot, files: DataFrame) -> Snapshot | None:
    """ord of changed and new files and their records, between the numbers of files(path, ord), which stay. None if a gap is full or too many files are new."""
    spark = files.sparkSession
    known = files.select("path", F.shiftright("ord", 20).alias("place"))
    same = fresh.files.select("path").join(known, "path")
    new = [r.path for r in fresh.files.select("path").join(known, "path", "left_anti").limit(NEW_FILES + 1).collect()]
    if len(new) > NEW_FILES:
        return None
    new.sort(key=lambda p: p.encode())
    codes = [p.encode() for p in new]

    def slot(paths: pd.Series) -> pd.Series:
        """How many of the new paths come before."""
        return pd.Series([bisect.bisect_left(codes, p.encode()) for p in paths], dtype="int32")

    places: list[tuple[str, int]] = []
    if new:
        bounds = {r.slot: (r.lo, r.hi) for r in known.select(F.pandas_udf(slot, "int")("path").alias("slot"), "place").groupBy("slot").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).collect()}
        # New paths i..j-1 have no known one between them: they share the gap after the last known one before.
        i, below = 0, bounds.get(0, (0, 0))[1]
        while i < len(new):
            j = i + 1
            while j < len(new) and j not in bounds:
                j += 1
            above = bounds[j][0] if j in bounds else below + (j - i + 1) * GAP
            if above - below <= j - i:
                return None
            places += [(p, below + (above - below) * (k + 1) // (j - i + 1)) for k, p in enumerate(new[i:j])]
            i, below = j, bounds[j][1] if j in bounds else above
    return _placed(fresh, same.unionByName(spark.createDataFrame(places, "path string, place long")))
