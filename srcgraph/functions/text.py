"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A search term.
TERM = r"[\p{L}\p{N}_$.\-]+"
#: ASCII word boundaries: Java's own are Unicode-aware.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: White space that trimming removes at either end.
_SPACE = r"[\s\u000B   -     　﻿]+"


def terms(text: Column) -> Column:
    """Distinct lower-cased terms in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def all_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sha_prefix(text: Column, length: int = 24) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(length))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """'.' for a path without a folder."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """With its dot; empty for none, and for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalize_path(path: Column) -> Column:
    """Folds '.' and '..' segments of a relative POSIX path."""
    folded = _folded(path)
    out = F.array_join(folded, "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def _folded(path: Column) -> Column:
    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        climbs = (part == "..") & F.coalesce(last != "..", F.lit(False))
        return F.when((part == "") | (part == "."), acc).when(climbs, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def join_path(folder: Column, path: Column) -> Column:
    return normalize_path(F.concat_ws("/", folder, path))


def normalize_target(target: Column) -> Column:
    """The bare module name of an import target: quotes, relative prefix, scheme, query, /index, extension and folders go."""
    bare = F.regexp_replace(target, r"^['\"]|['\"]$", "")
    value = F.regexp_replace(bare, r"^(\./|\.\./|/)", "")
    value = F.regexp_replace(value, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    value = F.regexp_replace(value, r"[?#].*$", "")
    value = F.regexp_replace(value, r"/index$", "")
    value = F.regexp_replace(value, r"\.[^/.]+$", "")
    last = F.try_element_at(F.filter(F.split(value, "/"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(last, bare)


# File extensions and the languages they stand for.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".css": "css", ".scss": "css", ".sass": "css",
    ".less": "css", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".edn": "clojure", ".dart": "dart", ".el": "elisp", ".elm": "elm", ".erl": "erlang",
    ".hrl": "erlang", ".ex": "elixir", ".exs": "elixir", ".go": "go", ".graphql": "graphql", ".gql": "graphql", ".hs": "haskell", ".lhs": "haskell", ".htm": "html",
    ".html": "html", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".cjs": "javascript", ".mjs": "javascript", ".jl": "julia", ".json": "json",
    ".json5": "json", ".jsonc": "json", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".md": "markdown", ".mdx": "markdown", ".m": "objectivec", ".mm": "objectivec",
    ".ml": "ocaml", ".mli": "ocaml", ".pl": "perl", ".pm": "perl", ".php": "php", ".proto": "protobuf", ".ps1": "powershell", ".psm1": "powershell", ".py": "python",
    ".pyw": "python", ".r": "r", ".rmd": "r", ".rb": "ruby", ".rs": "rust", ".ql": "ql", ".res": "rescript", ".scala": "scala", ".sc": "scala", ".sh": "bash",
    ".bash": "bash", ".zsh": "bash", ".fish": "bash", ".sol": "solidity", ".sql": "sql", ".swift": "swift", ".tla": "tlaplus", ".toml": "toml", ".ts": "typescript",
    ".tsx": "typescript", ".cts": "typescript", ".mts": "typescript", ".xml": "xml", ".svg": "xml", ".yaml": "yaml", ".yml": "yaml", ".vue": "vue", ".zig": "zig",
    ".rdl": "systemrdl", ".cmake": "cmake",
}
# Whole file names that decide before the extension does.
NAMES = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "cmakelists.txt": "cmake", ".gitignore": "gitignore",
    ".dockerignore": "gitignore", ".npmignore": "gitignore", "cargo.toml": "toml", "go.mod": "go", "go.sum": "go",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The languages group the keys, so the CASE has one IN list per language."""
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    out = None
    for value, keys in groups.items():
        out = F.when(key.isin(keys), value) if out is None else out.when(key.isin(keys), value)
    return out


def language(path: Column) -> Column:
    name = F.lower(basename(path))
    return F.coalesce(_lookup(NAMES, name), _lookup(LANGUAGES, extname(name)), F.lit("text"))


def cosine(a: Column, b: Column) -> Column:
    """-1 for different lengths, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def truncate_and_normalize(values: Column, dimensions: int) -> Column:
    """The first values scaled to length one; a shorter or a zero vector is an error."""
    cut = F.slice(values, 1, dimensions)
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda acc, x: acc + x * x))
    short = F.raise_error(F.lit(f"vector has fewer than {dimensions} dimensions"))
    zero = F.raise_error(F.lit("vector has no length"))
    return F.when(F.size(values) < dimensions, short).when(norm == 0, zero).otherwise(F.transform(cut, lambda x: x / norm))
