"""Roll-ups over one snapshot."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import basename, dirname, extname, round_half_up, sha_prefix, trim
from ..schema import Snapshot


def relation_kind_counts(s: Snapshot) -> DataFrame:
    return s.relations.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def sum_parts(parts: DataFrame) -> DataFrame:
    """Sums per group of index parts; uid and path are those of the first part."""
    sums = [F.sum(c).alias(c) for c in ("fileCount", "symbolCount", "relationCount", "chunkCount")]
    return parts.groupBy("indexGroup").agg(*sums, F.min_by("uid", "indexPart").alias("uid"), F.min_by("indexPath", "indexPart").alias("indexPath"))


# Patterns that give a path its area kind, in order of precedence.
AREA_TEST = r"(^|/)(test|tests|__tests__|spec|specs)(/|$)"
AREA_CONFIG = (
    r"(?i)(?<![A-Za-z0-9_])(?:package\.json|tsconfig\.json|jsconfig\.json|pyproject\.toml|requirements\.txt|Cargo\.toml|go\.mod|pom\.xml|build\.gradle|CMakeLists\.txt"
    r"|docker-compose\.|Dockerfile|\.env|eslint|prettier|vite|webpack|next|babel|rollup|turbo|nx).*$"
)
AREA_DOCS = r"(?i)(^|/)(docs?|documentation|readme|guides)(/|$)"
AREA_INFRA = r"(?i)(^|/)(infra|infrastructure|deploy|ops|kubernetes|helm|docker|scripts|ci|cd|terraform)(/|$)"


def area_kind(path: Column) -> Column:
    code = F.lower(path).rlike("src|lib|app|pkg")
    out = None
    for pattern, kind in ((AREA_TEST, "test"), (AREA_CONFIG, "config"), (AREA_DOCS, "docs"), (AREA_INFRA, "infra")):
        out = F.when(path.rlike(pattern), kind) if out is None else out.when(path.rlike(pattern), kind)
    return out.when(code, "source").otherwise("unknown")


def area_path(path: Column) -> Column:
    """The first two segments."""
    return F.coalesce(F.nullif(F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, 2), "/"), F.lit("")), F.lit("."))


def repository_map(s: Snapshot) -> DataFrame:
    """Areas with files and symbols; name and kind are those of the area's first file."""
    files = s.files.select(area_path(F.col("path")).alias("area"), area_kind(F.col("path")).alias("kind"), "ord")
    areas = files.groupBy("area").agg(F.count("*").alias("files"), F.min_by("kind", "ord").alias("kind"))
    symbols = s.symbols.groupBy(area_path(F.col("filePath")).alias("area")).agg(F.count("*").alias("symbols"))
    out = areas.join(symbols, "area", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0).cast("long")))
    return out.select(F.split("area", "/")[0].alias("name"), F.col("area").alias("path"), "kind", "files", "symbols").orderBy(F.desc("files"), "path")


def complexity(s: Snapshot) -> DataFrame:
    """Per file: symbols, fan-in, fan-out and the estimates derived from them, most complex first."""
    own = s.symbols.groupBy(F.col("filePath").alias("path")).agg(F.count("*").alias("symbolCount"))
    out = s.relations.groupBy(F.col("filePath").alias("path")).agg(F.count("*").alias("fanOut"))
    at = s.symbols.select(F.col("id").alias("toSymbolId"), F.col("filePath").alias("path"))
    into = s.relations.select("toSymbolId").join(at, "toSymbolId").groupBy("path").agg(F.count("*").alias("fanIn"))
    rows = s.files.select("path", "size", "ord").join(own, "path", "left").join(out, "path", "left").join(into, "path", "left").fillna(0, ["symbolCount", "fanOut", "fanIn"])
    rows = rows.withColumn("loc", round_half_up(F.greatest(F.lit(10.0), F.col("size") / 35))).withColumn("cyclomatic", round_half_up(1 + 1.5 * F.col("symbolCount") + 0.8 * F.col("fanOut")))
    return rows.orderBy(F.desc("cyclomatic"), "ord").drop("size")


def complexity_summary(s: Snapshot, top: int = 15) -> dict:
    rows = complexity(s)
    total = rows.agg(F.coalesce(F.sum("cyclomatic"), F.lit(0)).alias("total"), F.count("*").alias("files"), F.coalesce(round_half_up(F.sum("cyclomatic") / F.count("*")), F.lit(0)).alias("average"))
    return {"totals": total, "top": rows.limit(top)}


def duplicate_chunks(s: Snapshot) -> DataFrame:
    """(hash, count, first) of chunk texts over 30 characters that occur more than once."""
    long = s.chunks.where(F.length(trim(F.col("text"))) > 30)
    return long.groupBy("hash").agg(F.count("*").alias("count"), F.min("ord").alias("first")).where("count > 1")


def duplicate_groups(s: Snapshot, limit: int = 20, excerpt: int = 200) -> DataFrame:
    """The first groups with all their chunks; groups are numbered in order of first occurrence."""
    groups = duplicate_chunks(s).orderBy("first").limit(limit)
    numbered = groups.withColumn("group", F.concat(F.lit("dup-"), F.row_number().over(Window.orderBy("first"))))  # of the limited groups
    rows = s.chunks.join(F.broadcast(numbered), "hash")
    return rows.select("group", "hash", "count", F.lit(1.0).alias("similarity"), "filePath", "startLine", "endLine", F.left("text", F.lit(excerpt)).alias("excerpt"), "ord").orderBy("first", "ord")


def module_rollup(s: Snapshot) -> DataFrame:
    """Symbols per file, per module and in all, in one pass; modules also count their files."""
    rows = s.symbols.select(F.when(F.col("filePath").contains("/"), dirname(F.col("filePath"))).otherwise("(root)").alias("module"), F.col("filePath").alias("file"))
    return rows.rollup("module", "file").agg(F.count("*").alias("symbols"), F.countDistinct(F.col("file")).alias("files"))


def module_edges(s: Snapshot, by: str = "module") -> DataFrame:
    """Edges between files or modules by kind, without those that stay inside one."""
    group = F.col("filePath") if by == "file" else F.when(F.col("filePath").contains("/"), dirname(F.col("filePath"))).otherwise("(root)")
    at = lambda end: s.symbols.select(F.col("id").alias(f"{end}SymbolId"), group.alias(end))
    rows = s.relations.join(at("from"), "fromSymbolId").join(at("to"), "toSymbolId")
    return rows.where(F.col("from") != F.col("to")).groupBy("from", "to", "kind").agg(F.count("*").alias("n"))


def folder_counts(s: Snapshot) -> DataFrame:
    """Files below every folder, at any depth."""
    parts = F.split("path", "/")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return s.files.select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def health(s: Snapshot, existing: DataFrame, sample: int = 50) -> DataFrame:
    """One row: broken ends of relations, counted apart, and those of the first `sample` files that are not in existing(path)."""
    ids = s.symbols.select("id")
    lost = lambda end: s.relations.where(F.col(end).isNotNull()).join(ids.withColumnRenamed("id", end), end, "left_anti").agg(F.count("*").alias(end))
    missing = s.files.orderBy("ord").limit(sample).join(existing.select("path"), "path", "left_anti").agg(F.count("*").alias("missingFiles"))
    both = lost("fromSymbolId").crossJoin(lost("toSymbolId")).crossJoin(missing)  # single rows
    return both.select((F.col("fromSymbolId") + F.col("toSymbolId")).alias("brokenReferences"), "missingFiles")


def database_models(s: Snapshot) -> DataFrame:
    lower = F.lower("path")
    kind = F.when(lower.endswith(".prisma"), "prisma").when(lower.endswith(".sql") | lower.contains("/migrations/") | lower.contains("/migrate/"), "sql").when(lower.rlike("model|entity|schema"), "orm")
    label = F.when(F.col("kind") == "prisma", "Prisma Schema").when(F.col("kind") == "sql", "SQL Schema / Migration").otherwise("ORM Model")
    return s.files.withColumn("kind", kind).where("kind IS NOT NULL").select(basename(F.col("path")).alias("name"), "kind", F.col("path").alias("filePath"), label.alias("tableOrModel"))


def _is_config(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(json|toml|yaml|yml)$|docker|config")


def configs(s: Snapshot) -> DataFrame:
    lower = F.lower("path")
    kind = F.when(lower.contains("docker"), "Container").when(lower.contains("package.json"), "Dependencies").otherwise("Configuration")
    return s.files.where(_is_config(F.col("path"))).select(F.col("path").alias("filePath"), kind.alias("type"), F.col("language").alias("format"))


def docs(s: Snapshot) -> DataFrame:
    """Documents that are no configuration, with up to five of the first hundred symbols whose names they mention."""
    found = s.files.where(~_is_config(F.col("path")) & F.lower("path").rlike(r"\.(md|rst)$|doc")).select("path", "ord")
    first = s.symbols.orderBy("ord").limit(100).where(F.length("name") > 3).select(F.lower("name").alias("term"), "name", F.col("ord").alias("nameOrd"))
    linked = s.file_terms.withColumnRenamed("filePath", "path").join(F.broadcast(first), "term").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nameOrd", "name"))).alias("names"))
    title = F.expr("left(base, length(base) - length(ext))")
    rows = found.join(linked, "path", "left").withColumn("base", basename(F.col("path"))).withColumn("ext", extname(F.col("path")))
    names = F.coalesce(F.transform(F.slice("names", 1, 5), lambda x: x["name"]), F.array().cast("array<string>"))
    return rows.select(F.col("path").alias("filePath"), title.alias("title"), names.alias("linkedSymbols"))


#: Names that a task may hold as an automaton, and their characters: some 50 bytes for each, so 200 MB.
AUTOMATON_NAMES, AUTOMATON_CHARACTERS = 200_000, 4_000_000


def _by_pieces(lowered: DataFrame, names: DataFrame) -> DataFrame:
    """(name, targetSymbol): the pieces of each name that are as long as some other are joined with the others by equality."""
    lengths = F.array(*[F.lit(r.n) for r in names.select(F.length("piece").alias("n")).distinct().collect()]).cast("array<int>")  # no more than the longest name has characters
    fitting = F.filter(lengths, lambda k: k <= F.length("low"))
    pieces = F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), F.length("low") - k + 1), lambda i: F.col("low").substr(i, k)))
    pairs = lowered.select("name", F.explode(F.array_distinct(F.flatten(pieces))).alias("piece")).join(names, "piece").where(F.col("other") != F.col("name"))
    return pairs.groupBy("name").agg(F.min_by("other", F.struct("otherOrd", "other")).alias("targetSymbol"))


def _by_automaton(lowered: DataFrame, names: DataFrame) -> DataFrame:
    """The same, each name read once by an automaton of all others. Of names that differ in case alone the first two are kept: one of them isn't the name itself."""
    import ahocorasick

    known = names.groupBy("piece").agg(F.slice(F.array_sort(F.collect_list(F.struct("otherOrd", "other"))), 1, 2).alias("first"))
    words = lowered.sparkSession.sparkContext.broadcast([(r.piece, [tuple(x) for x in r.first]) for r in known.collect()])  # as many as AUTOMATON_NAMES

    def search(frames):
        automaton, everywhere = ahocorasick.Automaton(), []
        for word, first in words.value:
            if word:
                automaton.add_word(word, first)
            else:  # the empty name is in all
                everywhere = first
        automaton.make_automaton()
        for frame in frames:
            best = []
            for name, low in zip(frame["name"], frame["low"]):
                lists = [first for _, first in automaton.iter(low)] if len(automaton) else []
                found = (x for first in [everywhere, *lists] for x in first if x[1] != name)
                best.append(min(found, default=(None, None))[1])
            out = pd.DataFrame({"name": frame["name"], "targetSymbol": best})
            yield out[out["targetSymbol"].notna()]

    return lowered.mapInPandas(search, "name string, targetSymbol string")


def test_links(s: Snapshot) -> DataFrame:
    """Symbols of test files with the first other name that theirs contains.

    Up to AUTOMATON_NAMES distinct names are an automaton that every task holds; the names of more are found as pieces by a join.
    """
    lower = F.lower("filePath")
    framework = F.when(lower.endswith(".py"), "pytest / unittest").when(lower.endswith(".go"), "go test").when(lower.endswith(".rs"), "cargo test").otherwise("jest / node:test / vitest")
    tests = s.symbols.where(lower.rlike("test|spec|__tests__")).select("id", "filePath", "name", "ord", framework.alias("framework"))
    names = s.symbols.where("name IS NOT NULL").groupBy(F.col("name").alias("other")).agg(F.min("ord").alias("otherOrd"))
    names = names.withColumn("piece", F.lower("other"))
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("characters")).first()
    lowered = tests.select("name", F.lower("name").alias("low")).distinct().where("low IS NOT NULL")
    small = 0 < size.n <= AUTOMATON_NAMES and size.characters <= AUTOMATON_CHARACTERS
    hits = _by_automaton(lowered, names) if small else _by_pieces(lowered, names)
    return tests.join(hits, "name", "left").orderBy("ord").select(F.col("filePath").alias("testFile"), F.col("name").alias("testSymbol"), "targetSymbol", "framework")


def index_group(group: Column, label: Column) -> Column:
    """The group, or else the label without its part number; null if it has none."""
    bare = F.regexp_replace(label, r" · part \d+ of \d+$", "")
    return F.coalesce(group, F.nullif(bare, label))


def symbols_csv(s: Snapshot) -> DataFrame:
    """One line per symbol, and the header first, by `ord`; names and paths are quoted, quotes doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = s.symbols.select("ord", F.concat_ws(",", quoted("name"), F.col("kind"), quoted("filePath"), F.col("startLine").cast("string"), F.col("endLine").cast("string")).alias("line"))
    return s.spark.sql("SELECT -1L AS ord, 'Name,Kind,FilePath,StartLine,EndLine' AS line").unionByName(lines)


def symbols_json(s: Snapshot) -> DataFrame:
    return s.symbols.select("ord", F.to_json(F.struct(*[c for c in s.symbols.columns if c != "ord"])).alias("line"))


def pack_batches(items: DataFrame, size_col: str = "size", order_col: str = "path", max_items: int = 100, max_bytes: int = 32 << 20) -> DataFrame:
    """items with `batch` from 0: greedy, in order, by count and bytes.

    The cut positions depend on all rows before, so one group folds over (order, size) alone, streamed in order;
    the items themselves are joined back.
    """
    import pandas as pd

    def fold(frames):
        n = used = batch = 0
        for frame in frames:
            out = []
            for size in frame["size"]:
                if n and (n >= max_items or used + size > max_bytes):
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + size
                out.append(batch)
            yield pd.DataFrame({"at": frame["at"], "batch": out})

    keys = items.select(F.col(order_col).alias("at"), F.col(size_col).cast("long").alias("size")).repartition(1).sortWithinPartitions("at")
    cuts = keys.mapInPandas(fold, f"at {dict(items.dtypes)[order_col]}, batch long")
    return items.join(cuts, items[order_col] == cuts["at"]).drop("at")


def repository_parts(items: DataFrame, repository: str, order_col: str = "path", **limits) -> DataFrame:
    """Parts of a repository's files: part, files, uid, label and group; a single part has the repository's own label."""
    packed = pack_batches(items, "size", order_col, **limits).groupBy(F.col("batch").alias("part")).agg(F.count("*").alias("files"))
    total = packed.agg((F.max("part") + 1).alias("total"))  # one row
    number = (F.col("part") + 1).cast("string")
    label = F.when(F.col("total") > 1, F.concat(F.lit(f"{repository} · part "), number, F.lit(" of "), F.col("total").cast("string"))).otherwise(repository)
    uid = sha_prefix(F.concat(F.lit(f"{repository}\0part-"), number), 32)
    return packed.crossJoin(F.broadcast(total)).select("part", "files", uid.alias("uid"), label.alias("label"), F.lit(repository).alias("indexGroup"))


def git_log(lines: DataFrame, limit: int = 20) -> DataFrame:
    """Commits from lines of `hash|author|date|subject`."""
    part = F.split("value", r"\|", 4)
    return lines.limit(limit).select(part[0].alias("hash"), F.get(part, 1).alias("author"), F.get(part, 2).alias("date"), F.get(part, 3).alias("message"))
