"""File dependencies from import statements."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, extname, join_path, normalize_path
from ..schema import Snapshot
from ..sources.staging import settings
from .graph import _cut, strongly_connected

# Extensions tried on an import without one, and what a script extension may stand for.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".cs", ".kt", ".kts", ".swift", ".rb", ".php", ".vue", ".svelte"]
SCRIPTS, TYPED = [".js", ".jsx", ".mjs", ".cjs"], [".ts", ".tsx", ".mts", ".cts"]
# Tasks of the binding read so much, of a table or of a shuffle, however many imports there are.
TASK_BYTES, TASKS = "16m", 200


def strip_json_comments(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*//.*$", ""), r",\s*([}\]])", "$1")


def load_alias_config(texts: DataFrame) -> dict | None:
    """Base folder and path patterns of the root's tsconfig.json, or else jsconfig.json; texts(path, text)."""
    rows = texts.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("path", strip_json_comments(F.col("text")).alias("text")).orderBy(F.desc("path")).collect()
    for r in rows:  # two at most
        try:
            options = json.loads(r.text).get("compilerOptions") or {}
        except (ValueError, AttributeError):
            continue
        if isinstance(options.get("paths"), dict):
            return {"baseUrl": options.get("baseUrl") or ".", "paths": options["paths"]}
    return None


def _meanings(base: str, scripts: Column) -> Column:
    """The (way, key) under which the files that an import of the column `base` may mean are filed: as it stands, without its extension, or as what a script is compiled from."""
    path, ext = F.col(base), extname(F.col(base))
    at = lambda way, key: F.struct(F.lit(way).alias("way"), key.alias("key"))
    plain = at("plain", path)
    typed = at("typed", F.substring(path, F.lit(1), F.length(path) - F.length(ext)))
    return F.when(ext == "", F.array(plain, at("bare", path))).when(scripts & ext.isin(SCRIPTS), F.array(plain, typed)).otherwise(F.array(plain))


def _looked_up(base: str, scripts: Column, *of: str) -> Column:
    """_meanings, and where there is no base a key of its own for each row `of`, under which nothing is filed: null keys would all meet in one task."""
    nowhere = F.array(F.struct(F.lit("none").alias("way"), F.concat_ws("\0", *of).alias("key")))
    return F.when(F.col(base).isNull(), nowhere).otherwise(_meanings(base, scripts))


def _filed(files: DataFrame) -> DataFrame:
    """(way, key, rank, to): every file under each key that leads to it, four rows at most, so an import looks up two keys and not one for each extension."""
    path, ext = F.col("path"), extname(F.col("path"))
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    place = lambda xs, first: F.array_position(F.array(*map(F.lit, xs)), ext) + first
    at = lambda way, key, rank: F.struct(F.lit(way).alias("way"), key.alias("key"), rank.cast("int").alias("rank"))
    known = ext.isin(EXTENSIONS)
    rows = F.array(
        at("plain", path, F.lit(0)), F.when(known, at("bare", stem, place(EXTENSIONS, 0))), F.when(ext.isin(TYPED), at("typed", stem, place(TYPED, 0))),
        F.when(known & stem.endswith("/index"), at("bare", F.substring(stem, F.lit(1), F.length(stem) - len("/index")), place(EXTENSIONS, len(EXTENSIONS)))),
    )
    # Several rows a file, of longer keys than the files' estimate knows of: they are merged, since a broadcast would hold all of them in the driver and every task, and a hash table cannot spill.
    return files.select(F.explode(F.array_compact(rows)).alias("f"), path.alias("to")).select("f.*", "to").hint("merge")


def workspace_packages(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(name, root, entryPoints) of the manifests that name a package; malformed ones drop out."""
    manifest = texts.where(basename(F.col("path")) == "package.json")
    fields = F.from_json("text", "name string, types string, module string, main string")
    rows = manifest.select("path", fields.alias("m")).where("m.name IS NOT NULL AND m.name <> ''").select(
        F.col("m.name").alias("name"), F.when(dirname(F.col("path")) == ".", "").otherwise(dirname(F.col("path"))).alias("root"), F.col("path").alias("manifest"), "m"
    )
    entries = F.array_compact(F.array("m.types", "m.module", "m.main", *[F.lit(x) for x in ("src/index.ts", "src/index.js", "index.ts", "index.js")]))
    each = rows.select("manifest", "root", F.posexplode(F.filter(entries, lambda x: x != "")).alias("entry", "sub"))
    each = each.select("manifest", "entry", join_path(F.col("root"), F.regexp_replace(F.regexp_replace("sub", "^/", ""), r"^\./", "")).alias("base"))
    found = each.select("manifest", "entry", F.explode(_meanings("base", F.lit(False))).alias("m")).select("manifest", "entry", "m.*").join(_filed(files), ["way", "key"])
    best = found.groupBy("manifest", "entry").agg(F.min_by("to", "rank").alias("path")).groupBy("manifest").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("entry", "path"))), lambda x: x["path"])).alias("entryPoints"))
    return rows.drop("m").join(best, "manifest", "left").select("name", "root", F.coalesce("entryPoints", F.array().cast("array<string>")).alias("entryPoints")).orderBy("name")


def _fitting(config: dict) -> list[tuple[Column, str, Column]]:
    """(condition, pattern, mapped target) of every mapping of the configuration, longest prefix first, for a column `target`."""
    out = []
    for pattern, mappings in sorted(config["paths"].items(), key=lambda kv: -(kv[0].index("*") if "*" in kv[0] else len(kv[0]))):
        head, star, tail = pattern.partition("*")
        target = F.col("target")
        fits = (target.startswith(head) & target.endswith(tail) & (F.length(target) >= len(head) + len(tail))) if star else target == pattern
        wild = F.substring(target, F.lit(len(head) + 1), F.length(target) - len(head) - len(tail)) if star else F.lit("")
        for mapping in mappings:
            a, star2, b = mapping.partition("*")
            out.append((fits, pattern, F.concat(F.lit(a), wild, F.lit(b)) if star2 else F.lit(mapping)))
    return out


def bind_imports(s: Snapshot, config: dict | None, packages: DataFrame) -> DataFrame:
    """(filePath, target, line, relative, shaped, package, internal, to, pattern, mapped) of every import, `to` null where no file is meant.

    `relative`: begins with a dot; `shaped`: fits an alias; `package`: the name in front of any other; `internal`: of the workspace.

    What an import means depends on its folder and target alone. Each distinct pair is classified by
    expressions, its ranked candidates meet the files in one join, and the least wins: aliases by
    pattern and mapping, from the base folder before the importing one, and then packages.
    """
    imports = s.relations.where("kind = 'imports'").select("filePath", dirname(F.col("filePath")).alias("dir"), F.trim("targetName").alias("target"), "line").where("target IS NOT NULL")
    target, folder = F.col("target"), F.col("dir")
    segments = F.split(target, "/")
    package = F.when(target.startswith("@"), F.array_join(F.slice(segments, 1, 2), "/")).otherwise(segments[0])
    fitting = _fitting(config) if config else []
    shaped = F.lit(False)
    for fits, _, _ in fitting:
        shaped = shaped | fits
    pairs = imports.select("dir", "target").distinct().withColumn("relative", target.startswith(".")).withColumn("shaped", ~F.col("relative") & shaped).withColumn("package", F.when(~F.col("relative"), package))
    named = packages.groupBy(F.col("name").alias("package")).agg(F.max_by(F.struct("root", F.get("entryPoints", 0).alias("entry")), "root").alias("p"))
    pairs = pairs.join(named, "package", "left").withColumn("internal", F.col("p").isNotNull())

    def choice(order: int, base: Column, pattern: str | None = None, mapped: Column | None = None) -> Column:
        names = (F.lit(pattern), F.lit(None) if mapped is None else mapped)
        return F.struct(F.lit(order).alias("order"), base.alias("base"), names[0].cast("string").alias("pattern"), names[1].cast("string").alias("mapped"))

    at_last = 2 * len(fitting)
    below = join_path(F.col("p.root"), F.substring(target, F.length("package") + 2, F.length(target)))
    choices = [F.when(F.col("relative"), choice(0, normalize_path(F.concat_ws("/", folder, target)))), F.when(F.col("internal"), choice(at_last, F.when(target == F.col("package"), F.col("p.entry")).otherwise(below)))]
    for i, (fits, pattern, mapped) in enumerate(fitting):
        for near, start in enumerate((F.lit(config["baseUrl"]), folder)):
            choices.append(F.when(~F.col("relative") & fits, choice(2 * i + near, join_path(start, mapped), pattern, mapped)))
    about = ["dir", "target", "relative", "shaped", "package", "internal"]
    asked = pairs.select(*about, F.explode_outer(F.array_compact(F.array(*choices))).alias("c")).select(*about, "c.*")
    asked = asked.select(*about, "order", "pattern", "mapped", F.explode(_looked_up("base", F.col("relative"), "dir", "target")).alias("m")).select(*about, "order", "pattern", "mapped", "m.*")
    led = asked.join(_filed(s.files), ["way", "key"], "left")
    first = F.min_by(F.struct("to", "pattern", "mapped"), F.when(F.col("to").isNotNull(), F.struct("order", "rank")))
    known = led.groupBy(*about).agg(first.alias("b")).select(*about, "b.*")
    return imports.join(known, ["dir", "target"]).drop("dir")


def _dealt(spark) -> dict[str, str]:
    """Settings under which partitions are many at first and joined up to TASK_BYTES, so a task's memory doesn't grow with the imports."""
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": TASK_BYTES}


def analyze(s: Snapshot, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of the report. texts(path, text) holds the configuration files and manifests.

    An import is relative, of an alias, of a workspace package or external. The imports are bound once and
    written; all parts are read from that table. Imports of the file itself don't count.
    """
    if texts is None:
        texts = s.spark.createDataFrame([], "path string, text string")
    with settings(s.spark, _dealt(s.spark)):
        packages = _cut(workspace_packages(texts, s.files))
        bound = _cut(bind_imports(s, load_alias_config(texts), packages))
    edges = bound.where("filePath <> to").groupBy(F.col("filePath").alias("from"), "to").agg(F.count("*").alias("imports"), F.array_sort(F.collect_set("line")).alias("lines"))
    external = bound.where("NOT relative AND NOT shaped AND NOT internal AND to IS NULL")
    importers = external.groupBy(F.col("package").alias("name"), "filePath").agg(F.count("*").alias("n"))  # counted by file first: a package's list meets no file twice
    externals = importers.groupBy("name").agg(F.sum("n").alias("importedBy"), F.sort_array(F.collect_list("filePath")).alias("files")).orderBy(F.desc("importedBy"), "name")
    missing = lambda kind: bound.where(f"{kind} AND to IS NULL").select("filePath", "target", "line").orderBy("filePath", "line")
    aliases = bound.where("pattern IS NOT NULL").groupBy(F.col("pattern").alias("alias")).agg(F.min("mapped").alias("target"), F.countDistinct("to").alias("files"))
    fans = fan_in_out(s.files, edges)
    return {
        "edges": edges, "files": fans, "mostDependedOn": fans.where("fanIn > 0").orderBy(F.desc("fanIn"), "path").limit(10), "entryCandidates": fans.where("fanIn = 0 AND fanOut > 0").orderBy("path"),
        "unresolvedRelativeImports": missing("relative"), "unresolvedAliasImports": missing("shaped"), "externalPackages": externals, "resolvedAliases": aliases, "workspacePackages": packages.orderBy("name"),
    }


def fan_in_out(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every file."""
    out = edges.groupBy(F.col("from").alias("path")).agg(F.countDistinct("to").alias("fanOut"))
    into = edges.groupBy(F.col("to").alias("path")).agg(F.countDistinct("from").alias("fanIn"))
    return files.select("path").join(into, "path", "left").join(out, "path", "left").fillna(0, ["fanIn", "fanOut"])


def cycles(edges: DataFrame) -> DataFrame:
    """Groups of files that import each other, largest first."""
    groups = strongly_connected(edges.select(F.col("from").alias("src"), F.col("to").alias("dst")))
    return groups.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"), F.count("*").alias("size")).orderBy(F.desc("size"), F.col("files")[0])
