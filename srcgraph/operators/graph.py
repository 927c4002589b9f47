"""Traversals and views of the relation graph."""

from __future__ import annotations

import itertools
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname, extname, join_path
from ..schema import Snapshot
from ..sources.staging import shared_root

# Extensions tried on imports, folders' index files, and relation kinds.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
INDEX_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
DERIVED_KINDS = ["contains", "exports", "exported-by", "imported-by", "called-by", "referenced-by", "extended-by", "implemented-by", "dependent-on", "overridden-by"]
DEPENDENCY_KINDS = ["imports", "exports", "calls", "references", "contains", "extends", "implements", "depends-on"]


_LOOPS: dict[str, str] = {}


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop: a table in the shared checkpoint folder, written in one job; it goes when the application ends."""
    spark = df.sparkSession
    root = _LOOPS.get(spark.sparkContext.applicationId)
    if root is None:
        root = _LOOPS[spark.sparkContext.applicationId] = f"{shared_root(spark)}/loops-{uuid.uuid4().hex[:12]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, first_edge_only: bool = True) -> DataFrame:
    """Edges crossed level by level: edges(src, dst, ord, ..) from seeds(node), with depth; a node is entered once.

    With first_edge_only one edge per entered node, else all edges of the level that enters it.
    """
    visited = _cut(seeds.select("node").distinct())
    frontier, found = visited, None
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").join(visited.withColumnRenamed("node", "dst"), "dst", "left_anti")
        if first_edge_only:
            rest = F.struct(*edges.columns)
            step = step.groupBy("dst").agg(F.min_by(rest, "ord").alias("e")).select("e.*")
        step = _cut(step.withColumn("depth", F.lit(depth)))
        found = step if found is None else found.unionByName(step)
        frontier = step.select(F.col("dst").alias("node")).distinct()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return found


def import_targets(s: Snapshot) -> DataFrame:
    """(filePath, target, ..) of relative imports that lead to an indexed file: the first candidate that exists."""
    rows = s.relations.where((F.col("kind") == "imports") & F.col("targetName").startswith("."))
    base = join_path(dirname(F.col("filePath")), F.col("targetName"))
    tails = F.array(*[F.lit(x) for x in ["", *SCRIPT_EXTENSIONS, *[f"/index{e}" for e in INDEX_EXTENSIONS]]])
    rows = rows.withColumn("base", base)
    # Each distinct base is looked for once, however many imports share it.
    each = rows.select("base").distinct().select("base", F.posexplode(F.when(extname(F.col("base")) == "", tails).otherwise(F.array(F.lit("")))).alias("rank", "tail"))
    found = each.withColumn("path", F.concat("base", "tail")).join(s.files.select("path"), "path").groupBy("base").agg(F.min_by("path", "rank").alias("target"))
    return rows.join(found, "base").select("id", "filePath", "target", "targetName", "line", "confidence", "ord").where("target <> filePath")


def change_impact(s: Snapshot, query: str, max_depth: int = 3) -> dict:
    """Files and symbols that a change of a file or symbol may affect, with risk and caveats."""
    q = query.strip().lower()
    if not q:
        raise ValueError("a file path or symbol name is required")
    depth = max(1, min(8, int(max_depth)))
    path = F.lower("path")
    files = s.files.where((path == q) | path.endswith(f"/{q}")).select("path")
    exact = s.symbols.where(F.lower("name") == q)
    by_file = not files.isEmpty()
    seeds = files.unionByName(exact.select(F.col("filePath").alias("path"))).distinct()
    if seeds.isEmpty() and "/" in q:
        seeds = s.files.where(path.contains(q)).select("path")
    seeds = _cut(seeds)
    matched = s.symbols.join(files.withColumnRenamed("path", "filePath"), "filePath", "left_semi") if by_file else exact
    reason = F.concat(F.lit("imports "), F.col("targetName"), F.lit(" (line "), F.col("line"), F.lit(")"))
    # Bound once and written: each level of the search reads them, and binding costs far more than a level.
    file_edges = _cut(import_targets(s).select(F.col("target").alias("src"), F.col("filePath").alias("dst"), "ord", F.col("filePath").alias("file"), "confidence", reason.alias("reason")))
    by_import = bfs(file_edges, seeds.withColumnRenamed("path", "node"), depth)
    reason = F.concat("kind", F.lit(": "), F.col("targetName"), F.lit(" (line "), F.col("line"), F.lit(")"))
    live = s.symbols.select(F.col("id").alias("fromSymbolId"))
    edges = s.relations.where(F.col("toSymbolId").isNotNull() & ~F.col("kind").isin(DERIVED_KINDS)).join(live, "fromSymbolId", "left_semi")
    edges = edges.select(F.col("toSymbolId").alias("src"), F.col("fromSymbolId").alias("dst"), "ord", F.col("filePath").alias("file"), "confidence", reason.alias("reason"))
    start = matched.select(F.col("id").alias("node")).unionByName(s.symbols.join(seeds.withColumnRenamed("path", "filePath"), "filePath", "left_semi").select(F.col("id").alias("node")))
    by_symbol = bfs(edges, start, depth, first_edge_only=False)
    both = by_import.select(F.lit(0).alias("pass"), "depth", "ord", "file", "confidence", "reason").unionByName(by_symbol.select(F.lit(1).alias("pass"), "depth", "ord", "file", "confidence", "reason"))
    both = both.join(seeds.withColumnRenamed("path", "file"), "file", "left_anti")
    once = both.groupBy("file", "reason").agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"), F.min(F.struct("pass", "depth", "ord")).alias("at"))
    affected = once.groupBy("file").agg(F.min("depth").alias("depth"), F.round(F.max("confidence"), 2).alias("confidence"), F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("r"))
    affected = affected.select(F.col("file").alias("filePath"), F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("impact"), "depth", "confidence", F.transform(F.slice("r", 1, 8), lambda x: x["reason"]).alias("reasons"))
    affected = _cut(affected.orderBy("depth", F.desc("confidence"), "filePath"))
    n, deepest, least = affected.agg(F.count("*"), F.max("depth"), F.min("confidence")).first()
    exact_n = exact.count()
    ambiguous, none = exact_n > 1 and not by_file, seeds.isEmpty()
    risk = "unknown" if none else "high" if n >= 10 or (deepest or 0) > 1 else "medium" if n >= 3 else "low"
    caveats = [f"Nothing in the index is named {q!r}."] * none + [f"{exact_n} symbols share this name, and all of them were followed."] * ambiguous
    caveats += [f"Edges were followed over at most {depth} steps, as the index has them."] + [f"The least certain edge has a confidence of {least}."] * ((least or 1) < 0.6)
    return {
        "query": query, "matchedFiles": seeds.orderBy("path"), "matchedSymbols": matched.select("name", "filePath", "kind"), "affectedFiles": affected,
        "affectedSymbols": s.symbols.join(affected.select("filePath", "depth"), "filePath").select("name", "filePath", "kind", "depth"), "risk": risk, "ambiguous": ambiguous, "caveats": caveats,
    }


def symbol_path(s: Snapshot, start: str, target: str, max_depth: int = 4, max_nodes: int = 32) -> dict:
    """A shortest directed path of names between symbols given by name or part of their path, as a queue would find it first."""
    a, b = start.strip(), target.strip()
    if not a or not b:
        return {"nodes": [x for x in (a or b,) if x], "edges": [], "depth": 0}
    at = lambda q: s.symbols.where((F.lower("name") == q.lower()) | F.lower("filePath").contains(q.lower())).select("id", "name", "ord")
    starts, targets = at(a), at(b).select("id", F.lit(True).alias("goal"))
    if starts.isEmpty() or targets.isEmpty():
        return {"nodes": [a, b], "edges": [], "depth": 0}
    edges = s.relations.where("fromSymbolId IS NOT NULL AND toSymbolId IS NOT NULL").select(F.col("fromSymbolId").alias("id"), F.col("toSymbolId").alias("next"), "kind", "confidence", "ord")
    none = F.array().cast("array<struct<from:string,to:string,kind:string,confidence:double>>")
    level = _cut(starts.select("id", F.array(F.col("ord")).alias("queue"), F.array("id").alias("path"), none.alias("edges")))
    seen = level.select("id")
    for depth in range(min(max_depth, max_nodes - 2) + 1):
        hit = level.join(targets, "id").orderBy("queue").select("path", "edges").first()
        if hit:
            # Names of the one path that is found, instead of a join of each level with all symbols.
            names = {r.id: r.name for r in s.symbols.where(F.col("id").isin(hit.path)).select("id", "name").collect()}
            named = lambda i: names.get(i, i)
            return {"nodes": [named(i) for i in hit.path], "edges": [{**e.asDict(), "from": named(e["from"]), "to": named(e["to"])} for e in hit.edges], "depth": depth}
        step = level.join(edges, "id").join(seen.withColumnRenamed("id", "next"), "next", "left_anti")
        # The queue's order: that of the parent, then of the edge.
        step = step.select(
            "next", F.concat("queue", F.array("ord")).alias("queue"), F.concat("path", F.array("next")).alias("path"),
            F.concat("edges", F.array(F.struct(F.element_at("path", -1).alias("from"), F.col("next").alias("to"), "kind", "confidence"))).alias("edges"),
        )
        level = _cut(step.groupBy(F.col("next").alias("id")).agg(F.min_by(F.struct("queue", "path", "edges"), "queue").alias("x")).select("id", "x.*"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("id"))
    return {"nodes": [r.name for r in starts.orderBy("ord").limit(max_nodes).collect()], "edges": [], "depth": 0}


def dependency_relations(s: Snapshot, query: str, reverse: bool = False, depth: int = 1) -> DataFrame:
    """One-hop relations of eight kinds that match a file or symbol; depth matters only below 1."""
    q = query.strip().lower()
    rows = s.relations
    if not q or depth < 1:
        return rows.where("false")
    import re

    stem = re.sub(r"/index$", "", re.sub(r"\.[^/.]+$", "", q))
    base = re.sub(r"\.[^/.]+$", "", q.split("/")[-1])
    path = F.lower("filePath")
    symbols = s.symbols.where((F.lower("name") == q) | path.contains(q) | path.contains(stem)).select("id")
    files = s.files.where(F.lower("path").contains(q) | F.lower("path").contains(stem)).select(F.col("path").alias("filePath"), F.lit(True).alias("_file"))
    end = "toSymbolId" if reverse else "fromSymbolId"
    rows = rows.where(F.col("kind").isin(DEPENDENCY_KINDS)).join(files, "filePath", "left").join(symbols.select(F.col("id").alias(end), F.lit(True).alias("_symbol")).distinct(), end, "left")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("targetName"), "^['\"]|['\"]$", ""), r"^\./?", ""), "/index$", "")
    target = F.regexp_replace(name, r"\.[^/.]+$", "")
    match = F.col("_file").isNotNull() | F.lower("targetName").contains(q) | name.contains(stem) | target.contains(base) | F.lit(stem).contains(target) | F.lit(q).contains(target)
    return rows.where(match | F.col("_symbol").isNotNull()).select(*s.relations.columns).orderBy(F.desc("confidence"), "line")


def resolved_edges(s: Snapshot) -> DataFrame:
    return s.relations.where("fromSymbolId IS NOT NULL AND toSymbolId IS NOT NULL")


def graph_cycles(s: Snapshot, limit: int = 20) -> DataFrame:
    """Cycles closed by back edges of a depth-first search in order of symbols, as many as limit.

    The search is sequential by definition: the distinct edges of one index are folded in one group. For large graphs use
    strongly_connected, which is distributed and finds the same knots.
    """
    edges = resolved_edges(s).groupBy("fromSymbolId", "toSymbolId").agg(F.min("ord").alias("ord"))
    rows = s.symbols.select(F.lit(0).alias("rank"), "ord", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "name", "filePath")
    rows = rows.unionByName(edges.select(F.lit(1).alias("rank"), "ord", F.col("fromSymbolId").alias("a"), F.col("toSymbolId").alias("b"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("filePath")))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "ord"])
        nodes = frame[frame["rank"] == 0]
        about = {i: (n, f) for i, n, f in zip(nodes["a"], nodes["name"], nodes["filePath"])}
        after: dict[str, list[str]] = {}
        for a, b in frame.loc[frame["rank"] == 1, ["a", "b"]].itertuples(index=False):
            after.setdefault(a, []).append(b)
        seen, place, stack, out = set(), {}, [], []
        for root in about:
            if root in seen or len(out) >= limit:
                continue
            work = [(root, iter(after.get(root, ())))]
            seen.add(root)
            place[root] = 0
            stack.append(root)
            while work:
                node, rest = work[-1]
                step = next(rest, None)
                if step is None:
                    work.pop()
                    stack.pop()
                    del place[node]
                elif step in place:
                    if len(out) < limit:
                        ids = stack[place[step] :]
                        out.append((f"cycle-{len(out) + 1}", [about.get(i, (i, None))[0] for i in ids], list(dict.fromkeys(about[i][1] for i in ids if i in about)), len(ids)))
                elif step not in seen:
                    seen.add(step)
                    place[step] = len(stack)
                    stack.append(step)
                    work.append((step, iter(after.get(step, ()))))
        return pd.DataFrame(out, columns=["id", "symbols", "files", "length"])

    return rows.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(search, "id string, symbols array<string>, files array<string>, length int")


#: Nodes with more followers are looked up by broadcast, up to so many of them (16 bytes each).
FOLLOWED, BROADCAST_NODES = 10_000, 200_000
#: Edges from which on a graph's busiest knot is looked for first, and the part of all nodes seen that a level of that search must add.
KNOTTED, LEVEL = 10_000, 100


def least_reached(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(node, least): the least node that each node of edges(src, dst), two longs, reaches, itself included.

    Each round a node takes the least of what its successors have, then what the node that it has found has found itself.
    It also takes what lies ahead on a path of chosen successors, whose length doubles each round and begins anew when it
    spans the graph. So with numbers in random order even paths and rings of n nodes take some multiple of log n rounds
    instead of n. `rounds` gets a number for each.
    """
    known = _cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("least", F.col("node")))
    span = max(1, known.count().bit_length())
    for turn in itertools.count():
        if turn % span == 0:
            hops = _cut(edges.groupBy("src").agg(F.min_by("dst", F.xxhash64("dst", F.lit(turn))).alias("dst")))
        else:  # a path that ends stays at its end
            hops = _cut(hops.join(hops.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst", "left").select("src", F.coalesce("far", "dst").alias("dst")))
        steps = edges if turn % span == 0 else edges.unionByName(hops)
        pushed = steps.join(known.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("least").alias("p"))
        near = _cut(known.join(pushed, "node", "left").select("node", F.least("least", F.coalesce("p", "least")).alias("least"), F.coalesce(F.col("p") < F.col("least"), F.lit(False)).alias("moved")))
        if rounds is not None:
            rounds.append(turn)
        if near.where("moved").isEmpty():
            return near.select("node", "least")
        # Of the nodes that others have found only those that went on themselves are looked up.
        followed = near.groupBy(F.col("least").alias("node")).agg(F.count("*").alias("n"))
        ahead = _cut(followed.join(near.select("node", F.col("least").alias("further")), "node").where("further < node").select(F.col("node").alias("least"), "further", "n"))
        known = near.select("node", "least") if ahead.isEmpty() else _cut(_jumped(near, ahead).select("node", F.coalesce("further", "least").alias("least")))


def _jumped(near: DataFrame, ahead: DataFrame) -> DataFrame:
    """near with `further`, if its `least` went on. Few of these, or the much followed ones of many, are broadcast."""
    if ahead.count() <= BROADCAST_NODES:
        return near.join(F.broadcast(ahead.drop("n")), "least", "left")
    hot = ahead.where(F.col("n") > FOLLOWED).drop("n")
    if not 0 < hot.count() <= BROADCAST_NODES:
        return near.join(ahead.drop("n"), "least", "left")
    cold = near.join(F.broadcast(hot.select("least")), "least", "left_anti").join(ahead.where(F.col("n") <= FOLLOWED).drop("n"), "least", "left")
    return cold.unionByName(near.join(F.broadcast(hot), "least"))


def _trimmed(left: DataFrame, n: int) -> tuple[DataFrame, int]:
    """n edges(a, b) without those from a node that none leads to, or to one that none leaves: these are in no cycle. Again while that halves them. With their number."""
    while n:
        before = n
        left = _cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        n = left.count()
        if 2 * n > before:
            break
    return left, n


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_NODES else df.hint("merge")


def _knot(left: DataFrame) -> tuple[DataFrame, int, int]:
    """(id): nodes that the busiest node of edges(a, b) reaches and is reached by, itself included; their number; that node.

    It is searched from in both directions at once, each node being entered once in each. The search ends when a level adds
    little, and after as many levels as the number of nodes has bits: all it finds is in one component, which may have more.
    """
    way = lambda a, b, ahead: F.struct(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(ahead).alias("ahead"))
    arcs = _cut(left.select(F.explode(F.array(way("a", "b", True), way("b", "a", False))).alias("e")).select("e.*"))
    degrees = arcs.groupBy("node").agg(F.least(F.count_if("ahead"), F.count_if(~F.col("ahead"))).alias("n"))
    nodes, pivot = degrees.agg(F.count("*"), F.max_by("node", F.struct("n", "node"))).first()
    fresh = seen = left.sparkSession.createDataFrame([(pivot, True), (pivot, False)], "node long, ahead boolean")
    added = total = 2
    for _ in range(nodes.bit_length()):
        met = arcs.join(_sized(fresh, added), ["node", "ahead"]).select(F.col("next").alias("node"), "ahead").distinct()
        fresh = _cut(met.join(_sized(seen, total), ["node", "ahead"], "left_anti"))
        added = fresh.count()
        seen, total = seen.unionByName(fresh), total + added
        if added * LEVEL < total:
            break
    both = _cut(seen.groupBy("node").agg(F.count("*").alias("ways")).where("ways = 2").select(F.col("node").alias("id")))
    return both, both.count(), pivot


def strongly_connected(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """edges(src, dst) to (node, component) of components of two or more nodes, named after their least node.

    Nodes get random numbers. All nodes that reach the same least one are a class, with that one as its pivot; backward,
    within the classes, each node finds the least that reaches it. Nodes that their pivot reaches are its component. What
    is left falls apart by both answers, gets new numbers and goes on, so all classes are divided at once, and the rounds
    grow with powers of the logarithm of a graph's size, however deep it is. As each round takes all edges, most nodes of a
    large component are found first, by a search that crosses an edge once in each direction, and made one node.
    """
    edges = _cut(edges.where("src <> dst").select("src", "dst").distinct())
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    numbered, salt = None, 0
    while numbered is None:  # until no two names have one number
        tried = _cut(names.select("name", F.xxhash64("name", F.lit(salt)).alias("node")))
        numbered, salt = (tried if tried.groupBy("node").count().where("count > 1").isEmpty() else None), salt + 1
    number = lambda c: F.xxhash64(c, F.lit(salt - 1))
    left = _cut(edges.select(number("src").alias("a"), number("dst").alias("b")))
    out, turn = None, 0
    left, n = _trimmed(left, left.count())
    knot = None
    if n >= KNOTTED:
        knot, members, pivot = _knot(left)
        for end in ("a", "b"):
            inside = knot.select(F.col("id").alias(end), F.lit(pivot).alias("knot"))
            left = left.join(_sized(inside, members), end, "left").withColumn(end, F.coalesce("knot", end)).drop("knot")
        left = _cut(left.where("a <> b").distinct())
        left, n = _trimmed(left, left.count())
    while n:
        turn += 1
        own = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        drawn = left.select(own("a").alias("src"), own("b").alias("dst"), "a", "b")
        forward = least_reached(drawn.select("src", "dst"), rounds)
        class_ = lambda end: forward.select(F.col("node").alias(end), F.col("least").alias(f"{end}Class"))  # noqa: B023, E731
        inside = _cut(drawn.join(class_("src"), "src").join(class_("dst"), "dst").where("srcClass = dstClass"))
        backward = least_reached(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), rounds)
        found = backward.join(forward.withColumnRenamed("least", "pivot"), "node").where("least = pivot")
        ends = _cut(inside.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("a").alias("id")), F.struct(F.col("dst").alias("node"), F.col("b").alias("id")))).alias("e")).select("e.*").distinct())
        part = _cut(found.join(ends, "node").select("id", F.concat_ws(":", F.lit(turn), "pivot").alias("c")))
        out = part if out is None else out.unionByName(part)
        back = lambda end: backward.select(F.col("node").alias(end), F.col("least").alias(f"{end}Back"))  # noqa: B023, E731
        rest = inside.join(back("src"), "src").join(back("dst"), "dst").where("srcBack = dstBack AND srcBack <> srcClass")
        left = _cut(rest.select("a", "b"))
        left, n = _trimmed(left, left.count())
    if knot is not None:
        # The component that the knot's node turned out to be of has all of the knot.
        own_c = None if out is None else out.where(F.col("id") == pivot).select("c").first()
        whole = knot.select("id", F.lit(own_c.c if own_c else "knot").alias("c"))
        out = whole if out is None else out.where(F.col("id") != pivot).unionByName(whole)
    if out is None:
        return edges.where("false").select(F.col("src").alias("node"), F.col("dst").alias("component"))
    members = out.join(numbered.withColumnRenamed("node", "id"), "id")
    least = members.groupBy("c").agg(F.min("name").alias("component"), F.count("*").alias("n")).where("n > 1")
    return members.join(least, "c").select(F.col("name").alias("node"), "component")


def degrees(s: Snapshot) -> DataFrame:
    ends = s.relations.select(F.explode(F.array_compact(F.array("fromSymbolId", "toSymbolId"))).alias("id"))
    return s.symbols.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def _induced(s: Snapshot, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    rows = resolved_edges(s).join(F.broadcast(ids.withColumnRenamed("id", "fromSymbolId")), "fromSymbolId", "left_semi")
    return rows.join(F.broadcast(ids.withColumnRenamed("id", "toSymbolId")), "toSymbolId", "left_semi").select(*s.relations.columns)


def relation_graph(s: Snapshot, limit: int = 80) -> dict:
    """The nodes of highest degree and the edges among them; limit 0 is no limit."""
    ranked = degrees(s).orderBy(F.desc("degree"), "name", "ord")
    nodes = ranked.limit(limit) if limit else ranked
    edges = _induced(s, nodes) if limit else resolved_edges(s)
    return {"nodes": nodes, "edges": edges, "truncated": bool(limit) and s.symbols.count() > limit}


def radial_graph(s: Snapshot, query: str = "") -> DataFrame:
    """Neighbours of the first symbol that contains the query, with the side and kind of the first edge to each."""
    q = query.lower()
    root = s.symbols.where(F.lower("name").contains(q) | F.lower("filePath").contains(q)).orderBy("ord").limit(1).select(F.col("id").alias("root"))
    rows = resolved_edges(s)
    out = rows.join(F.broadcast(root), F.col("fromSymbolId") == F.col("root")).select("root", F.col("toSymbolId").alias("id"), F.lit("out").alias("side"), "kind", F.col("ord").alias("edgeOrd"))
    into = rows.join(F.broadcast(root), F.col("toSymbolId") == F.col("root")).select("root", F.col("fromSymbolId").alias("id"), F.lit("in").alias("side"), "kind", F.col("ord").alias("edgeOrd"))
    first = out.unionByName(into).where("id <> root").groupBy("root", "id").agg(F.min_by(F.struct("side", "kind", "edgeOrd"), F.struct("edgeOrd", "side")).alias("e"))
    return first.join(s.symbols.select("id", "name", "filePath"), "id").select("root", "id", "name", "filePath", "e.side", "e.kind", "e.edgeOrd").orderBy("edgeOrd")


def flow_graph(s: Snapshot, limit: int = 40) -> dict:
    """The first symbols by level, 2 for those inside another, and the edges among them."""
    nodes = s.symbols.orderBy("ord").limit(limit).withColumn("level", F.when(F.col("parentId").isNotNull(), 2).otherwise(1))
    return {"nodes": nodes, "edges": _induced(s, nodes)}


def flow_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(id) by in-degree, five layers at most."""
    into = edges.groupBy(F.col("toSymbolId").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(into, "id", "left").withColumn("layer", F.least(F.coalesce("n", F.lit(0).cast("long")), F.lit(4).cast("long"))).drop("n")


def focus(edges: DataFrame, node: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Edges of some kinds, and of one node; nodes without an edge left are those that no row names."""
    rows = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return rows if node is None else rows.where((F.col("fromSymbolId") == node) | (F.col("toSymbolId") == node))


def dependency_matrix(s: Snapshot, limit: int = 30) -> DataFrame:
    """(fromFile, toFile, n) among the first files by order, without a file's edges to itself; long form."""
    first = F.broadcast(s.files.orderBy("ord").limit(limit).select("path"))
    to = s.symbols.select(F.col("id").alias("toSymbolId"), F.col("filePath").alias("toFile"))
    rows = s.relations.join(to, "toSymbolId").where(F.col("filePath") != F.col("toFile")).join(first.withColumnRenamed("path", "filePath"), "filePath", "left_semi").join(first.withColumnRenamed("path", "toFile"), "toFile", "left_semi")
    return rows.groupBy(F.col("filePath").alias("fromFile"), "toFile").agg(F.count("*").alias("n"))


def matrix_totals(matrix: DataFrame) -> DataFrame:
    out = matrix.select(F.col("fromFile").alias("path"), F.col("n").alias("outgoing"), F.lit(0).cast("long").alias("incoming"))
    into = matrix.select(F.col("toFile").alias("path"), F.lit(0).cast("long").alias("outgoing"), F.col("n").alias("incoming"))
    return out.unionByName(into).groupBy("path").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))
