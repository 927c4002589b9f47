"""Queries over tables in which what counts lies beyond the first rows and characters."""

import os
import re

import pytest

from srcgraph.plans import queries as q

TERM = re.compile(r"[\w$.\-]+")
TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", []),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(1, "a", "B#1", "T", 1)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "s", 0)]),
    "nation": ("n_nationkey int, n_name string", [(0, "N")]),
    "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_discount double", [(1, 1, 1, 1, "A", 0.1)]),
    "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
    "conversations": ("conv_id long, turn int, text string", [(0, 0, "x")]),
    "embeddings": ("vec_id long, label string, embedding array<float>", [(0, "x", [1.0])]),
}


def write(spark, folder, **rows):
    for name, (schema, some) in TABLES.items():
        spark.createDataFrame(rows.get(name, some), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(n=60):
    """Texts of few of the terms asked for, but for those with the highest identifiers."""
    texts = [f"word{i} plain\nthe line {i}\nothers" for i in range(n)]
    for k in range(6):
        texts[n - 1 - k] = "\n".join([f"onthe tion the {k} " + "x" * 90 * k, "filler " * 40, f"tion of {k} the", "the", "onthe"] * (k + 1))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]


def test_context_pack_chooses_among_all_documents(spark, tmp_path):
    rows, asked = documents(), ["the", "onthe", "tion"]
    paths = {f"{s}/{lang}/doc{i}.md": (i, t) for i, t, lang, s, _ in rows}
    score = lambda path, text: sum(2 * (w in set(TERM.findall(text.lower()))) + (w in path) for w in asked)
    best = sorted(paths, key=lambda p: (-score(p, paths[p][1]), p))[:4]
    chunks = [(-sum(w in line for w in asked), n + 1, paths[p][0] * 100_000 + n, p, -(-len(line) // 4)) for p in best for n, line in enumerate(paths[p][1].split("\n"))]
    used, want = 0, []
    for s, line, _, path, cost in sorted(chunks):
        if used + cost <= 900:
            used += cost
            want.append((path, line, cost, -s))
    got = q.context_pack(spark, write(spark, tmp_path / "t", documents=rows)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and all(paths[r.filePath][0] >= 30 for r in got) and len(want) < len(chunks)


def test_config_doc_detect_takes_names_of_all_documents(spark, tmp_path):
    rows = [(i, f"zzzz{i:03d} common" + (f" aaaa{i}" if i > 40 else ""), "en", "s", 1) for i in range(60)]
    got = {r.title: r.links for r in q.config_doc_detect(spark, write(spark, tmp_path / "t", documents=rows)).collect()}
    names = sorted({w for _, t, *_ in rows for w in TERM.findall(t) if len(w) > 3})[:100]
    assert got == {f"doc{i}": "|".join([w for w in names if w in t.split()][:5]) for i, t, *_ in rows} and got["doc50"] == "aaaa50|common|zzzz050"


def test_query_intent_reads_whole_texts(spark, tmp_path):
    tails = {0: ("Who Calls run", "caller"), 11: ("the pytest run", "test"), 22: ("nothing", "symbol"), 33: ("an endpoint", "api"), 44: ("commit", "history")}
    rows = [(i, 0, "lorem " * 300 + tail) for i, (tail, _) in tails.items()] + [(55, 0, None), (66, 0, "  ")]
    got = {r.conv_id: r.kind for r in q.query_intent(spark, write(spark, tmp_path / "t", conversations=rows)).collect()}
    assert got == {i: kind for i, (_, kind) in tails.items()} | {55: "semantic", 66: "semantic"}


def test_symbol_link_takes_all_symbols(spark, tmp_path):
    parts = [(i, name, "B#1", "T", 1) for i, name in enumerate(["red widget", "Red", "old asia red widget", "blue", "get", "old asia red widget", "x03", "", "RED"], 1)]
    suppliers = [(k, f"Supplier#{k:09d}", 0) for k in (3, 9, 12, 120)]
    names = [(f"P{k}", n, k) for k, n, *_ in parts] + [(f"S{k}", n, 100_000_000 + k) for k, n, _ in suppliers]
    others = {}
    for n, ord_ in [(n, o) for _, n, o in names] + [("ASIA", 0)] + [(n[-2:], 50 + k) for k, n, _ in suppliers]:
        others[n] = min(ord_, others.get(n, ord_))
    first = lambda n: min(((o, x) for x, o in others.items() if x != n and x.lower() in n.lower()), default=(0, None))[1]
    got = q.test_symbol_link(spark, write(spark, tmp_path / "t", part=parts, supplier=suppliers)).collect()
    assert {r.id: (r.testSymbol, r.targetSymbol) for r in got} == {i: (n, first(n)) for i, n, _ in names} and len(got) == len(names)


@pytest.mark.parametrize("name", ["architecture_edges", "shortest_path", "refresh_edges", "extract_symbols", "workspace_scan"])
def test_queries_agree_with_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    import __spark_entry__

    con = duckdb.connect()
    for path in os.listdir(folder):
        con.sql(f"CREATE VIEW {path[:-8]} AS SELECT * FROM '{folder}/{path}'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    want = sorted((tuple(row[rel.columns.index(c)] for c in sorted(rel.columns)) for row in rel.fetchall()), key=repr)
    df = __spark_entry__.queries()[name](spark, folder)
    assert sorted((tuple(row[c] for c in sorted(df.columns)) for row in df.collect()), key=repr) == want and want


def test_extraction_is_dealt_and_broadcasts_no_symbols(spark):
    """Few parts lie in one row group, but their files are parsed by all tasks, and parents of symbols meet them in a merge join."""
    from srcgraph.plans import coverage

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    assert coverage._sources(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = coverage.extract_symbols(spark, folder)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_imports_that_mean_no_file_are_spread(spark):
    """An import of an outside package has no base to look up; each is looked for under a key of its own, not all under null."""
    from pyspark.sql import functions as F

    from srcgraph.operators import architecture

    rows = spark.createDataFrame([(f"d{i}", "react", None, False) for i in range(50)] + [("d", "./a", "d/a", True)], "dir string, target string, base string, relative boolean")
    asked = rows.select("base", F.explode(architecture._looked_up("base", F.col("relative"), "dir", "target")).alias("m")).select("base", "m.*").collect()
    keys = [(r.way, r.key) for r in asked]
    assert len(set(keys)) == len(keys) == 52 and all(k is not None for _, k in keys)
    assert {r.way for r in asked if r.base is None} == {"none"}


def test_search_levels_read_written_edges(spark, monkeypatch):
    """A search reads its edges level by level, so imports are bound and pairs of order lines told apart once, before the first."""
    from srcgraph.operators import graph
    from srcgraph.plans import coverage

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    seen, bfs = [], graph.bfs
    monkeypatch.setattr(graph, "bfs", lambda edges, *args, **options: seen.append(plan(edges)) or bfs(edges, *args, **options))
    coverage.change_impact_imports(spark, folder)
    assert seen and "Join" not in seen[0] and "Aggregate" not in seen[0]
    read = []
    monkeypatch.setattr(graph, "symbol_path", lambda s, *args: read.append(plan(s.relations)) or {"nodes": ["x"]})
    coverage.shortest_path(spark, folder)
    assert len(read) == 3 and len(set(read)) == 1 and "Aggregate" not in read[0]


def test_buckets_are_written_unsorted(spark, tmp_path):
    """Rows go to their buckets' files as they come: sorting whole texts by bucket first spills all of them."""
    from srcgraph.schema import SCHEMAS
    from srcgraph.sources import store

    rows = spark.createDataFrame([(f"f{i}", "markdown", "h", i, 0.0, ["a"], i) for i in range(100)], SCHEMAS["files"])
    put = store._put(rows, "files", f"file://{tmp_path}/rows", 4)
    assert put["n"] == 100 and put["buckets"] == [0, 1, 2, 3] and len(list(tmp_path.glob("rows/bucket=*/*.parquet"))) == 4
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    plan = next(p for p in reversed(plans) if f"{tmp_path}/rows" in p)
    assert "Exchange" in plan and "Sort" not in plan


def test_scan_hands_on_texts_by_size(spark, tmp_path, monkeypatch):
    """A batch of paths isn't held with all its texts: what has been read goes on after some megabytes."""
    import pandas as pd

    from srcgraph.sources import scan

    for i in range(6):
        (tmp_path / f"f{i}.md").write_text(str(i) * (3 << 20))
    seen, kind = [], type(spark.range(1))
    given = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema: seen.append(f) or given(self, f, schema))
    scan.scan(spark, str(tmp_path))
    frame = pd.DataFrame({"path": [f"f{i}.md" for i in range(6)], "status": "accepted", "size": 3 << 20, "modifiedAt": 0.0})
    parts = list(seen[-1]([frame]))
    assert len(parts) > 2 and max(p["size"].sum() for p in parts) <= 2 * scan.READ_BYTES
    assert [t[0] for p in parts for t in p["text"]] == list("012345") and [p for x in parts for p in x["path"]] == list(frame["path"])


def test_imports_are_bound_without_hash_tables_of_all_files(spark, monkeypatch):
    """Neither parts' keys nor the names of files are held whole by a task: they are merged, in tasks of a bounded size."""
    duckdb = pytest.importorskip("duckdb")
    from srcgraph.operators import architecture, graph
    from srcgraph.plans import coverage

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    seen, cut, key = [], architecture._cut, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    monkeypatch.setattr(architecture, "_cut", lambda df: seen.append((spark.conf.get(key), df._jdf.queryExecution().executedPlan().toString())) or cut(df))
    got = sorted(map(tuple, coverage.unresolved_imports(spark, folder).collect()))
    assert len(seen) == 2 and all(size == architecture.TASK_BYTES and "ShuffledHashJoin" not in plan for size, plan in seen)
    assert "SortMergeJoin [l_partkey" in seen[1][1] and "BroadcastHashJoin [l_" not in seen[1][1] and spark.conf.get(key, None) == before
    con = duckdb.connect()
    for path in os.listdir(folder):
        con.sql(f"CREATE VIEW {path[:-8]} AS SELECT * FROM '{folder}/{path}'")
    assert got == sorted(con.sql(coverage.SQL["unresolved_imports"]).fetchall()) and got


def test_files_of_a_scan_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """Rows of paths are few bytes, but the files behind them are read by as many tasks as there are; the driver judges folders alone."""
    from pyspark.sql import functions as F

    from srcgraph.sources import scan

    for i in range(200):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}/f{i}.md").write_text(f"text {i}")
    (tmp_path / "d0/late.dat").write_bytes(b"a" * scan.SNIFF_BYTES + b"\0")
    (tmp_path / "d1/bin.dat").write_bytes(b"a\0b")
    rows = scan.scan(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) >= spark.sparkContext.defaultParallelism
    got = {r.path: (r.status, r.size, r.text) for r in rows}
    assert len(got) == 202 and got["d1/f7.md"] == ("accepted", 6, "text 7") and got["d1/bin.dat"] == ("skipped-binary", 3, None) and got["d0/late.dat"][0] == "accepted"
    judged, ignores = [], scan.IgnoreMatcher.ignores
    monkeypatch.setattr(scan.IgnoreMatcher, "ignores", lambda self, path, *args, **options: judged.append(path) or ignores(self, path, *args, **options))
    scan.WorkspaceReader({"path": str(tmp_path), "folders": "500"}).partitions()
    assert judged == ["d0", "d1"]
