"""Stored layers, delta refreshes and stored indexes of text against whole runs and plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from srcgraph.api import Codebase
from srcgraph.operators import incremental, indexed, lookup, resolve, search
from srcgraph.operators.extract import with_order, with_order_among
from srcgraph.schema import SCHEMAS, Snapshot
from srcgraph.sources import store
from srcgraph.sources.postings import SubstringIndex


def files_below(path):
    return {os.path.join(f, n) for f, _, names in os.walk(path) for n in names if n.startswith("part-")}


def file_rows(spark, names, text="x"):
    rows = [(p, "python", f"h{text}", 1, 0.0, ["a"], 0) for p in names]
    return spark.createDataFrame(rows, SCHEMAS["files"])


def symbol_rows(spark, items):
    """(path, name)"""
    rows = [(f"{p}:{n}", p, n, "function", 1, 2, 0, 0, None, 0) for p, n in items]
    return spark.createDataFrame(rows, SCHEMAS["symbols"])


def test_one_changed_file_of_many_writes_one_bucket(spark, tmp_path):
    path = str(tmp_path / "index")
    names = [f"dir{k % 7}/f{k}.py" for k in range(10_000)]
    s = Snapshot.empty(spark).with_(files=file_rows(spark, names), symbols=symbol_rows(spark, [(p, "s") for p in names]))
    store.write(s, path, "u", buckets=16)
    before = files_below(path)
    assert len(before) == 32
    gone = spark.createDataFrame([(names[77],)], "path string")
    delta = store.Delta(gone={"files": gone, "symbols": gone.withColumnRenamed("path", "filePath")}, rows={"files": file_rows(spark, [names[77]], "y"), "symbols": symbol_rows(spark, [(names[77], "t")])})
    m = store.commit(spark, path, delta)
    fresh = files_below(path) - before
    assert before <= files_below(path) and len(fresh) == 4  # rows and replaced keys of two tables
    assert len({f.split("bucket=")[1].split("/")[0] for f in fresh}) == 1
    assert m["counts"]["files"] == 10_000 and m["counts"]["symbols"] == 10_000
    got = store.read(spark, path, "u")
    assert got.files.where("hash = 'hy'").count() == 1 and got.symbols.where("name = 't'").count() == 1 and got.files.count() == 10_000
    # A lookup of one path scans one bucket.
    one = store.rows_of(spark, path, "files", names[77])
    assert [r.hash for r in one.collect()] == ["hy"] and all("bucket=" in f for f in one.inputFiles()) and len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1


def test_versions_and_compaction(spark, tmp_path):
    path, r = str(tmp_path / "index"), random.Random(2)
    state = {f"f{k}": "0" for k in range(60)}
    make = lambda d: spark.createDataFrame([(p, "py", h, 1, 0.0, [], 0) for p, h in d.items()], SCHEMAS["files"])
    store.write(Snapshot.empty(spark).with_(files=make(state)), path, "u", buckets=4)
    read = lambda: {x.path: x.hash for x in store.read(spark, path, "u").files.collect()}
    for turn in range(1, 5):
        changed = {r.choice(sorted(state)): str(turn) for _ in range(3)} | {f"n{turn}": str(turn)}
        deleted = r.choice(sorted(set(state) - set(changed)))
        keys = spark.createDataFrame([(k,) for k in [*changed, deleted]], "path string")
        store.commit(spark, path, store.Delta(gone={"files": keys}, rows={"files": make(changed)}), fan=3)
        state = {**state, **changed}
        del state[deleted]
        assert read() == state
        m = store.manifest(path)
        assert m["counts"]["files"] == len(state) and max(store._Layers(spark, path, m).depths("files").values()) <= 3
    m = store.compact(spark, path)
    assert set(store._Layers(spark, path, m).depths("files").values()) == {1} and read() == state
    store.vacuum(spark, path, keep=1)
    assert read() == state and len([n for n in os.listdir(path) if n.startswith("v-")]) == 1
    used = {layer["name"] for layer in m["layers"]}
    assert set(os.listdir(f"{path}/layers")) < used  # layers of which nothing counts are gone
    # A file that changes behind the manifest's back is noticed.
    part = next(f for f in files_below(f"{path}/layers/{m['layers'][-1]['name']}"))
    os.remove(part)
    with pytest.raises(store.StoredIndexError):
        store.read(spark, path, "u")


def test_a_run_that_was_overtaken_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    store.write(Snapshot.empty(spark).with_(files=file_rows(spark, ["a"])), path, "u")
    first = store._layer
    one = spark.createDataFrame([("a",)], "path string")

    def slow(*args):
        monkeypatch.setattr(store, "_layer", first)
        store.commit(spark, path, store.Delta(gone={"files": one}))
        return first(*args)

    monkeypatch.setattr(store, "_layer", slow)
    with pytest.raises(store.StoredIndexError, match="conflict"):
        store.commit(spark, path, store.Delta(rows={"files": file_rows(spark, ["b"])}))
    assert store.read(spark, path, "u").files.count() == 0


# Refresh by delta

WORDS = ["alpha", "beta", "gamma", "delta", "eps"]


def sources(r, old=None):
    """Some Python and TypeScript files that call, extend and import each other by few names."""
    out = dict(old or {})
    for name in [f"src/{w}.{e}" for w in WORDS for e in ("py", "ts")]:
        if old is not None and r.random() < 0.6:
            continue
        if r.random() < 0.2:
            out.pop(name, None)
            continue
        a, b, c = (r.choice(WORDS) for _ in range(3))
        if name.endswith("py"):
            out[name] = f"import {a}\nclass {b.title()}({c.title()}):\n    def {a}(self):\n        return {c}({r.random()})\n"
        else:
            out[name] = f"import {{ {a} }} from './{b}.js'\nexport function {c}() {{ return {a}() + {r.random()} }}\nexport class {b.title()} extends {c.title()} {{ m() {{ return {b}() }} }}\n"
    return out


def scanned(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    language = F.when(F.col("path").endswith("py"), "python").otherwise("typescript")
    return rows.select("path", F.lit("accepted").alias("status"), language.alias("language"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.length("text").cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), "text")


def contents(s):
    return {n: sorted(str({k: v for k, v in r.asDict().items() if k != "ord"}) for r in df.collect()) for n, df in s.tables().items() if n != "metadata"}


def paths_in_order(s):
    return [r.path for r in s.files.orderBy("ord").collect()]


def staged(spark, tmp_path):
    count = iter(range(10_000))

    def stage(df, name):
        place = f"{tmp_path}/{next(count)}-{name}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    return stage


def test_delta_refresh_equals_a_whole_one(spark, tmp_path):
    r = random.Random(5)
    stage = staged(spark, tmp_path)
    texts = sources(r)
    whole = incremental.refresh(Snapshot.empty(spark), scanned(spark, texts), stage=stage)[0]
    previous = with_order(whole.with_(relations=stage(whole.relations, "relations")), stage)
    vectors = previous.chunks.select(F.col("id").alias("chunkId"), F.col("hash").alias("chunkHash"), F.lit("p").alias("providerId"), F.lit(1).alias("dimensions"), F.array(F.lit(1.0)).alias("values"))
    previous = previous.with_(**{n: stage(df, n) for n, df in previous.with_(vectors=vectors).tables().items() if n != "metadata"})
    for _ in range(2):
        texts = sources(r, texts)
        want, changes = incremental.refresh(previous, scanned(spark, texts), stage=stage)
        delta, changed = incremental.refresh_delta(previous, scanned(spark, texts), stage)
        assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, changed.collect()))
        got = delta.apply(previous)
        assert contents(got) == contents(want)
        assert paths_in_order(got) == sorted(texts)
        previous = got.with_(**{n: stage(df, n) for n, df in got.tables().items() if n != "metadata"})


def test_only_edges_that_a_change_concerns_are_bound_anew(spark, tmp_path):
    """Of a thousand edges to names that stay none is rewritten; those to a name that went or came are."""
    stage = staged(spark, tmp_path)
    edge = lambda i, path, to, name: (i, "calls", path, None, to, name, 1, 0.7, 0)
    symbols = symbol_rows(spark, [("a.py", f"n{k}") for k in range(100)] + [("b.py", "lost"), ("c.py", "lost")])
    carried = spark.createDataFrame([edge(f"e{k}", "d.py", f"a.py:n{k % 100}", f"n{k % 100}") for k in range(1000)] + [edge("x", "d.py", "b.py:lost", "lost"), edge("y", "e.py", None, "came"), edge("z", "e.py", None, "never")], SCHEMAS["relations"])
    gone, added = symbols.where("filePath = 'b.py'"), symbol_rows(spark, [("b.py", "came")])
    now = symbols.where("filePath <> 'b.py'").unionByName(added)
    changed, _ = resolve.resolve_changed(carried, carried.limit(0), gone, added, now, stage)
    got = {r.id: (r.toSymbolId, r.confidence) for r in changed.collect()}
    assert got == {"x": ("c.py:lost", 0.72), "y": ("b.py:came", 0.72)}
    full = {r.id: (r.toSymbolId, r.confidence) for r in resolve.resolve_relations(carried, now).collect()}
    before = {r.id: (r.toSymbolId, r.confidence) for r in carried.collect()}
    assert {i: v for i, v in full.items() if v != before[i]} == got


def test_numbers_between_files_run_out(spark, monkeypatch):
    known = file_rows(spark, ["b", "d"]).withColumn("ord", F.when(F.col("path") == "b", 10 << 20).otherwise(13 << 20))
    fresh = lambda names: Snapshot.empty(spark).with_(files=file_rows(spark, names))
    got = {r.path: r.ord >> 20 for r in with_order_among(fresh(["c", "cc", "a", "e", "b"]), known).files.collect()}
    assert got["b"] == 10 and 10 < got["c"] < got["cc"] < 13 < got["e"] and 0 < got["a"] < 10
    assert with_order_among(fresh(["c1", "c2", "c3"]), known) is None
    assert [r.ord >> 20 for r in with_order_among(fresh(["q"]), known.limit(0)).files.collect()] == [1 << 16]


class Ones:
    id, dimensions = "ones", 1

    def embed_batch(self, texts):
        return [[1.0] for _ in texts]


def test_workspace_refreshes_share_files(spark, tmp_path):
    root = tmp_path / "ws"
    os.makedirs(root / "src")
    for name, text in sources(random.Random(1)).items():
        (root / name).write_text(text)
    c = Codebase(spark, str(root), index_path=str(tmp_path / "index"), provider=Ones())
    c.index()
    before, layers = files_below(c.index_path), len(c.status()["layers"])
    (root / "src" / "new.py").write_text("def alpha():\n    return beta()\n")
    assert c.index()["added"] == 1
    assert before <= files_below(c.index_path) and len(c.status()["layers"]) == layers + 1
    fresh = Codebase(spark, str(root), index_path=str(tmp_path / "other"), provider=Ones())
    fresh.index()
    assert contents(c.snapshot()) == contents(fresh.snapshot())
    assert c.snapshot().vectors.count() == c.snapshot().chunks.count()
    c.compact()
    assert contents(c.snapshot()) == contents(fresh.snapshot())
    # Indexes of text belong to a version.
    assert [r.id for r in c.text_indexes("names").find_symbols("LPH").collect()] == [r.id for r in lookup.find_symbols(c.snapshot(), "LPH").collect()]
    old = os.listdir(f"{c.index_path}/text")
    assert c.index()["added"] == 0
    assert c.text_indexes("names").find_symbols("LPH").count() > 0 and os.listdir(f"{c.index_path}/text") != old


# Indexes of text


def test_substrings(spark, tmp_path):
    r = random.Random(3)
    texts = ["".join(r.choice("abcÄß_. ") for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, "", "A", "İstanbul", "ab\x01c", "日本語の名前", "x" * 5000 + "needle"]
    other = [r.choice(["kind", None, "abc"]) for _ in texts]
    rows = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(zip(texts, other))], "id int, a string, b string").repartition(3)
    index = SubstringIndex.of(rows, str(tmp_path / "i"), F.col("a"), F.col("b"), block_bits=5)
    plain = lambda n: sorted(r.id for r in rows.where(lookup._any_contains(n, F.col("a"), F.col("b"))).collect())
    for needle in ("a", "ab", "abc", "ÄSS", "cÄ", "kind", "needle", "本語", "語の名", "zzz", "q", "b.a", "xxxx", "ck", "stanbul"):
        got = index.containing(needle)
        assert got.columns == ["id", "a", "b"]
        assert sorted(x.id for x in got.collect()) == plain(needle), needle
    assert index.containing("").count() == len(texts)
    assert index.containing("a\x01k").count() == 0
    nothing = SubstringIndex.of(rows.where("false"), str(tmp_path / "e"), F.col("a"))
    assert nothing.containing("abc").count() == nothing.containing("a").count() == 0


def read_by_scans(df, table):
    """Rows that the scans of a table gave, from the plan that ran."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and f"/{table}" in node.relation().location().rootPaths().mkString(","):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_lookup_reads_the_row_groups_of_its_grams(spark, tmp_path, monkeypatch):
    from srcgraph.sources import postings

    monkeypatch.setattr(postings, "ROW_GROUP", 1 << 14)
    rows = spark.range(20_000).select("id", F.concat(F.lit("name"), F.hex(F.xxhash64("id"))).alias("t"))
    index = SubstringIndex.of(rows, str(tmp_path / "i"), F.col("t"), block_bits=10)
    needle = rows.where("id = 4321").first().t[6:14]
    found = index.candidates(needle.lower())
    assert "PushedFilters: [In(key" in found._jdf.queryExecution().toString().replace("PushedFilters: [IsNotNull(key), ", "PushedFilters: [")
    n = index._table("postings").count()
    assert 0 < read_by_scans(found, "postings") < n / 4
    hits = index.containing(needle)
    assert [r.id for r in hits.collect()] == [4321]
    assert read_by_scans(hits, "rows") < 20_000 / 4  # only the candidates' blocks


def test_an_index_grows_with_the_texts(spark, tmp_path):
    """Grams of long texts in linear time; what is shuffled is packed lists, not a row for each gram of each row."""
    import time

    words = " ".join(f"w{i}" for i in range(100_000))
    rows = spark.range(8).select("id", F.concat(F.lit(words), F.lit(" row"), "id").alias("t"))
    began = time.monotonic()
    index = SubstringIndex.of(rows, str(tmp_path / "i"), F.col("t"))
    assert time.monotonic() - began < 60
    assert [r.id for r in index.containing("W99999 row5").collect()] == [5] and index.containing("w99999 row").count() == 8
    same = spark.range(100_000).select("id", F.lit("always the same").alias("t"))
    packed = SubstringIndex.of(same.repartition(2), str(tmp_path / "s"), F.col("t"), block_bits=16)
    assert packed.frequencies(["alw"]) == {"alw": 100_000} and packed.containing("the same").count() == 100_000
    assert packed._table("postings").agg(F.sum(F.length("rows"))).first()[0] < 15 * 4096


def test_search_over_stored_indexes(spark, tmp_path):
    files = spark.createDataFrame([("src/login.py", "python", "h", 1, 0.0, ["Login", "user", "login"], 1), ("doc/user.md", "markdown", "h", 1, 0.0, ["guide"], 2), ("x.py", "python", "h", 1, 0.0, [], 3)], SCHEMAS["files"])
    s = Snapshot.empty(spark).with_(files=files, symbols=symbol_rows(spark, [("src/login.py", "loginUser"), ("x.py", "user"), ("x.py", "UserLogin"), ("lost.py", "user")]))
    built = indexed.TextIndexes.build(s, str(tmp_path / "t"))
    for q in ("login user", "user", "USER guide nothing", "", "e"):
        assert [tuple(r) for r in built.search(q, 10).collect()] == [tuple(r) for r in search.search(s, q, 10).collect()], q
    assert built.document_frequencies(["login", "guide", "none"]) == {"login": 1, "guide": 1}
    assert [r.path for r in built.filter_files("login", "python").collect()] == ["src/login.py"]
    assert sorted(r.id for r in built.filter_symbols("x.p").collect()) == sorted(r.id for r in lookup.filter_symbols(s, "x.p").collect())
    assert built.filter_references("user").count() == 0


@pytest.mark.parametrize("names", [0, 200_000])
def test_links_of_tests_either_way(spark, monkeypatch, names):
    from srcgraph.operators import reports

    monkeypatch.setattr(reports, "AUTOMATON_NAMES", names)
    items = [("tests/a.py", "test_login_user"), ("tests/a.py", "testLOGIN"), ("lib.py", "login"), ("lib.py", "Login"), ("lib.py", "user"), ("tests/b.go", "nothing"), ("lib.py", ""), ("tests/c.rs", "login")]
    rows = [(f"{i}", p, n, "function", 1, 2, 0, 0, None, i) for i, (p, n) in enumerate(items)]
    got = {(r.testFile, r.testSymbol): r.targetSymbol for r in reports.test_links(Snapshot.empty(spark).with_(symbols=spark.createDataFrame(rows, SCHEMAS["symbols"]))).collect()}
    assert got == {("tests/a.py", "test_login_user"): "login", ("tests/a.py", "testLOGIN"): "login", ("tests/b.go", "nothing"): "", ("tests/c.rs", "login"): "Login"}
