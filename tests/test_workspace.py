"""Workspaces end to end: scans, extraction, storage, refresh, and the questions asked of an index."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from srcgraph import cli
from srcgraph.api import Codebase
from srcgraph.operators import embeddings, reports
from srcgraph.operators.extract import parse, text_chunks
from srcgraph.sources import scan, store


def put(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def code(spark, tmp_path, files, **options):
    put(str(tmp_path / "ws"), **files)
    c = Codebase(spark, str(tmp_path / "ws"), str(tmp_path / "idx"), **options)
    return c, c.index()


def test_incremental(spark, tmp_path):
    files = {"a.ts": "export function run() { return helper() }\nfunction helper() { return 1 }\n", "b.py": "x = 1\n"}
    c, first = code(spark, tmp_path, files)
    assert first == {"added": 2, "changed": 0, "deleted": 0, "unchanged": 0}
    assert c.index()["unchanged"] == 2
    put(c.root, **{"a.ts": files["a.ts"].replace("return 1", "return 2"), "c.go": "package gopher\nfunc Dig() {}\n"})
    os.remove(os.path.join(c.root, "b.py"))
    assert c.index() == {"added": 1, "changed": 1, "deleted": 1, "unchanged": 0}
    assert [r.path for r in c.files().orderBy("ord").collect()] == ["a.ts", "c.go"]
    assert c.find_callers("helper").count() == 1 and c.find_callees("run").count() == 1
    assert c.find_references("helper").count() == 1
    assert c.search("gopher").first().path == "c.go"
    assert c.snapshot().chunks.count() >= 2
    assert c.stats()["fileCount"] == 2 and c.status()["exists"]
    assert c.index(force=True)["added"] == 2
    assert c.remove() and not c.status()["exists"]


GRAPH = {
    "src/services/auth.ts": "import { getUser } from './db'\nexport function login(name) { return check(getUser(name)) }\nfunction check(u) { return u }\n",
    "src/services/db.ts": "export function getUser(name) { return { name } }\n",
    "tests/auth.test.ts": "import { login } from '../src/services/auth'\nlogin('x')\n",
    "package.json": '{"name": "app"}',
    ".env.sample": "API_KEY=abcdef\n\n",
    "server.js": "function boot() {}\napp.get('/health', boot)\nrouter.post(\"/x\", boot)\n",
}


@pytest.fixture(scope="module")
def graphed(spark, tmp_path_factory):
    return code(spark, tmp_path_factory.mktemp("graph"), GRAPH)[0]


def test_context_and_dependencies(graphed):
    got = graphed.context("login", max_files=4, max_tokens=2000)
    assert "src/services/db.ts" in {r.path for r in got["files"].collect()} and 0 < got["estimatedTokens"] <= 2000
    deps = graphed.find_dependencies("src/services/auth.ts").collect()
    assert any(r.kind == "imports" for r in deps) and any(r.kind == "calls" and r.toSymbolId for r in deps)
    assert any(r.kind == "imports" for r in graphed.find_dependents("src/services/db.ts").collect())
    assert graphed.find_dependencies("auth", depth=0).count() == 0


def test_impact_and_path(graphed):
    assert "src/services/auth.ts" in {r.filePath for r in graphed.change_impact("getUser")["affectedFiles"].collect()}
    got = graphed.change_impact("src/services/auth.ts")
    assert "tests/auth.test.ts" in {r.filePath for r in got["affectedFiles"].collect()} and got["risk"] in ("low", "high")
    path = graphed.path("login", "getUser")
    assert path["depth"] >= 1 and path["nodes"][0] == "login" and path["nodes"][-1] == "getUser"
    assert graphed.path("login", "nothing") == {"nodes": ["login", "nothing"], "edges": [], "depth": 0}
    assert graphed.change_impact("nowhere")["risk"] == "unknown"


def test_texts_and_intent(graphed):
    assert graphed.classify("Who calls getUser?")["kind"] == "caller" and graphed.classify("  ")["confidence"] == 0.2
    assert graphed.classify("éapi")["kind"] == "api"
    env = [r for r in graphed.sensitive_regions().collect() if r.filePath == ".env.sample"]
    assert len(env) == 3 * 3 and {r.confidence for r in env} == {0.9}
    assert "API_KEY=[redacted]" in {r.snippet for r in env} and "sensitive configuration value" in {r.snippet for r in env}
    ends = [(r.method, r.path, r.symbolId) for r in graphed.api_endpoints().collect() if r.filePath == "server.js"]
    assert sorted(ends) == [("GET", "/health", "boot"), ("POST", "/x", "boot"), ("POST", "/x", "boot")]
    assert graphed.read_file("package.json").startswith("{")
    with pytest.raises(PermissionError):
        graphed.read_file("../secret")
    assert graphed.health().first().asDict() == {"brokenReferences": 0, "missingFiles": 0}


def test_views(graphed):
    for name in ("repository_map", "matrix", "cycles", "duplicates", "database_models", "tests", "configs", "docs", "modules", "module_edges", "folders", "export_csv", "export_json", "relation_kinds"):
        getattr(graphed, name)().collect()
    assert {r.kind for r in graphed.repository_map().collect() if r.path == "tests/auth.test.ts"} == {"test"}
    assert not graphed.relation_graph(80)["truncated"] and graphed.relation_graph(1)["truncated"]
    assert graphed.radial("login").count() >= 1 and graphed.flow()["nodes"].count() == graphed.symbols().count()
    assert graphed.complexity()["totals"].first().files == len(GRAPH)
    page = graphed.chunk_page(limit=2)
    assert page["nextOffset"] == 2 and page["chunks"].count() == 2
    assert graphed.symbol_relations("login").count() > 0 and graphed.call_graph("login").count() >= 2


def test_stale_edges_follow_renames(spark, tmp_path):
    c, _ = code(spark, tmp_path, {"p.ts": "export function old() { return 1 }\n", "c.ts": "export function use() { return old() }\n"})
    edge = lambda: c.relations().where("kind = 'calls'").first()
    assert edge().toSymbolId and edge().confidence == 0.72
    put(c.root, **{"p.ts": "export function fresh() { return 1 }\n"})
    c.index()
    assert edge().toSymbolId is None and edge().confidence <= 0.5
    put(c.root, **{"c.ts": "export function use() { return fresh() }\n"})
    c.index()
    assert edge().toSymbolId == c.find_symbols("fresh").first().id


def test_architecture(spark, tmp_path):
    from srcgraph.operators.architecture import cycles

    c, _ = code(spark, tmp_path, {
        "src/alpha.ts": "import { b } from './beta.js'\nexport const a = 1\n", "src/beta.ts": "import { a } from './alpha'\nexport const b = 2\n", "src/entry.ts": "import '@/alpha'\nimport lib from 'lib'\nimport React from 'react'\nimport x from './gone'\nimport y from '@/gone'\n",
        "tsconfig.json": '{\n// paths\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}', "packages/lib/package.json": '{"name": "lib", "main": "main.js"}', "packages/lib/main.js": "function m() {}\n",
    })
    got = c.architecture()
    assert {(r["from"], r.to) for r in got["edges"].collect()} == {("src/alpha.ts", "src/beta.ts"), ("src/beta.ts", "src/alpha.ts"), ("src/entry.ts", "src/alpha.ts"), ("src/entry.ts", "packages/lib/main.js")}
    assert [r.files for r in cycles(got["edges"]).collect()] == [["src/alpha.ts", "src/beta.ts"]]
    assert [r.path for r in got["entryCandidates"].collect()] == ["src/entry.ts"] and got["mostDependedOn"].first().path == "src/alpha.ts"
    assert [(r.alias, r.target, r.files) for r in got["resolvedAliases"].collect()] == [("@/*", "src/alpha", 1)]
    assert [r.name for r in got["workspacePackages"].collect()] == ["lib"] and [r.name for r in got["externalPackages"].collect()] == ["react"]
    assert [r.target for r in got["unresolvedRelativeImports"].collect()] == ["./gone"] and [r.target for r in got["unresolvedAliasImports"].collect()] == ["@/gone"]


def test_imports_are_bound_like_a_search_of_candidates(spark):
    import itertools
    import posixpath

    from srcgraph.operators import architecture as a
    from srcgraph.schema import Snapshot

    ends = [".ts", ".tsx", ".js", ".d.ts", "", ".md", "/index.ts", "/index.jsx", ".test.ts"]
    paths = [f"{d}{n}{e}" for i, (d, n, e) in enumerate(itertools.product(["", "p/", "p/q/"], ["a", "b", "index"], ends)) if i % 3]
    targets = [f"{d}{n}{e}" for d, n, e in itertools.product(["./", "../", "@/", "own/", "other/"], ["a", "b", "index", "q"], ["", ".js", ".jsx", ".ts", ".mjs", ".test"])] + ["own", "other", " ./a ", "", ".", "..", None]
    rows = [(f"{p}/x.ts", t, n) for n, (p, t) in enumerate(itertools.product(["p", "p/q"], targets))]
    s = Snapshot.empty(spark)
    s = s.with_(files=spark.createDataFrame([(p,) for p in paths], "path string"), relations=spark.createDataFrame([("imports", *r) for r in rows], "kind string, filePath string, targetName string, line int"))
    packages = spark.createDataFrame([("own", "p", ["p/a.ts"]), ("own", "p/q", ["p/q/a.tsx"]), ("other", "", [])], "name string, root string, entryPoints array<string>")
    config = {"baseUrl": ".", "paths": {"@/*": ["p/*", "gone/*"], "@/a*": ["p/q/b*"], "other/b": ["b"]}}

    def look(base, scripts):
        stem, ext = posixpath.splitext(base)
        more = [base + e for e in a.EXTENSIONS] + [f"{base}/index{e}" for e in a.EXTENSIONS] if not ext else [stem + e for e in a.TYPED] if scripts and ext in a.SCRIPTS else []
        return next((c for c in [base, *more] if c in paths), None)

    join = lambda *xs: "" if posixpath.normpath("/".join(x for x in xs if x)) == "." else posixpath.normpath("/".join(x for x in xs if x))
    want = {}
    for path, raw, n in rows:
        if raw is None:
            continue
        t, folder = raw.strip(), posixpath.dirname(path)
        if t.startswith("."):
            want[n] = look(join(folder, t), True)
            continue
        mapped = ["p/q/b" + t[3:]] if t.startswith("@/a") else []
        mapped += ["p/" + t[2:], "gone/" + t[2:]] if t.startswith("@/") else ["b"] if t == "other/b" else []
        hits = [look(join(start, m), False) for m in mapped for start in (".", folder)]
        name, _, rest = t.partition("/")
        root, entries = {"own": ("p/q", ["p/q/a.tsx"]), "other": ("", [])}.get(name, ("", []))
        if name in ("own", "other"):
            hits.append(look(join(root, rest), False) if rest else next(iter(entries), None))
        want[n] = next((h for h in hits if h), None)
    got = a.bind_imports(s, config, packages).collect()
    assert {r.line: r.to for r in got} == want and len(got) == len(want) and len(set(want.values())) > 15
    assert {r.target for r in got if r.shaped} == {t for t in targets if t and (t.startswith("@/") or t == "other/b")}


def test_ambiguous_names(spark, tmp_path):
    same = "export function build() { return 1 }\n"
    c, _ = code(spark, tmp_path, {"a/x.ts": same, "b/x.ts": same, "a/user.ts": "import { build } from './x'\nexport function use() { return build() }\n", "a/facade.ts": "import { use } from './user'\nexport const f = use\n", "a/facade.test.ts": "import { f } from './facade'\n"})
    got = c.change_impact("build")
    assert got["ambiguous"] and got["matchedSymbols"].count() == 2 and any("2 symbols share" in x for x in got["caveats"])
    got = c.change_impact("a/x.ts")
    depth = {r.filePath: r.depth for r in got["affectedFiles"].collect()}
    assert not got["ambiguous"] and depth["a/user.ts"] == 1 and depth["a/facade.ts"] == 2 and depth["a/facade.test.ts"] == 3


def test_scanner(spark, tmp_path):
    put(str(tmp_path), **{".gitignore": "*.log\n/sub/\n", "src/main.ts": "let a", "src/.gitignore": "*.ts\n!keep.ts\n!main.ts\n", "src/keep.ts": "x", "src/drop.ts": "x", "a.log": "x", "node_modules/m.js": "x", "bin.dat": b"a\0b", "big.ts": "x" * 60, "sub/x.ts": "y"})
    rows = {r.path: r for r in scan.scan(spark, str(tmp_path), max_file_size=40).collect()}
    assert sorted(p for p, r in rows.items() if r.status == "accepted") == [".gitignore", "src/.gitignore", "src/keep.ts", "src/main.ts"]
    assert rows["src/main.ts"].language == "typescript" and len(rows["src/main.ts"].hash) == 64
    assert rows["bin.dat"].status == "skipped-binary" and rows["big.ts"].status == "skipped-large-file" and rows["node_modules"].status == rows["sub"].status == "ignored"
    m = scan.IgnoreMatcher(["a/**/b", "!*.keep", "x?z", "d[0-9]"])
    assert m.ignores("a/q/r/b") and m.ignores("p/xyz") and m.ignores("d7") and not m.ignores("dx") and m.ignores("dist/x.keep")


SNIPPET = """import { Token } from './token.js'
const LIMIT = 3
export class Parser extends Base implements Reader<Thing> {
  parse(input: string) { const t = next(input); return t + LIMIT }
}
"""


def test_parser():
    got = parse("p.ts", SNIPPET, "typescript")
    kinds = {(s[3], s[2]) for s in got.symbols}
    assert ("class", "Parser") in kinds and ("method", "parse") in kinds and ("constant", "LIMIT") in kinds
    edges = {(r[1], r[5]) for r in got.relations}
    assert {("imports", "./token.js"), ("calls", "next"), ("exports", "Parser"), ("extends", "Base"), ("implements", "Reader"), ("contains", "parse"), ("references", "LIMIT")} <= edges
    assert any(c[6].startswith("export class Parser") and c[6].rstrip().endswith("}") for c in got.chunks)
    py = parse("p.py", "import os\nclass A(B):\n    def m(self):\n        return f(os)\n", "python")
    assert {("class", "A"), ("method", "m")} == {(s[3], s[2]) for s in py.symbols}
    assert {("imports", "os"), ("extends", "B"), ("calls", "f"), ("references", "os"), ("contains", "m")} <= {(r[1], r[5]) for r in py.relations}
    assert parse("x.py", "def (", "python").error and parse("x.md", "# a", "markdown") is None
    for k in range(40):
        assert any(s[2] == f"fn{k}" for s in parse(f"{k}.js", f"function fn{k}(a) {{ return `x${{a}}` }}", "javascript").symbols)
    for language, text, name in (("go", "package p\nfunc (r *T) Dig() int { return 1 }", "Dig"), ("rust", "pub struct Point { x: i32 }\nimpl Point { fn new() -> Point { Point{} } }", "Point"), ("java", "public class Main { public void run() { go(); } }", "run")):
        assert any(s[2] == name for s in parse("f", text, language).symbols), language


def test_text_chunks():
    ends = [(c[3], c[4]) for c in text_chunks("a.md", "\n".join(f"l{i}" for i in range(101)))]
    assert ends == [(1, 100), (101, 101)]
    assert len(text_chunks("a", "x" * 2000 + "\n" + "y" * 2001)) == 2 and len(text_chunks("a", "x" * 2000 + "\n" + "y" * 1999)) == 1
    assert [c[6] for c in text_chunks("a", "a\n# H\nb\n\n\nc\r\nd")] == ["a", "# H\nb", "c\nd"]
    assert text_chunks("a", " \n ") == []


def test_store_rejects_what_is_wrong(spark, tmp_path):
    c, _ = code(spark, tmp_path, {"a.py": "def f():\n    return 1\n"})
    assert store.read(spark, c.index_path, c.uid).files.count() == 1
    with pytest.raises(store.StoredIndexError, match="uid"):
        store.read(spark, c.index_path, "other")
    with pytest.raises(store.StoredIndexError, match="uid"):
        store.write(c.snapshot(), c.index_path, "x" * 70_000)
    assert store.read(spark, c.index_path, c.uid).files.count() == 1
    path = os.path.join(c.index_path, store._current(c.index_path), "manifest.json")
    m = json.load(open(path))
    for change, reason in (({"formatVersion": 9}, "version"), ({"digests": {**m["digests"], "files": "1"}}, "checksum"), ({"counts": {**m["counts"], "files": 7}}, "count")):
        json.dump({**m, **change}, open(path, "w"))
        with pytest.raises(store.StoredIndexError, match=reason):
            store.read(spark, c.index_path, c.uid)
    json.dump(m, open(path, "w"))
    os.makedirs(tmp_path / "bad")
    good, manifests, bad = store.catalog(spark, str(tmp_path))
    assert list(good) == [c.uid] and len(manifests) == 1 and {b[0] for b in bad} == {"bad", "ws"}


class Marker:
    id, dimensions = "marker", 2

    def embed_batch(self, texts):
        return [[1.0, 0.0] if "zebra" in t else [0.0, 1.0] for t in texts]


def test_embeddings(spark, tmp_path):
    c, _ = code(spark, tmp_path, {"n.md": "# One\nplain\n# Two\na zebra\n"}, provider=Marker())
    top = c.semantic_search("zebra", 1).first()
    assert "zebra" in top.text and top.score == pytest.approx(1.0)
    assert c.hybrid_search("plain", 5).first().path == "n.md"
    assert embeddings.missing_vectors(c.snapshot(), "marker", 2).count() == 0
    assert c.generate_embeddings(embeddings.HashProvider(8)) == 2
    assert {(r.providerId, r.dimensions) for r in c.snapshot().vectors.collect()} == {("hash-8", 8)}
    seen = []
    list(embeddings.embed_queue(Marker(), ["a"] * 9, lambda n, total: seen.append((n, total))))
    assert seen == [(4, 9), (8, 9), (9, 9)]
    http = embeddings.HttpProvider("u", "m", 1, "q: ", post=lambda url, body: {"data": [{"index": i, "embedding": [len(x)]} for i, x in reversed(list(enumerate(body["input"])))]})
    assert http.embed_batch(["a", "bb"]) == [[4], [5]]
    with pytest.raises(ValueError):
        list(embeddings.embed_queue(type("Bad", (), {"dimensions": 3, "embed_batch": lambda s, t: [[1.0]] * len(t)})(), ["a"]))


def test_vectors_and_paths(spark):
    from srcgraph.functions.text import cosine, join_path, language, normalize_target, truncate_and_normalize

    row = spark.range(1).select(truncate_and_normalize(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2).alias("v"), cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("c"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert row.v == [0.6, 0.8] and row.c == -1 and row.z == 0
    with pytest.raises(Exception, match="fewer"):
        spark.range(1).select(truncate_and_normalize(F.array(F.lit(3.0)), 2)).collect()
    df = spark.createDataFrame([("a/b", "../c.ts"), ("a", "./x"), (".", "../y")], "d string, p string")
    assert [r[0] for r in df.select(join_path(F.col("d"), F.col("p"))).collect()] == ["a/c.ts", "a/x", "../y"]
    df = spark.createDataFrame([("'./a/b.ts'", "b"), ("npm:pkg/index", "pkg"), ("x?y", "x"), ('"//"', "//")], "t string, w string")
    assert all(r[0] == r.w for r in df.select(normalize_target(F.col("t")), "w").collect())
    df = spark.createDataFrame([("a/Dockerfile", "dockerfile"), ("x.TSX", "typescript"), ("go.sum", "go"), (".gitignore", "gitignore"), ("q.unknown", "text"), (".py", "text")], "p string, w string")
    assert all(r[0] == r.w for r in df.select(language(F.col("p")), "w").collect())


def test_partitions_and_labels(spark):
    files = spark.createDataFrame([(f"f{i:03}", 10) for i in range(251)], "path string, size long").repartition(7)
    assert [r["count"] for r in reports.pack_batches(files).groupBy("batch").count().orderBy("batch").collect()] == [100, 100, 51]
    rows = spark.createDataFrame([("g", "x"), (None, "repo · part 2 of 3"), (None, "repo")], "g string, l string")
    assert [r[0] for r in rows.select(reports.index_group(F.col("g"), F.col("l"))).collect()] == ["g", "repo", None]
    log = spark.createDataFrame([("h|a|d|s|t",)], "value string")
    assert reports.git_log(log).first().message == "s|t"


def test_search_over_indexes(spark, tmp_path):
    from srcgraph.operators.search import search_all

    one, _ = code(spark, tmp_path / "1", {"a.ts": "const zebra = 1\n"})
    two, _ = code(spark, tmp_path / "2", {"b.py": "zebra = 2\n"})
    both = {"1": one.snapshot(), "2": two.snapshot()}
    assert search_all(both, "zebra").count() == 2 and search_all(both, "zebra", limit=1).count() == 1
    assert [r.path for r in search_all(both, "zebra", language="python", per_index=True).collect()] == ["b.py"]
    assert store.union(both, "files").select("indexUid").distinct().count() == 2


def test_watcher(spark, tmp_path):
    from srcgraph.streaming.watch import Watcher

    c, _ = code(spark, tmp_path, {"a.py": "a = 1\n"})
    w = Watcher(c, 10)
    assert w.debounce_ms == 50 and w.tick() and not w.tick()
    put(c.root, **{"n/b.py": "b = 1\n", "n/.gitignore": "*.tmp\n", "n/x.tmp": "x"})
    assert w.tick() and {r.path for r in c.files().collect()} == {"a.py", "n/b.py", "n/.gitignore"}
    os.remove(os.path.join(c.root, "n/b.py"))
    put(c.root, **{"node_modules/q.js": "x"})
    assert w.tick() and "n/b.py" not in {r.path for r in c.files().collect()} and w.status()["lastError"] is None


def waited(done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.1)
    return done()


def test_writes_in_short_order_are_one_run(spark, tmp_path):
    from srcgraph.streaming.watch import Watcher

    put(str(tmp_path / "ws"), **{"a.py": "a = 1\n"})
    c = Codebase(spark, str(tmp_path / "ws"), index_path=str(tmp_path / "i"))
    seen = []
    c.index = lambda: seen.append({r[0] for r in c.listing()})
    w = Watcher(c, 3000).start()
    try:
        assert waited(lambda: w.runs == 1) and seen == [{"a.py"}]
        for k in range(3):
            put(c.root, **{f"b{k}.py": "b = 1\n"})
            time.sleep(0.3)
        assert waited(lambda: w.runs == 2)
        time.sleep(4)
        assert w.runs == 2 and seen[1] == {"a.py", "b0.py", "b1.py", "b2.py"}
        os.remove(os.path.join(c.root, "b1.py"))
        assert waited(lambda: w.runs == 3) and seen[2] == {"a.py", "b0.py", "b2.py"}
    finally:
        w.stop()
    assert not w.status()["watching"] and w.last_error is None


def test_debounce_counts_from_the_last_change(tmp_path):
    """The state function alone, with a clock of its own."""
    from srcgraph.streaming import watch

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    root, clock, state = str(tmp_path), [100.0], State()
    step = watch.settling(root, [], None, 10)
    given = lambda: sum(len(f) for f in step((root,), iter([]), state))
    real, watch.time = watch.time, type("Clock", (), {"time": staticmethod(lambda: clock[0])})
    try:
        out = []
        for at, write in ((100, "a"), (106, "b"), (112, "c"), (121, None), (122, None), (140, None), (141, "d"), (150, None), (151, None)):
            clock[0] = at
            if write:
                (tmp_path / write).write_text(write)
            out.append(given())
    finally:
        watch.time = real
    assert out == [0, 0, 0, 0, 1, 0, 0, 0, 1]


def test_listing_by_tasks_equals_a_walk(spark, tmp_path):
    """Folders are shared at any depth; rules are inherited; the first 8 KiB tell binaries."""
    root = str(tmp_path / "deep")
    for k in range(4):
        for i in range(3):
            put(root, **{f"d{k}/e{i}/f{j}.py": "x" for j in range(2)})
        put(root, **{f"d{k}/.gitignore": f"e{k}/\n*.tmp\n!keep.tmp\n", f"d{k}/x.tmp": "1", f"d{k}/keep.tmp": "2", f"d{k}/e1/y.tmp": "3"})
    put(root, **{".gitignore": "/d3/e2/f0.py\n", "big.txt": "x" * 300, "node_modules/q.js": "x"})
    with open(os.path.join(root, "bin.dat"), "wb") as f:
        f.write(b"a\0b")
    with open(os.path.join(root, "late.dat"), "wb") as f:
        f.write(b"a" * scan.SNIFF_BYTES + b"\0")
    os.symlink(os.path.join(root, "d0"), os.path.join(root, "link"))
    plain = {(p, "skipped-binary" if p == "bin.dat" else "skipped-large-file" if n > 9000 else s, n, m) for p, s, n, m in scan.walk(root, ["*.log"])}
    assert {tuple(r) for r in scan.list_files(spark, root, ["*.log"], max_file_size=9000).collect()} == plain
    for folders in (1, 3, 500):
        reader = scan.WorkspaceReader({"path": root, "folders": str(folders), "patterns": '["*.log"]', "maxfilesize": "9000"})
        parts = reader.partitions()
        assert {r for p in parts for r in reader.read(p)} == plain and (len(parts) == 1) == (folders == 1)
    assert [tuple(r)[0] for r in scan.list_files(spark, root, include={"d0/e1/f0.py"}).where("status = 'accepted'").collect()] == ["d0/e1/f0.py"]


def test_identifiers_take_linear_time():
    """One wide character used to make every offset a count of the whole prefix."""
    text = "".join(f"function f{i}(a) {{ return g{i}(a, 'é\U0001f600') }}\n" for i in range(8000))
    began = time.time()
    got = parse("a.js", text, "javascript")
    assert len(got.symbols) >= 8000 and time.time() - began < 20
    from srcgraph.operators.extract import _Builder, units

    b = _Builder("p", "aé\U0001f600b\U0001f601c")
    assert [b.offset(i) for i in range(7)] == [units(b.text[:i]) for i in range(7)]


def test_cli(spark, tmp_path):
    put(str(tmp_path / "ws"), **{"a.ts": "export function go() {}\n"})
    args = ["--root", str(tmp_path / "ws"), "--index", str(tmp_path / "i")]
    assert cli.run(["index", *args], spark)["added"] == 1
    assert cli.run(["search", "go", *args], spark)[0]["path"] == "a.ts" and cli.run(["symbols", "go", *args], spark)[0]["name"] == "go"
    assert cli.run(["files", "a", "--language", "typescript", *args], spark) and cli.run(["intent", "who calls go", *args], spark)["kind"] == "caller"
    assert cli.size("5mb") == 5 << 20


WORDED = {
    "ruby": (
        "require 'json'\nmodule Shop\n  class Cart < Base\n    def total(x)\n      x.each do |i|\n        add(i) if i\n      end\n      while x do\n        y\n      end\n    end\n  end\nend\ndef solo\n  1\nend\n",
        [("Shop", "module", 2, 13), ("Cart", "class", 3, 12), ("total", "method", 4, 11), ("solo", "function", 14, 16)], {("imports", "json", 1), ("extends", "Base", 3), ("calls", "add", 6)},
    ),
    "lua": (
        'local j = require("json")\nlocal function add(a)\n  if a then return a end\n  for i = 1, 2 do call(i) end\nend\nfunction M.run:go(x)\n  repeat step() until x -- end\nend\n',
        [("add", "function", 2, 5), ("go", "method", 6, 8)], {("imports", "json", 1), ("calls", "call", 4), ("calls", "step", 7)},
    ),
    "elixir": (
        "defmodule Shop.Cart do\n  alias Shop.Item\n  def total(x), do: sum(x)\n  defp one(x) do\n    Enum.map(x, fn y -> f(y) end)\n  end\nend\n",
        [("Cart", "module", 1, 7), ("total", "function", 3, 3), ("one", "function", 4, 6)], {("imports", "Shop.Item", 2), ("calls", "sum", 3), ("calls", "map", 5), ("calls", "f", 5)},
    ),
    "julia": (
        "using LinearAlgebra\nmodule M\nstruct P\n x\nend\nfunction f(x)\n  for i in x\n   g(i)\n  end\nend\nend\n",
        [("M", "module", 2, 11), ("P", "class", 3, 5), ("f", "function", 6, 10)], {("imports", "LinearAlgebra", 1), ("calls", "g", 8)},
    ),
    "bash": ("source ./lib.sh\nbuild() {\n  if [ -f x ]; then\n    run a\n  fi\n}\nfunction deploy {\n  build\n}\n", [("build", "function", 2, 6), ("deploy", "function", 7, 9)], {("imports", "./lib.sh", 1)}),
}


@pytest.mark.parametrize("language", WORDED)
def test_languages_whose_blocks_end_with_a_word(language):
    text, symbols, relations = WORDED[language]
    got = parse("f", text, language)
    assert [(x[2], x[3], x[4], x[5]) for x in got.symbols] == symbols
    assert {(x[1], x[5], x[6]) for x in got.relations if x[1] not in ("references", "contains")} == relations
    for odd in ("", "end end", "def", "do\n" * 50, '"' + text, text * 3):
        assert not parse("f", odd, language).error
