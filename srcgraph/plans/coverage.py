"""Queries over a synthetic code base with thousands of files: parts are modules, order lines their imports and edges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_and_normalize
from ..operators import architecture, context, detectors, embeddings, graph, incremental, lookup, reports, search
from ..operators.extract import extract
from ..schema import SCHEMAS, Snapshot
from ..sources import scan, store
from . import testdata as td
from .queries import _CHUNKS, _FILES, _RELATIONS, _SCORES, _SYMBOLS, QUERY, _query_vector, long
from .registry import SQL, query

_MODULES = """
modules AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 20) || '/src/m' || p_partkey || ['.ts', '.tsx', '.js', '/index.ts'][1 + p_partkey % 4] AS path FROM part)"""
_IMPORTS = """
imports AS (SELECT f.path AS filePath, l_linenumber AS line, l_linenumber % 5 AS c, l_suppkey AS s, t.path AS there,
            CASE l_linenumber % 5 WHEN 0 THEN CASE WHEN l_partkey % 4 = 3 THEN '../../../' ELSE '../../' END || 'pkg' || (l_suppkey % 20) || '/src/m' || l_suppkey WHEN 1 THEN '@lib/m' || l_suppkey
            WHEN 2 THEN '@scope/pkg' || (l_suppkey % 20) || '/src/m' || l_suppkey WHEN 3 THEN CASE WHEN l_linestatus = 'F' THEN '@org/' || lower(l_returnflag) || '/sub/x' ELSE 'lib' || l_returnflag || '/sub' END ELSE './gone' || l_suppkey END AS target
            FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem) JOIN modules f ON l_partkey = f.k JOIN modules t ON l_suppkey = t.k),
edges AS (SELECT filePath AS f, there AS t, count(*) AS n, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM imports WHERE filePath <> there AND (c IN (0, 2) OR c = 1 AND s % 20 IN (1, 2)) GROUP BY ALL)"""


def _module_path(k):
    tail = F.element_at(F.array(*map(F.lit, (".ts", ".tsx", ".js", "/index.ts"))), (1 + k % 4).cast("int"))
    return F.concat(F.lit("pkg"), (k % 20).cast("string"), F.lit("/src/m"), k.cast("string"), tail)


def modules(spark, d) -> Snapshot:
    """Parts as files with one symbol each, order lines as their imports."""
    part = td.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    none = F.lit(None).cast("string")
    files = part.select(_module_path(F.col("k")).alias("path"), F.lit("typescript").alias("language"), F.lit("").alias("hash"), F.lit(100).cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), F.array().cast("array<string>").alias("terms"), F.col("k").alias("ord"))
    symbols = part.select(
        F.concat(F.lit("P"), "k").alias("id"), _module_path(F.col("k")).alias("filePath"), F.concat(F.lit("sym"), "k").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine"),
        F.lit(0).alias("startColumn"), F.lit(0).alias("endColumn"), none.alias("parentId"), F.col("k").alias("ord"),
    )
    line = td.read(spark, d, "lineitem").select(*long("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_returnflag", "l_linestatus").distinct()
    # The estimate of a key's column is far below what its hash table takes in the driver and every task.
    known = part.hint("broadcast" if part.count() <= graph.BROADCAST_NODES else "merge")
    line = line.join(known.withColumnRenamed("k", "l_suppkey"), "l_suppkey", "left_semi").join(known.withColumnRenamed("k", "l_partkey"), "l_partkey", "left_semi")
    s, module = F.col("l_suppkey").cast("string"), F.concat(F.lit("pkg"), (F.col("l_suppkey") % 20).cast("string"), F.lit("/src/m"), F.col("l_suppkey").cast("string"))
    kind = F.col("l_linenumber") % 5
    up = F.when(F.col("l_partkey") % 4 == 3, "../../../").otherwise("../../")
    outside = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("@org/"), F.lower("l_returnflag"), F.lit("/sub/x"))).otherwise(F.concat(F.lit("lib"), "l_returnflag", F.lit("/sub")))
    target = F.when(kind == 0, F.concat(up, module)).when(kind == 1, F.concat(F.lit("@lib/m"), s)).when(kind == 2, F.concat(F.lit("@scope/"), module)).when(kind == 3, outside).otherwise(F.concat(F.lit("./gone"), s))
    relations = line.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]).alias("id"), F.lit("imports").alias("kind"), _module_path(F.col("l_partkey")).alias("filePath"), none.alias("fromSymbolId"),
        none.alias("toSymbolId"), target.alias("targetName"), F.col("l_linenumber").cast("int").alias("line"), F.lit(0.9).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return Snapshot.empty(spark).with_(files=files, symbols=symbols, relations=relations)


def configuration(spark) -> DataFrame:
    """(path, text): a tsconfig with an alias, and twenty packages."""
    rows = [("tsconfig.json", '{\n  // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["pkg1/src/*", "pkg2/src/*"]}}, }')]
    rows += [(f"pkg{i}/package.json", json.dumps({"name": f"@scope/pkg{i}", "main": f"./src/m{i or 20}"})) for i in range(20)]
    return spark.createDataFrame(rows, "path string, text string")


def _report(spark, d) -> dict[str, DataFrame]:
    return architecture.analyze(modules(spark, d), configuration(spark))


# Architecture


@query('SELECT f AS "from", t AS "to", n::BIGINT AS imports, lines FROM edges', _MODULES, _IMPORTS)
def architecture_edges(spark, d):
    return _report(spark, d)["edges"].select("from", "to", "imports", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


SQL["file_dependency_edges"] = SQL["architecture_edges"].replace("n::BIGINT AS imports, lines", "n::BIGINT AS n")


@query(SQL["file_dependency_edges"])
def file_dependency_edges(spark, d):
    return architecture_edges(spark, d).select("from", "to", F.col("imports").alias("n"))


_FANS = """
fans AS (SELECT path, coalesce(i, 0)::BIGINT AS fanIn, coalesce(o, 0)::BIGINT AS fanOut FROM modules LEFT JOIN (SELECT t AS path, count(DISTINCT f) AS i FROM edges GROUP BY t) USING (path) LEFT JOIN (SELECT f AS path, count(DISTINCT t) AS o FROM edges GROUP BY f) USING (path))"""


@query("SELECT * FROM fans", _MODULES, _IMPORTS, _FANS)
def fan_in_out(spark, d):
    return _report(spark, d)["files"].select("path", *long("fanIn", "fanOut"))


@query("SELECT path, fanIn FROM fans WHERE fanIn > 0 ORDER BY fanIn DESC, path LIMIT 10", _MODULES, _IMPORTS, _FANS)
def most_depended(spark, d):
    return _report(spark, d)["mostDependedOn"].select("path", *long("fanIn"))


@query("SELECT path FROM fans WHERE fanIn = 0 AND fanOut > 0", _MODULES, _IMPORTS, _FANS)
def entry_candidates(spark, d):
    return _report(spark, d)["entryCandidates"].select("path")


@query("SELECT 'relative' AS kind, filePath, target, line::BIGINT AS line FROM imports WHERE c = 4 UNION ALL SELECT 'alias', filePath, target, line FROM imports WHERE c = 1 AND s % 20 NOT IN (1, 2)", _MODULES, _IMPORTS)
def unresolved_imports(spark, d):
    """The union of both kinds."""
    report = _report(spark, d)
    parts = [report[f"unresolved{kind.title()}Imports"].select(F.lit(kind).alias("kind"), "filePath", "target", *long("line")) for kind in ("relative", "alias")]
    return parts[0].unionByName(parts[1])


@query("SELECT CASE WHEN target LIKE '@%' THEN array_to_string(string_split(target, '/')[1:2], '/') ELSE string_split(target, '/')[1] END AS name, count(*)::BIGINT AS importedBy, array_to_string(list_sort(list_distinct(list(filePath))), '|') AS files FROM imports WHERE c = 3 GROUP BY 1", _MODULES, _IMPORTS)
def external_packages(spark, d):
    return _report(spark, d)["externalPackages"].select("name", "importedBy", F.array_join("files", "|").alias("files"))


@query("SELECT '@lib/*' AS alias, min('pkg' || (s % 20) || '/src/m' || s) AS target, count(DISTINCT there)::BIGINT AS files FROM imports WHERE c = 1 AND s % 20 IN (1, 2)", _MODULES, _IMPORTS)
def resolved_aliases(spark, d):
    return _report(spark, d)["resolvedAliases"]


@query("SELECT '@scope/pkg' || i AS name, 'pkg' || i AS root, path AS entryPoints FROM range(20) r(i) JOIN modules ON k = CASE i WHEN 0 THEN 20 ELSE i END", _MODULES)
def workspace_packages(spark, d):
    return _report(spark, d)["workspacePackages"].select("name", "root", F.array_join("entryPoints", "|").alias("entryPoints"))


@query("SELECT filePath, there AS target, line::BIGINT AS line FROM imports WHERE c = 0 AND filePath <> there", _MODULES, _IMPORTS)
def indexed_imports(spark, d):
    return graph.import_targets(modules(spark, d)).select("filePath", "target", *long("line"))


@query(
    """, r(node, depth) AS (SELECT path, 0 FROM modules WHERE k = 7 UNION SELECT filePath, depth + 1 FROM r JOIN (SELECT DISTINCT filePath, there FROM imports WHERE c = 0) ON there = node WHERE depth < 3 AND filePath <> there)
SELECT node AS filePath, min(depth)::BIGINT AS depth, CASE min(depth) WHEN 1 THEN 'direct' ELSE 'transitive' END AS impact FROM r WHERE node <> (SELECT path FROM modules WHERE k = 7) GROUP BY node""",
    _MODULES, _IMPORTS,
)
def change_impact_imports(spark, d):
    return graph.change_impact(modules(spark, d), "pkg7/src/m7/index.ts", 3)["affectedFiles"].select("filePath", *long("depth"), "impact")


# A graph of symbols

_GRAPH = """
g AS (SELECT src, dst FROM (SELECT DISTINCT l_partkey AS src, 1 + (l_partkey + 37 * l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem) WHERE src <> dst)"""


def call_snapshot(spark, d) -> Snapshot:
    """An edge between two parts for every part and supplier of an order line."""
    n = td.read(spark, d, "part").count()
    s = modules(spark, d)
    line = td.read(spark, d, "lineitem").select(*long("l_partkey", "l_suppkey"))
    pairs = line.select(F.col("l_partkey").alias("src"), (1 + (F.col("l_partkey") + 37 * F.col("l_suppkey")) % n).alias("dst")).where("src <> dst").distinct()
    relations = pairs.select(
        F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id"), F.lit("calls").alias("kind"), _module_path(F.col("src")).alias("filePath"), F.concat(F.lit("P"), "src").alias("fromSymbolId"),
        F.concat(F.lit("P"), "dst").alias("toSymbolId"), F.concat(F.lit("sym"), "dst").alias("targetName"), F.lit(1).alias("line"), F.lit(0.7).alias("confidence"), (F.col("src") * 1_000_000 + F.col("dst")).alias("ord"),
    )
    return s.with_(relations=relations)


_SPARSE = """
h AS (SELECT src, dst FROM (SELECT DISTINCT l_partkey AS src, 1 + (l_partkey + 37 * l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem WHERE l_linenumber = 7) WHERE src <> dst),
reach(a, b) AS (SELECT src, dst FROM h UNION SELECT a, dst FROM reach JOIN h ON b = src)"""


@query("SELECT 'P' || f.a AS node, min('P' || f.b) AS component FROM reach f JOIN reach r ON f.a = r.b AND f.b = r.a GROUP BY f.a HAVING count(*) > 1", _SPARSE)
def module_scc(spark, d):
    """Knots of modules whose edges are every seventh line of an order."""
    n = td.read(spark, d, "part").count()
    line = td.read(spark, d, "lineitem").where("l_linenumber = 7").select(*long("l_partkey", "l_suppkey"))
    pairs = line.select(F.col("l_partkey").alias("src"), (1 + (F.col("l_partkey") + 37 * F.col("l_suppkey")) % n).alias("dst"))
    return graph.strongly_connected(pairs.select(F.concat(F.lit("P"), "src").alias("src"), F.concat(F.lit("P"), "dst").alias("dst")))


_PAIRS = [(1, 150), (2, 77), (10, 199)]


@query(
    f""", pairs(a, b) AS (VALUES {", ".join(map(str, _PAIRS))}),
w(a, b, node, depth, queue, path) AS (SELECT a, b, a, 0, [a::BIGINT], ['sym' || a] FROM pairs UNION ALL SELECT a, b, dst, depth + 1, list_append(queue, src * 1000000 + dst), list_append(path, 'sym' || dst) FROM w JOIN g ON src = node WHERE depth < 4 AND node <> b),
best AS (SELECT a, b, arg_min(path, (depth, queue)) AS path FROM w WHERE node = b GROUP BY a, b),
found AS (SELECT pairs.a, coalesce(path, ['sym' || pairs.a]) AS path FROM pairs LEFT JOIN best USING (a, b))
SELECT 'sym' || a AS start, unnest(range(1, len(path) + 1))::BIGINT AS pos, unnest(path) AS node FROM found""",
    _GRAPH,
)
def shortest_path(spark, d):
    """The path that a search from one symbol to another finds first, node by node."""
    s = call_snapshot(spark, d)
    s = s.with_(relations=graph._cut(s.relations))  # every level of every search reads the edges
    rows = [(f"sym{a}", i, node) for a, b in _PAIRS for i, node in enumerate(graph.symbol_path(s, f"sym{a}", f"sym{b}")["nodes"], 1)]
    return spark.createDataFrame(rows, "start string, pos long, node string")


@query("SELECT 'P' || k AS id, ((SELECT count(*) FROM g WHERE src = k) + (SELECT count(*) FROM g WHERE dst = k))::BIGINT AS degree FROM modules ORDER BY degree DESC, 'sym' || k LIMIT 60", _MODULES, _GRAPH)
def top_degree_symbols(spark, d):
    return graph.relation_graph(call_snapshot(spark, d), 60)["nodes"].select("id", "degree")


@query("SELECT 'P' || k AS id, 1::BIGINT AS level, least(4, (SELECT count(*) FROM g WHERE dst = k AND src < 400))::BIGINT AS layer FROM modules WHERE k < 400", _MODULES, _GRAPH)
def flow_layers(spark, d):
    flow = graph.flow_graph(call_snapshot(spark, d), 400)
    return graph.flow_layers(flow["edges"], flow["nodes"]).select("id", *long("level", "layer"))


@query("SELECT src || '>' || dst AS id FROM g WHERE src = 5 OR dst = 5", _GRAPH)
def focus_edges(spark, d):
    return graph.focus(call_snapshot(spark, d).relations, "P5", ["calls", "extends"]).select("id")


@query(", m AS (SELECT f.path AS a, t.path AS b, count(*) AS n FROM g JOIN modules f ON src = f.k JOIN modules t ON dst = t.k WHERE src < 300 AND dst < 300 GROUP BY ALL) SELECT path, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT a AS path, n AS o, 0 AS i FROM m UNION ALL SELECT b, 0, n FROM m) GROUP BY path", _MODULES, _GRAPH)
def matrix_totals(spark, d):
    return graph.matrix_totals(graph.dependency_matrix(call_snapshot(spark, d), 300)).select("path", *long("outgoing", "incoming"))


@query("SELECT 'P' || dst AS id, src * 1000000 + dst AS edgeOrd, 'out' AS side FROM g WHERE src = 9 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = 9 AND h.src * 1000000 + 9 < 9 * 1000000 + g.dst) UNION ALL SELECT 'P' || src, src * 1000000 + dst, 'in' FROM g WHERE dst = 9 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.src = 9 AND h.dst = g.src AND 9 * 1000000 + g.src < g.src * 1000000 + 9)", _GRAPH)
def radial_symbols(spark, d):
    s = call_snapshot(spark, d)
    return graph.radial_graph(s.with_(symbols=s.symbols.withColumn("name", F.when(F.col("id") == "P9", "the_root").otherwise(F.col("name")))), "the_root").select("id", "edgeOrd", "side")


# Lookups and lists


@query("SELECT path, language, size FROM files WHERE path = 'src1/en/doc1.md' OR path = (SELECT path FROM files WHERE ord = 3)", _FILES)
def get_file(spark, d):
    s = td.snapshot(spark, d)
    path = s.files.where("ord = 3").first().path
    return lookup.get_file(s, path).unionByName(lookup.get_file(s, "src1/en/doc1.md").where(F.col("path") != path)).select("path", "language", "size")


@query("SELECT path FROM files WHERE contains(path, 'fr/doc1')", _FILES)
def files_by_path(spark, d):
    return lookup.filter_files(td.snapshot(spark, d), "fr/doc1", in_path_only=True).select("path")


@query("SELECT id, name, kind FROM symbols WHERE kind = 'method' AND (contains(lower(name), 'blue') OR contains(lower(filePath), 'blue') OR contains(lower(kind), 'blue'))", _SYMBOLS)
def symbols_filtered(spark, d):
    return lookup.filter_symbols(td.snapshot(spark, d), "Blue", "method").select("id", "name", "kind")


@query("SELECT (row_number() OVER (ORDER BY score DESC, path) - 1)::BIGINT AS pos, path FROM (SELECT path, sum(s) AS score FROM hits GROUP BY path) ORDER BY score DESC, path LIMIT 25", _FILES, _SCORES)
def result_order(spark, d):
    """The order in which a search gives its files."""
    return search.search(td.snapshot(spark, d), QUERY, 25).coalesce(1).select(F.monotonically_increasing_id().alias("pos"), "path")


@query("SELECT 'c' || page_id || e AS filePath, CASE WHEN e LIKE '%docker%' THEN 'Container' WHEN e = '/package.json' THEN 'Dependencies' ELSE 'Configuration' END AS type, 'x' AS format FROM c WHERE regexp_matches(e, '\\.(json|toml|yaml|yml)$|docker|config')",
       "c AS (SELECT page_id, ['/package.json', '/a.ts', '/docker/x', '.yml', '/vite.config.js'][1 + page_id % 5] AS e FROM pages)")
def config_files(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ("/package.json", "/a.ts", "/docker/x", ".yml", "/vite.config.js"))), (1 + F.col("page_id") % 5).cast("int"))
    files = td.read(spark, d, "pages").select(F.concat(F.lit("c"), F.col("page_id").cast("string"), tail).alias("path"), F.lit("x").alias("language"))
    return reports.configs(td.snapshot(spark, d).with_(files=files))


@query("SELECT doc_id, coalesce(source, CASE WHEN doc_id % 3 = 0 THEN 'repo ' || lang END) AS grp FROM documents")
def index_groups(spark, d):
    docs = td.read(spark, d, "documents")
    label = F.concat(F.lit("repo "), "lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" · part "), F.col("doc_id").cast("string"), F.lit(" of 9000"))).otherwise(""))
    return docs.select("doc_id", reports.index_group(F.col("source"), label).alias("grp"))


@query("SELECT ord, '{\"id\":\"' || id || '\",\"filePath\":\"' || filePath || '\",\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"startLine\":' || startLine || ',\"endLine\":' || CASE kind WHEN 'class' THEN 9 ELSE startLine + 5 END || ',\"startColumn\":0,\"endColumn\":0}' AS line FROM symbols", _SYMBOLS)
def export_symbols_json(spark, d):
    return reports.symbols_json(td.snapshot(spark, d))


@query("SELECT 'dup-' || row_number() OVER (ORDER BY first) AS \"group\", hash, n::BIGINT AS count FROM (SELECT hash, count(*) AS n, min(ord) AS first FROM chunks WHERE length(trim(text, E' \\t\\n\\r\\x0B\\f')) > 30 GROUP BY hash HAVING count(*) > 1 ORDER BY first LIMIT 20)", _FILES, _CHUNKS)
def duplicate_numbers(spark, d):
    return reports.duplicate_groups(td.snapshot(spark, d)).select("group", "hash", "count").distinct()


@query("SELECT \"group\", filePath, chunks.startLine::BIGINT AS startLine, left(text, 200) AS excerpt FROM chunks JOIN (SELECT hash, 'dup-' || row_number() OVER (ORDER BY min(ord)) AS \"group\" FROM chunks WHERE length(trim(text, E' \\t\\n\\r\\x0B\\f')) > 30 GROUP BY hash HAVING count(*) > 1 ORDER BY min(ord) LIMIT 20) USING (hash)", _FILES, _CHUNKS)
def duplicate_listing(spark, d):
    return reports.duplicate_groups(td.snapshot(spark, d)).select("group", "filePath", *long("startLine"), "excerpt")


@query(r"SELECT left(sha256(f || ':' || method || ':' || path || ':' || line), 24) AS id, f AS \"filePath\", method, path, line::BIGINT AS \"startLine\" FROM (SELECT 'p' || page_id || '.ts' AS f, 'GET' AS method, '/' || page_id AS path, 2 AS line FROM pages UNION ALL SELECT 'p' || page_id || '.ts', 'POST', regexp_extract(url, '://[^/]*([^?#]*)', 1), 3 FROM pages, range(2) WHERE regexp_extract(url, '://[^/]*([^?#]*)', 1) <> '')".replace('\\"', '"'))
def api_endpoints(spark, d):
    pages = td.read(spark, d, "pages")
    text = F.concat(F.lit("const x = 1\napp.get('/"), F.col("page_id").cast("string"), F.lit("', f)\nrouter.post(\""), F.regexp_extract("url", "://[^/]*([^?#]*)", 1), F.lit('")\n'))
    texts = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("filePath"), text.alias("text"))
    return detectors.api_endpoints(texts, td.symbols(spark, d)).select("id", "filePath", "method", "path", *long("startLine"))


# Search over several indexes


def _halves(spark, d) -> dict[str, Snapshot]:
    s = td.snapshot(spark, d)
    return {f"half{k}": s.with_(files=s.files.where(F.col("ord") % 2 == k), symbols=s.symbols.where(F.col("ord") % 2 == k), chunks=s.chunks.where(F.floor(F.col("ord") / 100_000) % 2 == k)) for k in (0, 1)}


@query(", t AS (SELECT path, language, 'half' || (ord % 2) AS indexUid, sum(s) AS score FROM hits JOIN files USING (path) GROUP BY ALL) SELECT path, language, indexUid, score::DOUBLE AS score FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY indexUid ORDER BY score DESC, path) <= 30) WHERE language = 'fr' ORDER BY score DESC, path, indexUid LIMIT 30", _FILES, _SCORES)
def search_several_indexes(spark, d):
    """Each index gives its best thirty; the language is looked at after that."""
    return search.search_all(_halves(spark, d), QUERY, 30, per_index=True, language="fr").select("path", "language", "indexUid", "score")


@query(", t AS (SELECT path, sum(s) AS score FROM hits GROUP BY path ORDER BY score DESC, path LIMIT 15) SELECT path, score::DOUBLE AS score, (SELECT left(arg_min(c.text, c.ord), 500) FROM chunks c WHERE c.filePath = t.path AND EXISTS (SELECT 1 FROM q WHERE contains(lower(c.text), term))) AS excerpt FROM t", _FILES, _CHUNKS, _SCORES)
def search_excerpts(spark, d):
    s = td.snapshot(spark, d)
    return search.excerpts(s, search.search(s, QUERY, 15), QUERY).select("path", "score", "excerpt")


@query("SELECT 'half' || (ord % 2) AS indexUid, count(*)::BIGINT AS n, min(path) AS first FROM files GROUP BY 1", _FILES)
def union_of_indexes(spark, d):
    return store.union(_halves(spark, d), "files").groupBy("indexUid").agg(F.count("*").alias("n"), F.min("path").alias("first"))


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q0 AS (SELECT e AS q FROM v WHERE vec_id = 0)"


def _vector_snapshot(spark, d) -> Snapshot:
    """A file and a chunk for each vector."""
    s = td.snapshot(spark, d)
    rows = td.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("ord"), F.col("label").cast("string").alias("label"))
    files = rows.select(F.concat(F.lit("v/"), "ord").alias("path"))
    chunks = rows.select(F.col("ord").cast("string").alias("id"), F.concat(F.lit("v/"), "ord").alias("filePath"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"), F.col("label").alias("text"), "ord")
    return s.with_(files=files, chunks=chunks)


@query("SELECT vec_id::BIGINT AS vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q0 ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 20", _VEC)
def semantic_topk(spark, d):
    near = search.semantic_search(_vector_snapshot(spark, d), _query_vector(spark, d), 20)
    return near.select(F.col("chunkId").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT label::VARCHAR AS label, count(*)::BIGINT AS votes FROM (SELECT label FROM v, q0 ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 50) GROUP BY label", _VEC)
def vector_knn_label_vote(spark, d):
    return search.semantic_search(_vector_snapshot(spark, d), _query_vector(spark, d), 50).groupBy(F.col("text").alias("label")).agg(F.count("*").alias("votes"))


@query("SELECT vec_id::BIGINT AS vec_id, round(list_dot_product(e, q), 6) AS dot, round(sqrt(list_dot_product(q, q)), 6) AS queryNorm, round(sqrt(list_dot_product(e, e)), 6) AS documentNorm FROM v, q0", _VEC)
def vector_self_test(spark, d):
    rows = td.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    tested = embeddings.self_test(F.array(*[F.lit(x) for x in _query_vector(spark, d)]), F.col("e"))
    return rows.select("vec_id", tested.alias("t")).select("vec_id", *[F.round(f"t.{c}", 6).alias(c) for c in ("dot", "queryNorm", "documentNorm")])


@query("SELECT DISTINCT sha256(w) AS hash, (('0x' || left(sha256(w), 8))::UBIGINT % 64)::BIGINT AS at, CASE WHEN ('0x' || sha256(w)[9:10])::UBIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM (SELECT 'w' || p_partkey AS w FROM part)")
def embed_words(spark, d):
    """Vectors of single words: each chunk's is one of its word's hash."""
    words = td.read(spark, d, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("text"))
    chunks = words.select(F.col("text").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "text")
    made = embeddings.embed_chunks(chunks, embeddings.HashProvider(64))
    return made.select(F.col("chunkHash").alias("hash"), F.posexplode("values").alias("at", "value")).where("value <> 0").select("hash", *long("at"), "value")


@query(
    """SELECT vec_id::BIGINT AS vec_id, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS first, round(list_dot_product(c, q) / sqrt(list_dot_product(c, c)) / sqrt(list_dot_product(q, q)), 6) AS score
FROM (SELECT vec_id, e[1:16] AS c FROM v WHERE len(e) >= 16), (SELECT q[1:16] AS q FROM q0) WHERE list_dot_product(c, c) > 0""",
    _VEC,
)
def truncated_vectors(spark, d):
    """All vectors cut to their first 16 components and scaled to length one, and their product with the query's."""
    cut = lambda e: truncate_and_normalize(e, 16)
    rows = td.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.size("e") >= 16).where(F.exists(F.slice("e", 1, 16), lambda x: x != 0)).select("vec_id", cut(F.col("e")).alias("c"))
    asked = cut(F.array(*[F.lit(x) for x in _query_vector(spark, d)]))
    return rows.select("vec_id", F.round(F.col("c")[0], 6).alias("first"), F.round(embeddings.self_test(asked, F.col("c"))["dot"], 6).alias("score"))


# Context


@query("SELECT path, round(sum(w), 6)::DOUBLE AS weight FROM (SELECT t.filePath AS path, confidence AS w FROM relations r JOIN symbols t ON toSymbolId = t.id WHERE r.filePath = (SELECT 'nations/' || n_name || '.ts' FROM nation WHERE n_nationkey = 3) AND t.filePath <> r.filePath) GROUP BY path ORDER BY sum(w) DESC, path LIMIT 15", _SYMBOLS, _RELATIONS)
def related_files(spark, d):
    seeds = td.read(spark, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("nations/"), "n_name", F.lit(".ts")).alias("path"))
    return context.related_files(td.snapshot(spark, d), seeds, 15).select("path", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def _coded_chunks(spark, d) -> Snapshot:
    """Parts as symbols, a file for every path and a chunk for every symbol."""
    s = td.snapshot(spark, d)
    files = s.symbols.groupBy(F.col("filePath").alias("path")).agg(F.min("ord").alias("ord")).select("path", F.lit("typescript").alias("language"), F.lit("").alias("hash"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), F.array().cast("array<string>").alias("terms"), "ord")
    chunks = s.symbols.select(F.concat(F.lit("C"), "id").alias("id"), "filePath", F.col("id").alias("symbolId"), "startLine", "endLine", F.lit("").alias("hash"), F.col("name").alias("text"), "ord")
    return s.with_(files=files, chunks=chunks)


_CONTEXT = """
cf AS (SELECT filePath AS path, sum(4 * (contains(lower(name), 'red')::INT + contains(lower(name), 'widget')::INT)) AS s FROM symbols GROUP BY filePath),
top AS (SELECT path FROM cf WHERE s > 0 ORDER BY s DESC, path LIMIT 3),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, startLine, ord) AS i FROM (SELECT symbols.*, (contains(lower(name), 'red')::INT + contains(lower(name), 'widget')::INT) AS score, ceil(length(name) / 4)::BIGINT AS cost FROM symbols WHERE filePath IN (SELECT path FROM top))),
pk AS (SELECT i, id, CASE WHEN cost <= 25 THEN cost ELSE 0 END AS used, cost <= 25 AS taken FROM o WHERE i = 1
       UNION ALL SELECT o.i, o.id, CASE WHEN pk.used + o.cost <= 25 THEN pk.used + o.cost ELSE pk.used END, pk.used + o.cost <= 25 FROM pk JOIN o ON o.i = pk.i + 1),
own AS (SELECT id FROM pk WHERE taken),
ids AS (SELECT id FROM own UNION SELECT toSymbolId FROM relations WHERE fromSymbolId IN (SELECT id FROM own) UNION SELECT fromSymbolId FROM relations WHERE toSymbolId IN (SELECT id FROM own))"""


def _context(spark, d) -> dict:
    return context.get_context(_coded_chunks(spark, d), "red widget", 3, 25, 0)


@query("SELECT symbols.id, name FROM symbols JOIN ids USING (id)", _SYMBOLS, _RELATIONS, _CONTEXT)
def context_symbols(spark, d):
    return _context(spark, d)["symbols"].select("id", "name")


@query("SELECT DISTINCT id FROM relations WHERE fromSymbolId IN (SELECT id FROM ids) OR toSymbolId IN (SELECT id FROM ids) OR filePath IN (SELECT path FROM top)", _SYMBOLS, _RELATIONS, _CONTEXT)
def context_relations(spark, d):
    return _context(spark, d)["relations"].select("id")


@query("SELECT path AS filePath FROM top", _SYMBOLS, _CONTEXT.split(",\no AS")[0])
def context_files(spark, d):
    return _context(spark, d)["files"].select(F.col("path").alias("filePath"))


# Refresh


def before_and_after(spark, d) -> tuple[Snapshot, DataFrame]:
    """A snapshot of all documents, and a scan in which every fifth is gone and every third has another text."""
    docs = td.read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("k"), td.doc_path().alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("language"))
    n, none = docs.count(), F.lit(None).cast("string")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    files = docs.select("path", "language", digest(F.col("text")).alias("hash"), F.length("text").cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), F.array().cast("array<string>").alias("terms"), F.col("k").alias("ord"))
    symbols = docs.select(
        F.concat(F.lit("D"), "k").alias("id"), F.col("path").alias("filePath"), F.concat(F.lit("name"), (F.col("k") % 97).cast("string")).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"),
        F.lit(0).alias("startColumn"), F.lit(0).alias("endColumn"), none.alias("parentId"), F.col("k").alias("ord"),
    )
    to = (F.col("k") * 7 + 1) % n
    relations = docs.select(
        F.concat(F.lit("R"), "k").alias("id"), F.when(F.col("k") % 2 == 0, "calls").otherwise("references").alias("kind"), F.col("path").alias("filePath"), F.concat(F.lit("D"), "k").alias("fromSymbolId"), F.concat(F.lit("D"), to.cast("string")).alias("toSymbolId"),
        F.concat(F.lit("name"), (to % 97).cast("string")).alias("targetName"), F.lit(1).alias("line"), F.lit(0.8).alias("confidence"), F.col("k").alias("ord"),
    )
    chunks = docs.select(F.concat(F.lit("C"), "k").alias("id"), F.col("path").alias("filePath"), none.alias("symbolId"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"), digest(F.col("text")).alias("hash"), "text", F.col("k").alias("ord"))
    vectors = chunks.select(F.col("id").alias("chunkId"), F.when(F.col("ord") % 11 == 0, "stale").otherwise(F.col("hash")).alias("chunkHash"), F.lit("p").alias("providerId"), F.lit(1).alias("dimensions"), F.array(F.lit(1.0)).alias("values"))
    previous = Snapshot(files, symbols, relations, chunks, vectors, spark.createDataFrame([], SCHEMAS["metadata"]))
    text = F.when(F.col("k") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    scanned = docs.where("k % 5 <> 0").select("path", F.lit("accepted").alias("status"), F.lit("markdown").alias("language"), digest(text).alias("hash"), F.length(text).cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), text.alias("text"))
    return previous, scanned


def _refreshed(spark, d) -> tuple[Snapshot, DataFrame, Snapshot]:
    previous, scanned = before_and_after(spark, d)
    fresh, changes = incremental.refresh(previous, scanned)
    return fresh, changes, previous


_REFRESH = """
dk AS (SELECT doc_id AS k, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents),
same AS (SELECT * FROM dk WHERE k % 5 <> 0 AND k % 3 <> 0),
rel AS (SELECT k, path, (k * 7 + 1) % (SELECT count(*) FROM dk) AS t FROM same),
named AS (SELECT 'name' || (k % 97) AS name, arg_min('D' || k, path) AS id FROM same GROUP BY 1)"""


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN k % 5 = 0 THEN 'deleted' WHEN k % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM dk) GROUP BY status", _REFRESH)
def refresh_changes(spark, d):
    return _refreshed(spark, d)[1].groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'R' || rel.k AS id, CASE WHEN t % 5 <> 0 AND t % 3 <> 0 THEN 'D' || t WHEN rel.k % 2 = 0 THEN named.id END AS toSymbolId, CASE WHEN t % 5 <> 0 AND t % 3 <> 0 THEN 0.8 WHEN rel.k % 2 = 0 AND named.id IS NOT NULL THEN CASE WHEN own.k IS NOT NULL THEN 0.9 ELSE 0.72 END ELSE 0.5 END::DOUBLE AS confidence FROM rel LEFT JOIN named ON named.name = 'name' || (t % 97) LEFT JOIN same own ON own.k = rel.k AND own.k % 97 = t % 97", _REFRESH)
def refresh_edges(spark, d):
    """Edges of unchanged files, revalidated: those whose symbol is gone lose it, and calls take another of its name."""
    return _refreshed(spark, d)[0].relations.select("id", "toSymbolId", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT 'C' || k AS chunkId, sha256(text) AS chunkHash FROM same WHERE k % 11 <> 0", _REFRESH)
def refresh_vectors(spark, d):
    return _refreshed(spark, d)[0].vectors.select("chunkId", "chunkHash")


@query("SELECT 'C' || k AS id FROM dk WHERE k % 4 = 1", _REFRESH)
def missing_vectors(spark, d):
    previous = _refreshed(spark, d)[2]
    have = previous.vectors.where("substring(chunkId, 2) % 4 <> 1").unionByName(previous.vectors.where("substring(chunkId, 2) % 4 = 1").withColumn("providerId", F.lit("other")))
    return incremental.missing_vectors(previous.with_(vectors=have), "p", 1).select("id")


@query("SELECT 'vectors' AS t, count(*)::BIGINT AS n FROM dk WHERE k % 6 <> 0 UNION ALL SELECT 'relations', count(*) FROM dk WHERE k % 6 <> 0 UNION ALL SELECT 'files', count(*) FROM dk WHERE k % 6 <> 0", _REFRESH)
def delete_file_records(spark, d):
    previous = _refreshed(spark, d)[2]
    left = incremental.delete_files(previous, previous.files.where("ord % 6 = 0").select("path"))
    parts = [getattr(left, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("vectors", "relations", "files")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upsert_records(spark, d):
    rows = td.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return incremental.upsert(rows, rows.where("k % 4 = 0").withColumn("status", F.lit("new")), "k")


# Extraction


def _sources(spark, d) -> DataFrame:
    """A TypeScript and a Python file for every part. Keys are dealt first: all parts may lie in one row group, and the files are parsed where they are made."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    part = td.read(spark, d, "part").select("p_partkey", "p_size").repartition(tasks)
    ts = F.concat(F.lit("import { x } from './x"), k, F.lit("';\nexport class Box"), k, F.lit(" extends Base {\n  open"), size, F.lit("() {\n    return helper"), k, F.lit("();\n  }\n}\nfunction solo"), k, F.lit("() {\n  return 1;\n}\n"))
    py = F.concat(F.lit("import mod"), k, F.lit("\n\nclass Box"), k, F.lit("(Base):\n    def open"), size, F.lit("(self):\n        return helper"), k, F.lit("()\n\ndef solo"), k, F.lit("():\n    return 1\n"))
    one = lambda ext, language, text: part.select(F.concat(F.lit("f"), k, F.lit(ext)).alias("path"), F.lit(language).alias("language"), text.alias("text"))
    both = one(".ts", "typescript", ts).unionByName(one(".py", "python", py))
    return both.select("path", "language", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.length("text").cast("long").alias("size"), F.lit(0.0).alias("modifiedAt"), "text")


_LINES = """
src AS (SELECT p_partkey AS k, p_size AS z, e FROM part, (VALUES ('.ts'), ('.py')) t(e))"""


@query("""SELECT 'f' || k || e AS filePath, 'Box' || k AS name, 'class' AS kind, CASE e WHEN '.ts' THEN 2 ELSE 3 END::BIGINT AS startLine, CASE e WHEN '.ts' THEN 6 ELSE 5 END::BIGINT AS endLine, '' AS parent FROM src
UNION ALL SELECT 'f' || k || e, 'open' || z, 'method', CASE e WHEN '.ts' THEN 3 ELSE 4 END, 5, 'Box' || k FROM src UNION ALL SELECT 'f' || k || e, 'solo' || k, 'function', 7, CASE e WHEN '.ts' THEN 9 ELSE 8 END, '' FROM src""", _LINES)
def extract_symbols(spark, d):
    s = graph._cut(extract(_sources(spark, d)).symbols)
    # Parsed rows are as many as the files say, which no estimate from the parts' keys foresees: parents are never broadcast.
    parent = s.select(F.col("id").alias("parentId"), F.col("name").alias("parent")).hint("merge")
    return s.join(parent, "parentId", "left").select("filePath", "name", "kind", *long("startLine", "endLine"), F.coalesce("parent", F.lit("")).alias("parent"))


@query("""SELECT 'f' || k || e AS filePath, 'imports' AS kind, CASE e WHEN '.ts' THEN './x' || k ELSE 'mod' || k END AS targetName, 1::BIGINT AS line FROM src
UNION ALL SELECT 'f' || k || e, 'extends', 'Base', CASE e WHEN '.ts' THEN 2 ELSE 3 END FROM src UNION ALL SELECT 'f' || k || e, 'calls', 'helper' || k, CASE e WHEN '.ts' THEN 4 ELSE 5 END FROM src
UNION ALL SELECT 'f' || k || e, 'contains', 'open' || z, CASE e WHEN '.ts' THEN 3 ELSE 4 END FROM src""", _LINES)
def extract_relations(spark, d):
    return extract(_sources(spark, d)).relations.where("kind IN ('imports', 'extends', 'calls', 'contains')").select("filePath", "kind", "targetName", *long("line"))


# Workspaces


def _workspace(spark, d):
    """The documents as files of a folder that all tasks see, with an ignored source, binaries and ignore rules."""
    import os

    from ..sources.staging import shared_folder

    root = shared_folder(spark, "workspace")
    docs = td.read(spark, d, "documents").select("doc_id", td.doc_path().alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def put(frames):
        made = set()
        for frame in frames:
            for doc, path, text in zip(frame["doc_id"], frame["path"], frame["text"]):
                at = os.path.join(root, path)
                folder = os.path.dirname(at)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(at, "wb") as f:
                    f.write((b"\0" if doc % 50 == 0 else b"") + text.encode())
            yield frame[["doc_id"]]

    rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, 1000)  # whole texts
    try:
        docs.mapInPandas(put, "doc_id long").agg(F.count("*")).collect()
    finally:
        spark.conf.set(rows, before)
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write("# generated\nsrc3/\n*7.md\n!src1/en/doc7.md\n")
    return root


_IGNORED = """
ws AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || doc_id || '.md' AS path, coalesce(text, '') AS text,
       CASE WHEN source = 'src3' THEN 'folder' WHEN doc_id % 10 = 7 AND coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || doc_id <> 'src1/en/doc7' THEN 'ignored' WHEN doc_id % 50 = 0 THEN 'skipped-binary' ELSE 'accepted' END AS status FROM documents)"""


@query("SELECT path, status, CASE status WHEN 'accepted' THEN sha256(text) END AS hash, CASE status WHEN 'ignored' THEN 0 ELSE strlen(text) + (doc_id % 50 = 0)::INT END::BIGINT AS size, 'markdown' AS language FROM ws WHERE status <> 'folder' UNION ALL SELECT DISTINCT 'src3', 'ignored', NULL, 0, 'unknown' FROM ws WHERE status = 'folder'", _IGNORED)
def workspace_scan(spark, d):
    rows = scan.scan(spark, _workspace(spark, d)).where("path <> '.gitignore'")
    return rows.select("path", "status", "hash", "size", F.when(F.col("path") == "src3", "unknown").otherwise(F.col("language")).alias("language"))


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT status FROM ws WHERE status <> 'folder' UNION ALL SELECT DISTINCT 'ignored' FROM ws WHERE status = 'folder') GROUP BY status", _IGNORED)
def workspace_listing(spark, d):
    """Names and sizes, and the first bytes of each file."""
    return scan.status_counts(scan.list_files(spark, _workspace(spark, d)).where("path <> '.gitignore'"))


@query("SELECT path, sha256(text) AS hash, strlen(text)::BIGINT AS size, 'markdown' AS language FROM ws WHERE status = 'accepted'", _IGNORED)
def stored_index(spark, d):
    """An index of the workspace, written, verified and read again."""
    from ..api import Codebase

    root = _workspace(spark, d)
    code = Codebase(spark, root, index_path=f"{root}.index")
    code.index()
    files = store.read(spark, code.index_path, code.uid, verify=True).files
    return files.where("path <> '.gitignore'").select("path", "hash", "size", "language")


@query("SELECT 'first' AS run, (SELECT count(*) FROM ws WHERE status = 'accepted')::BIGINT AS added, 0::BIGINT AS unchanged UNION ALL SELECT 'second', 0, (SELECT count(*) FROM ws WHERE status = 'accepted')", _IGNORED)
def index_runs(spark, d):
    """What two runs over one workspace report."""
    from ..api import Codebase

    root = _workspace(spark, d)
    code = Codebase(spark, root, index_path=f"{root}.index", include=None, patterns=[".gitignore"])
    rows = [(name, got["added"], got["unchanged"]) for name, got in (("first", code.index()), ("second", code.index()))]
    code.remove()
    return spark.createDataFrame(rows, "run string, added long, unchanged long")


@query("SELECT 'owner/repo' || CASE (SELECT max(batch) FROM w) WHEN 0 THEN '' ELSE ' · part ' || (batch + 1) || ' of ' || ((SELECT max(batch) FROM w) + 1) END AS label, batch AS part, count(*)::BIGINT AS files, left(sha256('owner/repo' || chr(0) || 'part-' || (batch + 1)), 32) AS uid, 'owner/repo' AS grp FROM w GROUP BY batch",
       "o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents)",
       "w AS (SELECT i, 1 AS n, n_chars AS used, 0::BIGINT AS batch FROM o WHERE i = 1 UNION ALL SELECT o.i, CASE WHEN w.n >= 100 OR w.used + o.n_chars > 100000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 100 OR w.used + o.n_chars > 100000 THEN o.n_chars ELSE w.used + o.n_chars END, CASE WHEN w.n >= 100 OR w.used + o.n_chars > 100000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.i = w.i + 1)")
def repository_parts(spark, d):
    docs = td.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("size"))
    return reports.repository_parts(docs, "owner/repo", max_items=100, max_bytes=100_000).select("label", "part", "files", "uid", F.col("indexGroup").alias("grp"))
