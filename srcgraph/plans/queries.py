"""Every operator as a query over the synthetic tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, normalize_target
from ..operators import context, detectors, graph, incremental, lookup, reports, resolve, search
from ..operators.extract import text_chunks
from . import testdata as td
from .registry import QUERIES, SQL, query

QUERY = "the onthe für éoi tion"
NEEDLE = "red"
NAME = "red widget"
_TERM = r"[\p{L}\p{N}_$.\-]+"

_FILES = rf"""
files AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || doc_id || '.md' AS path, coalesce(lang, 'none') AS language, n_chars AS size, doc_id AS ord,
          list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_TERM}')) AS terms, coalesce(text, '') AS text FROM documents)"""
_SYMBOLS = """
symbols AS (SELECT 'P' || p_partkey AS id, replace(p_brand, '#', '') || '/' || lower(p_type) || '/m' || (p_partkey % 7) || '.ts' AS filePath, p_name AS name, 'method' AS kind, p_size AS startLine, p_partkey AS ord FROM part
            UNION ALL SELECT 'S' || s_suppkey, 'nations/' || n_name || '.ts', s_name, 'class', 1, s_suppkey + 100000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_RELATIONS = """
relations AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'extends' ELSE 'references' END AS kind, 'nations/' || n_name || '.ts' AS filePath,
              'S' || l_suppkey AS fromSymbolId, 'P' || l_partkey AS toSymbolId, p_name AS targetName, l_linenumber AS line, 1 - l_discount AS confidence, l_orderkey * 10 + l_linenumber AS ord
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_CHUNKS = """
chunks AS (SELECT path AS filePath, i AS startLine, line AS text, sha256(line) AS hash, ord * 100000 + i - 1 AS ord
           FROM (SELECT path, ord, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files))"""
_TRADE = """
trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""
_PARTNERS = _TRADE + """,
e AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM trade) WHERE r <= 2)"""
_Q = "('" + "'), ('".join(QUERY.split()) + "')"

def long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


# Search

_SCORES = f"""
q AS (SELECT * FROM (VALUES {_Q}) t(term)),
hits AS (SELECT path, 2.0::DOUBLE AS s FROM files, q WHERE list_contains(terms, term) UNION ALL SELECT path, 1.0 FROM files, q WHERE contains(lower(path), term))"""


@query("SELECT path, sum(s)::DOUBLE AS score FROM hits GROUP BY path ORDER BY score DESC, path LIMIT 25", _FILES, _SCORES)
def lexical_search_topk(spark, d):
    return search.search(td.snapshot(spark, d), QUERY, 25)


_OWN = """
own AS (SELECT path, replace(p_name, ' ', '.') AS name FROM files JOIN part ON p_partkey = ord)"""


def _with_names(spark, d):
    s = td.snapshot(spark, d)
    parts = td.read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.lit("").alias("id"))
    return s.with_(symbols=s.files.select(F.col("path").alias("filePath"), "ord").join(parts, "ord"))


@query(
    """SELECT path, sum(s)::DOUBLE AS score FROM (SELECT * FROM hits UNION ALL SELECT DISTINCT path, 4.0 FROM own, q WHERE contains(lower(name), term)) GROUP BY path ORDER BY score DESC, path LIMIT 25""",
    _FILES, _SCORES.replace(_Q, "('red'), ('widget'), ('the')"), _OWN,
)
def lexical_search_any_symbol(spark, d):
    return search.search(_with_names(spark, d), "red widget the", 25, any_symbol=True)


@query(
    """SELECT path, sum(s)::DOUBLE AS score FROM (SELECT * FROM hits UNION ALL SELECT path, 4.0 FROM own, q WHERE contains(lower(name), term)) GROUP BY path ORDER BY score DESC, path LIMIT 25""",
    _FILES, _SCORES.replace(_Q, "('red'), ('widget'), ('the')"), _OWN,
)
def lexical_search_each_symbol_term(spark, d):
    return search.search(_with_names(spark, d), "red widget the", 25)


@query("SELECT filePath, count(*)::BIGINT AS n_terms, min(term) AS first_term, max(term) AS last_term FROM (SELECT path AS filePath, unnest(terms) AS term FROM files) GROUP BY filePath", _FILES)
def term_inverted_index(spark, d):
    return td.snapshot(spark, d).file_terms.groupBy("filePath").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


@query("SELECT term, count(*)::BIGINT AS n_files FROM (SELECT unnest(terms) AS term FROM files) GROUP BY term", _FILES)
def term_doc_frequency(spark, d):
    return td.snapshot(spark, d).file_terms.groupBy("term").agg(F.count("*").alias("n_files"))


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q0 AS (SELECT e AS q FROM v WHERE vec_id = 0)"


def _query_vector(spark, d):
    return [float(x) for x in td.read(spark, d, "embeddings").where("vec_id = 0").first().embedding]


@query(
    """, lex AS (SELECT path, sum(s)::DOUBLE AS score FROM hits GROUP BY path ORDER BY score DESC, path LIMIT 20),
sem AS (SELECT path, round(list_cosine_similarity(e, q), 9) AS c FROM v JOIN files ON files.ord = vec_id, q0 ORDER BY c DESC, vec_id LIMIT 20),
f AS (SELECT path, 0.5 * score / greatest(1, (SELECT max(score) FROM lex)) AS s, row_number() OVER (ORDER BY score DESC, path) AS k FROM lex UNION ALL SELECT path, 0.5 * (c + 1) / 2, 1000000 + row_number() OVER (ORDER BY c DESC, path) FROM sem)
SELECT path, round(score, 5) AS score FROM (SELECT path, sum(s) AS score, min(k) AS k FROM f GROUP BY path) ORDER BY score DESC, k LIMIT 10""",
    _FILES, _SCORES, _VEC,
)
def hybrid_fusion(spark, d):
    s = td.snapshot(spark, d)
    chunk = s.files.select(F.col("ord").cast("string").alias("id"), F.col("path").alias("filePath"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"), F.lit("").alias("text"), "ord")
    s = s.with_(chunks=chunk)
    return search.hybrid_search(s, QUERY, _query_vector(spark, d), 10).select("path", F.round("score", 5).alias("score"))


# Lookups


@query("SELECT id, name, filePath FROM symbols WHERE contains(lower(name), 'red')", _SYMBOLS)
def symbol_substring_lookup(spark, d):
    return lookup.find_symbols(td.snapshot(spark, d), NEEDLE).select("id", "name", "filePath")


@query("SELECT path, language, size FROM files WHERE language = 'fr' AND (contains(lower(path), 'src1') OR contains(lower(language), 'src1') OR len(list_filter(terms, lambda t: contains(t, 'src1'))) > 0)", _FILES)
def language_filter_files(spark, d):
    return lookup.filter_files(td.snapshot(spark, d), "src1", "fr").select("path", "language", "size")


@query("SELECT id, filePath, line FROM relations WHERE lower(targetName) = 'red widget'", _SYMBOLS, _RELATIONS)
def find_references(spark, d):
    return lookup.find_references(td.snapshot(spark, d), NAME).select("id", "filePath", *[F.col("line")])


@query("SELECT r.id, r.filePath, r.line FROM relations r JOIN symbols s ON toSymbolId = s.id WHERE r.kind = 'calls' AND lower(name) = 'red widget'", _SYMBOLS, _RELATIONS)
def find_callers(spark, d):
    return lookup.find_callers(td.snapshot(spark, d), NAME).select("id", "filePath", "line")


@query("SELECT r.id, r.filePath, r.line FROM relations r JOIN symbols s ON fromSymbolId = s.id WHERE r.kind = 'calls' AND lower(name) = 'supplier#000000003'", _SYMBOLS, _RELATIONS)
def find_callees(spark, d):
    return lookup.find_callees(td.snapshot(spark, d), "Supplier#000000003").select("id", "filePath", "line")


@query(
    """SELECT r.id, f.name AS fromName, t.name AS toName FROM relations r LEFT JOIN symbols f ON fromSymbolId = f.id LEFT JOIN symbols t ON toSymbolId = t.id
WHERE r.kind = 'extends' AND (contains(lower(targetName), 'small') OR contains(lower(r.filePath), 'small') OR contains(lower(f.name), 'small') OR contains(lower(t.name), 'small'))""",
    _SYMBOLS, _RELATIONS,
)
def references_filtered(spark, d):
    return lookup.filter_references(td.snapshot(spark, d), "small", "extends").select("id", "fromName", "toName")


@query(
    """SELECT r.id, r.kind, f.name AS fromName, t.name AS toName FROM relations r LEFT JOIN symbols f ON fromSymbolId = f.id LEFT JOIN symbols t ON toSymbolId = t.id
WHERE lower(targetName) = 'red widget' OR lower(f.name) = 'red widget' OR lower(t.name) = 'red widget'""",
    _SYMBOLS, _RELATIONS,
)
def symbol_relations(spark, d):
    return lookup.symbol_relations(td.snapshot(spark, d), NAME).select("id", "kind", "fromName", "toName")


@query(", c AS (SELECT id FROM symbols WHERE contains(lower(name), 'red widget') ORDER BY lower(name) <> 'red widget', ord LIMIT 1) SELECT 'caller' AS side, r.id FROM relations r, c WHERE kind = 'calls' AND toSymbolId = c.id UNION ALL SELECT 'callee', r.id FROM relations r, c WHERE kind = 'calls' AND fromSymbolId = c.id", _SYMBOLS, _RELATIONS)
def call_graph(spark, d):
    return lookup.call_graph(td.snapshot(spark, d), NAME).select("side", "id")


@query("SELECT filePath, startLine::BIGINT AS startLine, text FROM chunks WHERE contains(lower(text), 'onthe') OR contains(lower(filePath), 'onthe') OR contains(hash, 'onthe') ORDER BY ord LIMIT 40 OFFSET 5", _FILES, _CHUNKS)
def chunk_page(spark, d):
    return lookup.get_chunks(td.snapshot(spark, d), query="onthe", limit=40, offset=5).select("filePath", *long("startLine"), "text")


# Reports


@query("SELECT kind, count(*)::BIGINT AS n FROM relations GROUP BY kind", _SYMBOLS, _RELATIONS)
def relation_kind_counts(spark, d):
    return reports.relation_kind_counts(td.snapshot(spark, d))


_PAGES = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
_KIND = r"""CASE WHEN regexp_matches(path, '(^|/)(test|tests|__tests__|spec|specs)(/|$)') THEN 'test'
WHEN regexp_matches(path, '(^|[^A-Za-z0-9_])(package\.json|tsconfig\.json|jsconfig\.json|pyproject\.toml|requirements\.txt|Cargo\.toml|go\.mod|pom\.xml|build\.gradle|CMakeLists\.txt|docker-compose\.|Dockerfile|\.env|eslint|prettier|vite|webpack|next|babel|rollup|turbo|nx)', 'i') THEN 'config'
WHEN regexp_matches(path, '(^|/)(docs?|documentation|readme|guides)(/|$)', 'i') THEN 'docs'
WHEN regexp_matches(path, '(^|/)(infra|infrastructure|deploy|ops|kubernetes|helm|docker|scripts|ci|cd|terraform)(/|$)', 'i') THEN 'infra'
WHEN regexp_matches(lower(path), 'src|lib|app|pkg') THEN 'source' ELSE 'unknown' END"""


def _pages(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    s = td.snapshot(spark, d)
    return s.with_(files=td.read(spark, d, "pages").select(path.alias("path"), F.col("page_id").alias("ord")), symbols=s.symbols.where("false"))


@query(
    f""", a AS (SELECT path, page_id, {_KIND} AS kind, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
SELECT seg[1] AS name, array_to_string(seg[1:2], '/') AS path, arg_min(kind, page_id) AS kind, count(*)::BIGINT AS files, 0::BIGINT AS symbols FROM a GROUP BY 1, 2""",
    _PAGES,
)
def repository_area_map(spark, d):
    return reports.repository_map(_pages(spark, d))


@query(", b AS (SELECT path, string_split(path, '/') AS seg FROM p) SELECT folder, count(*)::BIGINT AS files FROM (SELECT array_to_string(seg[1:i], '/') AS folder FROM (SELECT seg, unnest(range(1, len(seg))) AS i FROM b)) GROUP BY folder", _PAGES)
def folder_file_counts(spark, d):
    return reports.folder_counts(_pages(spark, d))


def _coded(spark, d):
    """A file for every path of a symbol."""
    s = td.snapshot(spark, d)
    files = s.symbols.groupBy(F.col("filePath").alias("path")).agg(F.min("ord").alias("ord"), (F.count("*") * 700).cast("long").alias("size"))
    return s.with_(files=files)


_CODED = "cf AS (SELECT filePath AS path, min(ord) AS ord, count(*) * 700 AS size FROM symbols GROUP BY filePath)"


@query(
    """SELECT path, coalesce(s, 0)::BIGINT AS symbolCount, coalesce(i, 0)::BIGINT AS fanIn, coalesce(o, 0)::BIGINT AS fanOut, floor(greatest(10, size / 35) + 0.5)::BIGINT AS loc,
floor(1 + 1.5 * coalesce(s, 0) + 0.8 * coalesce(o, 0) + 0.5)::BIGINT AS cyclomatic FROM cf
LEFT JOIN (SELECT filePath AS path, count(*) AS s FROM symbols GROUP BY 1) USING (path) LEFT JOIN (SELECT filePath AS path, count(*) AS o FROM relations GROUP BY 1) USING (path)
LEFT JOIN (SELECT s.filePath AS path, count(*) AS i FROM relations JOIN symbols s ON toSymbolId = s.id GROUP BY 1) USING (path)""",
    _SYMBOLS, _RELATIONS, _CODED,
)
def complexity_report(spark, d):
    return reports.complexity(_coded(spark, d)).select("path", *long("symbolCount", "fanIn", "fanOut", "loc", "cyclomatic"))


@query("SELECT hash, count(*)::BIGINT AS count, min(ord)::BIGINT AS first FROM chunks WHERE length(trim(text, E' \\t\\n\\r\\x0B\\f')) > 30 GROUP BY hash HAVING count(*) > 1", _FILES, _CHUNKS)
def duplicate_groups(spark, d):
    return reports.duplicate_chunks(td.snapshot(spark, d))


@query("SELECT regexp_replace(filePath, '/[^/]*$', '') AS module, filePath AS file, count(*)::BIGINT AS symbols, count(DISTINCT filePath)::BIGINT AS files FROM symbols GROUP BY ROLLUP (module, file)", _SYMBOLS)
def module_rollup(spark, d):
    return reports.module_rollup(td.snapshot(spark, d))


@query(
    """SELECT regexp_replace(f.filePath, '/[^/]*$', '') AS "from", regexp_replace(t.filePath, '/[^/]*$', '') AS "to", r.kind, count(*)::BIGINT AS n FROM relations r JOIN symbols f ON fromSymbolId = f.id JOIN symbols t ON toSymbolId = t.id
WHERE regexp_replace(f.filePath, '/[^/]*$', '') <> regexp_replace(t.filePath, '/[^/]*$', '') GROUP BY ALL""",
    _SYMBOLS, _RELATIONS,
)
def module_edges(spark, d):
    return reports.module_edges(td.snapshot(spark, d))


@query("SELECT (SELECT count(*) FROM relations WHERE fromSymbolId NOT IN (SELECT id FROM symbols WHERE ord % 9 <> 0))::BIGINT + (SELECT count(*) FROM relations WHERE toSymbolId NOT IN (SELECT id FROM symbols WHERE ord % 9 <> 0))::BIGINT AS brokenReferences, (SELECT count(*) FROM (SELECT * FROM files ORDER BY ord LIMIT 50) WHERE language = 'fr')::BIGINT AS missingFiles", _FILES, _SYMBOLS, _RELATIONS)
def health_check(spark, d):
    s = td.snapshot(spark, d)
    return reports.health(s.with_(symbols=s.symbols.where("ord % 9 <> 0")), s.files.where("language <> 'fr'"))


@query(
    "SELECT s.id, s.name AS testSymbol, (SELECT arg_min(o.name, (o.ord, o.name)) FROM t o WHERE o.name <> s.name AND contains(lower(s.name), lower(o.name))) AS targetSymbol, 'jest / node:test / vitest' AS framework FROM symbols s",
    _SYMBOLS, "t AS (SELECT name, min(ord) AS ord FROM (SELECT name, ord FROM symbols UNION ALL SELECT r_name, r_regionkey FROM region UNION ALL SELECT right(s_name, 2), 50 + s_suppkey FROM supplier) GROUP BY name)",
)
def test_symbol_link(spark, d):
    s = td.snapshot(spark, d)
    one = s.symbols.withColumn("filePath", F.concat(F.lit("tests/"), "id", F.lit(".ts")))
    two = td.read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"))
    three = td.read(spark, d, "supplier").select(F.right("s_name", F.lit(2)).alias("name"), (F.col("s_suppkey") + 50).alias("ord"))
    others = two.unionByName(three).select(F.lit("o").alias("id"), F.lit("lib/x.ts").alias("filePath"), "name", "ord")
    out = reports.test_links(s.with_(symbols=one.select("id", "filePath", "name", "ord").unionByName(others)))
    return out.select(F.regexp_extract("testFile", "tests/(.*).ts", 1).alias("id"), "testSymbol", "targetSymbol", "framework")


@query(
    """SELECT regexp_extract(path, '[^/]*$') AS name, CASE WHEN path LIKE '%.prisma' THEN 'prisma' WHEN path LIKE '%.sql' OR contains(path, '/migrations/') OR contains(path, '/migrate/') THEN 'sql' ELSE 'orm' END AS kind, path AS filePath,
CASE WHEN path LIKE '%.prisma' THEN 'Prisma Schema' WHEN path LIKE '%.sql' OR contains(path, '/migrations/') OR contains(path, '/migrate/') THEN 'SQL Schema / Migration' ELSE 'ORM Model' END AS tableOrModel
FROM m WHERE path LIKE '%.prisma' OR path LIKE '%.sql' OR contains(path, '/migrations/') OR contains(path, '/migrate/') OR regexp_matches(path, 'model|entity|schema')""",
    "m AS (SELECT ['a/schema', 'db/migrations/', 'x/', 'models/', 'q/'][1 + page_id % 5] || page_id || ['.prisma', '.sql', '.ts'][1 + page_id % 3] AS path FROM pages)",
)
def db_schema_detect(spark, d):
    i = F.col("page_id")
    head = F.element_at(F.array(*map(F.lit, ("a/schema", "db/migrations/", "x/", "models/", "q/"))), (1 + i % 5).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, (".prisma", ".sql", ".ts"))), (1 + i % 3).cast("int"))
    s = td.snapshot(spark, d)
    return reports.database_models(s.with_(files=td.read(spark, d, "pages").select(F.concat(head, i.cast("string"), tail).alias("path"))))


@query("SELECT path AS filePath, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS title, coalesce(links, '') AS links FROM files LEFT JOIN (SELECT path, array_to_string((list(name ORDER BY ord))[1:5], '|') AS links FROM (SELECT files.path, w.name, w.ord FROM files JOIN w ON list_contains(files.terms, lower(w.name))) GROUP BY path) USING (path)", _FILES, "w AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM (SELECT DISTINCT term AS name FROM (SELECT unnest(terms) AS term FROM files) WHERE length(term) > 3 ORDER BY term LIMIT 100))")
def config_doc_detect(spark, d):
    s = td.snapshot(spark, d)
    words = s.files.select(F.explode("terms").alias("name")).distinct().where("length(name) > 3").orderBy("name").limit(100)
    names = words.withColumn("ord", F.row_number().over(Window.orderBy("name")).cast("long"))  # of a hundred rows
    return reports.docs(s.with_(symbols=names)).select("filePath", "title", F.array_join("linkedSymbols", "|").alias("links"))


@query("""SELECT ord::BIGINT AS ord, '"' || replace(name, '"', '""') || '",' || kind || ',"' || filePath || '",' || startLine || ',' || CASE kind WHEN 'class' THEN 9 ELSE startLine + 5 END AS line FROM symbols UNION ALL SELECT -1, 'Name,Kind,FilePath,StartLine,EndLine'""", _SYMBOLS)
def export_symbols_csv(spark, d):
    return reports.symbols_csv(td.snapshot(spark, d))


@query(
    """, g AS (SELECT doc_id, coalesce(source, 'none') AS grp, (doc_id % 10)::INTEGER AS part, n_chars FROM documents)
SELECT grp AS indexGroup, sum(n_chars)::BIGINT AS fileCount, count(*)::BIGINT AS symbolCount, sum(part)::BIGINT AS relationCount, 0::BIGINT AS chunkCount, arg_min(doc_id, part * 10000000 + doc_id)::VARCHAR AS uid FROM g GROUP BY grp""".lstrip(", "),
)
def part_rollup(spark, d):
    docs = td.read(spark, d, "documents")
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("indexGroup"), F.col("n_chars").alias("fileCount"), F.lit(1).cast("long").alias("symbolCount"), (F.col("doc_id") % 10).alias("relationCount"), F.lit(0).cast("long").alias("chunkCount"), F.col("doc_id").cast("string").alias("uid"), (F.col("doc_id") % 10 * 10_000_000 + F.col("doc_id")).alias("indexPart"), F.lit("").alias("indexPath"))
    return reports.sum_parts(rows).drop("indexPath")


@query(", r AS (SELECT doc_id, n_chars, 0::BIGINT AS x FROM documents), o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM r), w AS (SELECT i, doc_id, 1 AS n, n_chars AS used, 0::BIGINT AS batch FROM o WHERE i = 1 UNION ALL SELECT o.i, o.doc_id, CASE WHEN w.n >= 30 OR w.used + o.n_chars > 60000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 30 OR w.used + o.n_chars > 60000 THEN o.n_chars ELSE w.used + o.n_chars END, CASE WHEN w.n >= 30 OR w.used + o.n_chars > 60000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.i = w.i + 1) SELECT doc_id, batch FROM w".lstrip(", "))
def partition_batches(spark, d):
    docs = td.read(spark, d, "documents").select("doc_id", "n_chars")
    return reports.pack_batches(docs, "n_chars", "doc_id", 30, 60_000).select("doc_id", "batch")


SQL["partition_batches"] = "WITH RECURSIVE " + SQL["partition_batches"]
SQL["part_rollup"] = "WITH " + SQL["part_rollup"]


# Detectors


@query(
    r""", l AS (SELECT path AS filePath, unnest(string_split_regex(text, '\r?\n')) AS raw, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS line FROM files WHERE length(text) > 0),
t AS (SELECT filePath, line, trim(raw, E' \t\n\r\x0B\f') AS x FROM l),
k AS (SELECT *, 'credential' AS kind FROM t WHERE regexp_matches(x, '(api[_-]?key|access[_-]?token|secret|private[_-]?key|password|credential|token)', 'i')
      UNION ALL SELECT *, 'private-key' FROM t WHERE regexp_matches(x, 'BEGIN\s+(RSA\s+)?PRIVATE\s+KEY', 'i') UNION ALL SELECT *, 'api-key' FROM t WHERE regexp_matches(x, '(aws|github|slack|stripe|openai|auth0)[-_]?(key|token)', 'i'))
SELECT filePath, line::BIGINT AS line, kind, 0.75::DOUBLE AS confidence, left(regexp_replace(x, '(?s)^(.*?)(:|=|\s+)([''"]?)[^\s''"]+', '\1\2\3[redacted]'), 160) AS snippet FROM k""",
    _FILES,
)
def sensitive_regions(spark, d):
    texts = td.read(spark, d, "documents").select(td.doc_path().alias("filePath"), "text")
    return detectors.sensitive_lines(texts).select("filePath", *long("line"), "kind", F.col("confidence").cast("double").alias("confidence"), "snippet")


def _intent_sql() -> str:
    from ..functions.text import LEFT, RIGHT

    cases = " ".join("WHEN regexp_matches(x, '" + p.replace(LEFT, r"\b").replace(RIGHT, r"\b").replace("'", "''") + f"') THEN '{k}|{c}'" for k, c, p, _ in detectors.INTENTS)
    return f"""WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, {_PHRASE_SQL} || lower(coalesce(text, '')) AS x FROM conversations),
a AS (SELECT conv_id, turn, CASE WHEN trim(x) = '' THEN 'semantic|0.2' {cases} ELSE 'symbol|0.65' END AS a FROM q)
SELECT conv_id, turn, string_split(a, '|')[1] AS kind, string_split(a, '|')[2]::DOUBLE AS confidence FROM a"""


_PHRASES = ["", "who calls ", "callee of ", "where is ", "references to ", "what depends on ", "architecture of ", "tests for ", "api of ", "settings in ", "recent changes in "]
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + f"][1 + (conv_id + turn) % {len(_PHRASES)}]"
SQL["query_intent"] = _intent_sql()


@query()
def query_intent(spark, d):
    rows = td.read(spark, d, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (1 + (F.col("conv_id") + F.col("turn")) % len(_PHRASES)).cast("int"))
    asked = F.concat(phrase, F.lower(F.coalesce("text", F.lit(""))))
    return rows.select("conv_id", "turn", detectors.query_intent(asked).alias("i")).select("conv_id", "turn", "i.kind", F.col("i.confidence").cast("double").alias("confidence"))


@query()
def chunk_documents(spark, d):
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [c for path, text in zip(frame["path"], frame["text"]) for c in text_chunks(path, text or "")]
            yield pd.DataFrame([(c[0], c[1], c[3], c[4], c[5]) for c in rows], columns=["id", "filePath", "startLine", "endLine", "hash"])

    docs = td.read(spark, d, "documents").select(td.doc_path().alias("path"), "text")
    return docs.mapInPandas(run, "id string, filePath string, startLine int, endLine int, hash string")


@query(r"SELECT page_id, coalesce(nullif(list_last(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(\./|\.\./|/)', ''), '^[A-Za-z][A-Za-z0-9+.\-]*:', ''), '[?#].*$', ''), '/index$', ''), '\.[^/.]+$', ''), '/'), lambda x: x <> '')), ''), url) AS target FROM pages")
def path_normalize(spark, d):
    return td.read(spark, d, "pages").select("page_id", normalize_target(F.col("url")).alias("target"))


# Graphs


def _trade_snapshot(spark, d):
    """Nations as files and symbols, the partner graph as relations."""
    s = td.snapshot(spark, d)
    nation = td.read(spark, d, "nation")
    files = nation.select(F.concat(F.lit("n/"), "n_name", F.lit(".ts")).alias("path"), F.col("n_nationkey").cast("long").alias("ord"))
    symbols = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("n/"), "n_name", F.lit(".ts")).alias("filePath"), F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("parentId"), F.col("n_nationkey").cast("long").alias("ord"))
    names = nation.select(F.col("n_nationkey").alias("src"), F.concat(F.lit("n/"), "n_name", F.lit(".ts")).alias("filePath"))
    relations = td.partners(spark, d).join(F.broadcast(names), "src").select(
        F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id"), F.lit("calls").alias("kind"), "filePath", F.col("src").cast("string").alias("fromSymbolId"), F.col("dst").cast("string").alias("toSymbolId"),
        F.lit("t").alias("targetName"), F.lit(1).alias("line"), F.lit(0.7).alias("confidence"), (F.col("src") * 100 + F.col("dst")).cast("long").alias("ord"),
    )
    return s.with_(files=files, symbols=symbols, relations=relations)


@query("SELECT 'n/' || a.n_name || '.ts' AS fromFile, 'n/' || b.n_name || '.ts' AS toFile, count(*)::BIGINT AS n FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE src < 20 AND dst < 20 GROUP BY ALL", _PARTNERS)
def dependency_matrix(spark, d):
    return graph.dependency_matrix(_trade_snapshot(spark, d), 20)


@query("SELECT n_nationkey::VARCHAR AS id, ((SELECT count(*) FROM e WHERE src = n_nationkey) + (SELECT count(*) FROM e WHERE dst = n_nationkey))::BIGINT AS degree FROM nation ORDER BY degree DESC, n_name LIMIT 12", _PARTNERS)
def top_degree_graph(spark, d):
    return graph.relation_graph(_trade_snapshot(spark, d), 12)["nodes"].select("id", "degree")


@query(
    """, seed AS (SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_nationkey = 7),
r(node, depth) AS (SELECT k, 0 FROM seed UNION SELECT src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 3)
SELECT 'n/' || n_name || '.ts' AS filePath, min(depth)::BIGINT AS depth, 0.7::DOUBLE AS confidence FROM r JOIN nation ON n_nationkey = node WHERE node <> 7 GROUP BY 1""",
    _PARTNERS,
)
def change_impact_bfs(spark, d):
    s = _trade_snapshot(spark, d)
    name = td.read(spark, d, "nation").where("n_nationkey = 7").first().n_name
    return graph.change_impact(s, name, 3)["affectedFiles"].select("filePath", *long("depth"), "confidence")


@query("SELECT r.id, r.kind FROM relations r WHERE contains(lower(targetName), 'red widget') OR r.fromSymbolId IN (SELECT id FROM symbols WHERE lower(name) = 'red widget') OR contains('red widget', lower(targetName))", _SYMBOLS, _RELATIONS)
def dependency_relations(spark, d):
    return graph.dependency_relations(_coded(spark, d), NAME).select("id", "kind")


@query(", r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src) SELECT x.a::BIGINT AS node, min(x.b)::BIGINT AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1", _PARTNERS)
def scc(spark, d):
    return graph.strongly_connected(td.partners(spark, d).select("src", "dst")).select(*long("node", "component"))


@query("SELECT id, arg_min(side, ord * 2 + (side = 'out')::INT) AS side, min(ord)::BIGINT AS edgeOrd FROM (SELECT dst::VARCHAR AS id, 'out' AS side, src * 100 + dst AS ord FROM e WHERE src = 7 UNION ALL SELECT src::VARCHAR, 'in', src * 100 + dst FROM e WHERE dst = 7) GROUP BY id", _PARTNERS)
def radial_graph(spark, d):
    name = td.read(spark, d, "nation").where("n_nationkey = 7").first().n_name
    s = _trade_snapshot(spark, d)
    return graph.radial_graph(s.with_(symbols=s.symbols.withColumn("ord", F.when(F.col("id") == "7", -1).otherwise(F.col("ord")).cast("long"))), name).select("id", "side", "edgeOrd")


@query("SELECT src::VARCHAR || '>' || dst AS id FROM e WHERE src < 15 AND dst < 15", _PARTNERS)
def flow_graph(spark, d):
    return graph.flow_graph(_trade_snapshot(spark, d), 15)["edges"].select("id")


@query()
def graph_cycles(spark, d):
    return graph.graph_cycles(_trade_snapshot(spark, d))


@query(
    """, d AS (SELECT ord::VARCHAR AS id, kind, filePath, CASE WHEN ord % 3 = 0 THEN toSymbolId WHEN ord % 3 = 1 THEN 'gone' END AS old, targetName, confidence FROM relations),
k AS (SELECT *, CASE WHEN old IN (SELECT id FROM symbols) THEN old END AS live, CASE WHEN old IS NOT NULL AND old NOT IN (SELECT id FROM symbols) THEN least(confidence, 0.5) ELSE confidence END AS c FROM d),
f AS (SELECT name, arg_min(id, filePath || lpad(startLine::VARCHAR, 9, '0') || id) AS id FROM symbols GROUP BY name)
SELECT k.id, CASE WHEN live IS NULL AND kind IN ('calls', 'extends') THEN f.id ELSE live END AS toSymbolId, round(CASE WHEN live IS NULL AND kind IN ('calls', 'extends') AND f.id IS NOT NULL THEN 0.72 ELSE c END, 6)::DOUBLE AS confidence
FROM k LEFT JOIN f ON targetName = name""",
    _SYMBOLS, _RELATIONS,
)
def resolve_relations(spark, d):
    s = td.snapshot(spark, d)
    to = F.when(F.col("ord") % 3 == 0, F.col("toSymbolId")).when(F.col("ord") % 3 == 1, F.lit("gone"))
    rows = s.relations.withColumn("toSymbolId", to).withColumn("id", F.col("ord").cast("string"))
    return resolve.resolve_relations(rows, s.symbols).select("id", "toSymbolId", F.round("confidence", 6).cast("double").alias("confidence"))


# Refresh and context


@query("SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'deleted' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 = 0)")
def incremental_diff(spark, d):
    orders = td.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"), F.col("o_orderkey").alias("k"))
    now = orders.withColumn("hash", F.when(F.col("k") % 3 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    return incremental.diff(orders.where("k % 7 <> 0"), now.where("k % 5 <> 0"))


@query(
    """, top AS (SELECT path FROM hits GROUP BY path ORDER BY sum(s) DESC, path LIMIT 4),
r AS (SELECT filePath, startLine, ord, text, (SELECT count(*) FROM q WHERE contains(lower(text), term)) AS score, ceil(length(text) / 4)::BIGINT AS cost FROM chunks WHERE filePath IN (SELECT path FROM top)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, startLine, ord) AS i FROM r),
w AS (SELECT i, filePath, startLine, cost, score, CASE WHEN cost <= 900 THEN cost ELSE 0 END AS used, cost <= 900 AS taken FROM o WHERE i = 1
      UNION ALL SELECT o.i, o.filePath, o.startLine, o.cost, o.score, CASE WHEN w.used + o.cost <= 900 THEN w.used + o.cost ELSE w.used END, w.used + o.cost <= 900 FROM w JOIN o ON o.i = w.i + 1)
SELECT filePath, startLine::BIGINT AS startLine, cost, score::BIGINT AS score FROM w WHERE taken""",
    _FILES, _CHUNKS, _SCORES.replace(_Q, "('the'), ('onthe'), ('tion')"),
)
def context_pack(spark, d):
    s, asked = td.snapshot(spark, d), "the onthe tion"
    return context.pack_files(s, context.choose_files(s, asked), asked, 900).select("filePath", *long("startLine"), "cost", "score")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
