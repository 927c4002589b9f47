"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import clustering, exact_dedup, filter_audit, html_text, language, line_dedup, mixing, near_dedup, secrets, substring_dedup, suffix_dedup, url_filter
from ._store import table

#: Target weights of the mixture; sources that are not named share "*".
WEIGHTS = {**{f"src{i}": 1.0 for i in range(20)}, "src0": 4.0, "src1": 2.0, "src2": 1.5, mixing.OTHERS: 0.5}
MIX_BLOCK, MIX_PERIOD = 16, 1000

URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), smallest=False)
    return groups.withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decon.n_hit("hit_ranges")
    return found.select(
        "doc_id", F.col("hit_words").alias("n_words"), hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.training_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    is_base = lambda s: s["kind"] != "markov"
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.filter("secrets", is_base)).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, block=MIX_BLOCK, period=MIX_PERIOD)
    return out.select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset", "mix_on_target", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_chars"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(docs.select("doc_id", "text", "lang").where(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings")).drop("exact")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM sh GROUP BY doc_id),
c AS (SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY same),
r AS (SELECT rep, n, g FROM c JOIN sh ON doc_id = rep),
l AS (SELECT a.rep AS x, b.rep AS y FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
k AS (SELECT x AS rep, least(x, min(y)) AS comp FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp, c.rep, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(comp, c.rep, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (same) LEFT JOIN k USING (rep)
"""

OP4_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM iw),
occ AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, occ.k, i, item_id FROM occ JOIN iw ON occ.gram = iw.gram AND occ.k = iw.k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, '{_EMPTY_SHA}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(lines[i : i + 2], chr(10)) AS win FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w WHERE length(regexp_replace(win, '[\\t\\n\\x0B\\f\\r ]', '', 'g')) > 0),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _op8_sql() -> str:
    share = mixing.shares(WEIGHTS, MIX_PERIOD)
    plan = ", ".join(f"('{s}', {i}, {slot}, {release}, {deadline})" for s, i, slot, release, deadline in mixing.schedule(share))
    parts = ", ".join(f"('{s}', {n})" for s, n in share.items())
    named = ", ".join(f"'{s}'" for s in share if s != mixing.OTHERS)
    return f"""
WITH plan(src, i, slot, rel, due) AS (VALUES {plan}), share(src, n) AS (VALUES {parts}),
r AS (SELECT doc_id, text, CASE WHEN source IN ({named}) THEN source ELSE '{mixing.OTHERS}' END AS src FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS rank FROM r),
b AS (SELECT k.*, rank // {MIX_BLOCK} AS b0, n FROM k JOIN share USING (src)),
ends AS (SELECT min((c // {MIX_BLOCK} // n) * {MIX_PERIOD} + slot) AS horizon
         FROM (SELECT share.src, n, count(r.src) AS c FROM share LEFT JOIN r ON r.src = share.src GROUP BY ALL) JOIN plan USING (src) WHERE plan.i = (c // {MIX_BLOCK}) % n + 1)
SELECT doc_id, src AS mix_source, (b0 + 1)::BIGINT AS mix_block, ((b0 // n) * {MIX_PERIOD} + slot)::BIGINT AS mix_slot, ((b0 // n) * {MIX_PERIOD} + rel)::BIGINT AS mix_release,
       ((b0 // n) * {MIX_PERIOD} + due)::BIGINT AS mix_deadline, (rank % {MIX_BLOCK})::BIGINT AS mix_offset, (b0 // n) * {MIX_PERIOD} + slot < horizon AS mix_on_target, length(coalesce(text, ''))::BIGINT AS text_chars
FROM b JOIN plan USING (src), ends WHERE plan.i = b0 % n + 1
"""


OP9_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT page_id, arg_max(r_host || r_path, 1000000 * len(string_split(r_host, '.')) + length(r_path)) AS rule, arg_max(r_verdict, 1000000 * len(string_split(r_host, '.')) + length(r_path)) AS v
      FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b * 2000 AS lo, substr(h, b * 4000 + 1, 4198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 4000 + 1)) AS b FROM d)),
s AS (SELECT doc_id, lo + i AS p, md5(substr(part, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, lo, part, unnest(range(0, least(2000, length(part) // 2 - 99))) AS i FROM blocks)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM s) WHERE nth > 1),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
         FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM late)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k, max(n) AS n_spans, max(gone) AS n_removed
         FROM (SELECT doc_id, h, hi AS a, coalesce(lead(lo) OVER w, length(h) // 2) AS b, count(*) OVER (PARTITION BY doc_id) AS n, sum(hi - lo) OVER (PARTITION BY doc_id) AS gone FROM runs JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
               UNION ALL SELECT doc_id, h, 0, min(lo), 0, 0 FROM runs JOIN d USING (doc_id) GROUP BY doc_id, h) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = """
WITH RECURSIVE m AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS toxic FROM m LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order, used) AS (SELECT '', 0 UNION ALL SELECT filter_order || x, used + bit FROM o JOIN (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit) ON used & bit = 0),
s AS (SELECT filter_order, step, list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda c: CASE c WHEN '' THEN 0 ELSE 1 << (ascii(c) - 65) END))::INT AS before, 1 << (ascii(filter_order[step]) - 65) AS bit
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (before | bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit > 0) AS removed, sum(n) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant,
             sum(n) FILTER (fails = bit) AS alone, sum(good) FILTER (fails & before = 0 AND fails & bit > 0) AS good, sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0) AS toxic FROM g, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails,
       coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def _op13_sql() -> str:
    k, scale = clustering.CENTROIDS, clustering.SCALE
    near = lambda c: f"SELECT DISTINCT ON (r) r, j, sum((x - c) * (x - c)) AS d FROM v JOIN {c} USING (i) GROUP BY r, j ORDER BY r, d, j"
    ctes = [
        f"""e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIMENSIONS})""",
        f"v AS MATERIALIZED (SELECT r, i, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT r, embedding, unnest(range(1, {clustering.DIMENSIONS + 1})) AS i FROM e))",
        f"c0 AS MATERIALIZED (SELECT j, i, x AS c FROM v JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id)) - 1 AS j FROM e ORDER BY j LIMIT {k}) USING (r))",
    ]
    for n in range(1, clustering.ROUNDS + 1):
        old = f"c{n - 1}"
        ctes.append(f"a{n} AS MATERIALIZED ({near(old)})")
        ctes.append(f"c{n} AS MATERIALIZED (SELECT j, i, coalesce(m, c) AS c FROM {old} LEFT JOIN (SELECT j, i, floor(sum(x) / count(*))::BIGINT AS m FROM v JOIN a{n} USING (r) GROUP BY j, i) USING (j, i))")
    last = f"c{clustering.ROUNDS}"
    return f"""WITH {", ".join(ctes)}, a AS MATERIALIZED ({near(last)}), h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS h FROM {last} GROUP BY j)
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a JOIN e USING (r) JOIN h USING (j)"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_minhash_near_dedup, op3_html_extraction, op4_decontamination, op5_secret_scan, op6_line_dedup, op7_substring_dedup,
        op8_source_mixing, op9_url_filter, op10_language_id, op11_suffix_dedup, op12_filter_audit, op13_centroid_clustering, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_source_mixing": _op8_sql(), "op9_url_filter": OP9_SQL,
        "op11_suffix_dedup": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_centroid_clustering": _op13_sql(),
    }
