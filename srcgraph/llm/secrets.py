"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame operations only. Two first-order models over printable ASCII are
trained from labelled samples, random strings against ordinary identifiers. A
long run of token characters is a secret when the mean ratio of their
likelihoods, in bits per transition, reaches the threshold. Of a run that does
not, parts are judged: those between its joints, and stretches over which the
sum of what exceeds the threshold rises.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import without

# The patterns of the base scan, and the least length of the part that counts. A greedy run that is
# too short ends where its characters end, so for the plain runs the least length can stand in the pattern.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
#: Runs that the Markov models judge, by length. They never span white space.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 1.0
#: Parts of such a run, between / = _ and -.
PART = "[A-Za-z0-9+]{20,}"
LEAST = 20
#: Distinct characters that a span of the models has at least; a rule of hyphens has one. Twenty random hexadecimal digits have fewer once in 90,000.
VARIETY = 6
#: Bits by which the sum falls below its peak where a stretch ends.
DROP = 10.0

#: Ordinary words of identifiers, and natural words of four languages; the ordinary samples are their combinations.
WORDS = (
    "get set add remove update delete create find list load store read write open close start stop init config user name type value key index count size "
    "length path file line column table row query result error message request response client server service handler manager factory builder controller "
    "model view data item node edge graph tree list map array string number parse format encode decode convert validate check test assert expected actual"
).split()
NATURAL = (
    "the house people water between through another because country school never under world should thought morning children without every again "
    "und nicht eine werden zwischen haus wasser menschen arbeit schule geschichte jahr freund strasse morgen kinder sprache verein gesellschaft wirtschaft "
    "les maison pour avec monde entre temps toujours enfant travail pendant histoire quelque ville jour petite grande lumiere politique question "
    "los casa para mundo tiempo entre ciudad siempre trabajo persona historia palabra camino durante pueblo gobierno familia nuestro grande"
).split()


def training_samples(spark: SparkSession, rows: int = 4096) -> DataFrame:
    """Labelled samples (text, label): 1 for random strings (base 64, hexadecimal, upper case or any case with digits), 0 for ordinary ones.

    Ordinary are identifiers of two to five words, of code or of natural
    language, in the usual spellings, some with a number. `rows` bounds either class.
    """
    n = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "\\s", "")
    upper = F.substring(F.regexp_replace(F.upper(b64), "[^A-Z0-9]", ""), 1, 24)
    random = F.element_at(F.array(F.substring(digest, 1, 40), upper, b64, F.regexp_replace(b64, "[^A-Za-z0-9]", "")), (F.col("id") % 4 + 1).cast("int"))
    words = F.when(F.col("id") % 2 == 0, F.array(*[F.lit(w) for w in WORDS])).otherwise(F.array(*[F.lit(w) for w in NATURAL]))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), k), F.size(words)) + 1).cast("int"))
    chosen = F.transform(F.sequence(F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(4)) + 2).cast("int")), pick)
    n = n.withColumn("chosen", chosen)
    capital = F.transform("chosen", lambda w: F.initcap(w))
    snake, camel = F.array_join("chosen", "_"), F.concat(F.col("chosen")[0], F.array_join(F.slice(capital, 2, 9), ""))
    spelt = F.array(snake, camel, F.array_join(capital, ""), F.upper(snake), F.array_join("chosen", ""), F.array_join("chosen", "-"), F.array_join("chosen", "/"))
    number = F.when(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5)) == 0, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3000)).cast("string")).otherwise("")
    ordinary = F.concat(F.element_at(spelt, (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(7)) + 1).cast("int")), number)
    return n.select(random.alias("text"), F.lit(1).alias("label")).unionByName(n.select(ordinary.alias("text"), F.lit(0).alias("label")))


def fit(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio in bits of each of 128 x 128 transitions, random over ordinary; one that neither class shows says nothing, 0."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = samples.where(F.length("text") > 1).select("label", "text", at.alias("at"))
    pairs = pairs.select("label", F.pmod(F.ascii(F.expr("substr(text, at, 1)")), F.lit(128)).alias("a"), F.pmod(F.ascii(F.expr("substr(text, at + 1, 1)")), F.lit(128)).alias("b"))
    counts = {(r.label, r.a, r.b): r.n for r in pairs.groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}  # 2 x 128 x 128 at most
    totals: dict = {}
    for (label, a, _), n in counts.items():
        totals[label, a] = totals.get((label, a), 0) + n
    p = lambda label, a, b: (counts.get((label, a, b), 0) + smoothing) / (totals.get((label, a), 0) + 128 * smoothing)
    shown = {(a, b) for _, a, b in counts}
    return [math.log2(p(1, a, b) / p(0, a, b)) if (a, b) in shown else 0.0 for a in range(128) for b in range(128)]


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All leftmost non-overlapping matches, and the pieces between them; together they spell the text."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)


def located(text: Column, pattern: str, keep) -> Column:
    """Array of (start, stop, found) of the matches for which keep(match) holds, in code points."""
    found, between = matches(text, pattern)
    step = lambda acc, pair: F.struct(
        (acc["at"] + F.length(pair["between"]) + F.length(pair["found"])).alias("at"),
        F.when(
            keep(pair["found"]),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(pair["between"])).alias("start"), (acc["at"] + F.length(pair["between"]) + F.length(pair["found"])).alias("stop"), pair["found"].alias("found")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    zipped = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda f, b: F.struct(b.alias("between"), f.alias("found")))
    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, folded).otherwise(none)


def ratio(model: list[float], token: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions, in bits."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    # Character by character, so that the time grows with the length of a token and not with its square.
    step = lambda acc, char: F.struct(
        F.ascii(char).alias("last"),
        (acc["bits"] + F.when(acc["last"] >= 0, F.element_at(table, acc["last"] * 128 + F.ascii(char) + 1)).otherwise(0.0)).alias("bits"),
    )
    total = F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("bits")), step, lambda acc: acc["bits"])
    return total / (F.length(token) - 1)


def stretches(model: list[float], token: Column, threshold: float) -> Column:
    """Array of (start, stop) of stretches of LEAST characters or more whose mean exceeds the threshold, widened to the letters and digits that adjoin.

    One pass: the sum of (ratio - threshold) restarts where it falls to zero or by DROP; a stretch ends at the peak.
    """
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    chars, n = F.split(token, ""), F.length(token)
    pair = lambda a, b: F.struct((F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1) - F.lit(threshold)).alias("x"), a.isin(*"/=_-").alias("a"), b.isin(*"/=_-").alias("b"))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def closed(acc):
        return F.when(acc["stop"] - acc["start"] >= LEAST, F.concat(acc["spans"], F.array(F.struct(acc["left"].alias("start"), acc["stop"].alias("stop"))))).otherwise(acc["spans"])

    def step(acc, p):
        total, after = acc["total"] + p["x"], acc["at"] + 1
        ends, rises = (total <= 0) | (total < acc["best"] - F.lit(DROP)), total > acc["best"]
        word = F.when(p["a"], after).otherwise(acc["word"])
        return F.struct(
            after.alias("at"), word.alias("word"), F.when(ends, after).otherwise(acc["start"]).alias("start"), F.when(ends, F.when(p["b"], after).otherwise(word)).otherwise(acc["left"]).alias("left"),
            F.when(ends, F.lit(0.0)).otherwise(total).alias("total"), F.when(ends, F.lit(0.0)).when(rises, total).otherwise(acc["best"]).alias("best"),
            F.when(ends, after).when(rises, after + 1).otherwise(acc["stop"]).alias("stop"), F.when(ends, closed(acc)).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(*[F.lit(0).alias(k) for k in ("at", "word", "start", "left")], F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("stop"), none.alias("spans"))
    found = F.aggregate(F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), pair), zero, step, closed)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["stop"] + F.length(F.regexp_extract(token.substr(s["stop"] + 1, n), "^[A-Za-z0-9]*", 0))).alias("stop")))


def judged(model: list[float], text: Column, threshold: float) -> Column:
    """Array of (start, stop) of the runs that reach the threshold, and of the parts that do of the others."""
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    varied = lambda token: F.size(F.array_distinct(F.split(token, ""))) >= VARIETY
    high = lambda token: varied(token) & (ratio(model, token) >= threshold)

    def parts(run):
        risen = F.filter(stretches(model, run["found"], threshold), lambda s: varied(run["found"].substr(s["start"] + 1, s["stop"] - s["start"])))
        found = F.concat(risen, F.transform(located(run["found"], PART, high), lambda s: span(s["start"], s["stop"])))
        return F.transform(F.array_distinct(found), lambda s: span(run["start"] + s["start"], run["start"] + s["stop"]))

    return F.flatten(F.transform(located(text, CANDIDATE, lambda f: F.lit(True)), lambda run: F.when(high(run["found"]), F.array(span(run["start"], run["stop"]))).otherwise(parts(run))))


#: Texts without these have no match of the kind.
_QUICK = {"assign": "(?i)(pass|secret|token|api)", "access": "AKIA", "hex": "[0-9a-f]{32}"}


def _base(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches whose group, if any, is long enough."""

    def keep(found):
        return F.length(F.regexp_extract(found, pattern, group)) >= least

    return F.when(text.rlike(_QUICK[kind]), located(text, pattern, keep))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns, and `secrets`: array of (start, stop, kind), in code points, stop exclusive.

    Base kinds are assign, access and hex; the models add markov spans where no
    base span has the same bounds. Order is by start, then kind as listed. A
    null or empty text has none, texts of any length are read whole, repeated
    rows each get their spans, and an empty table gives an empty result. A
    column `secrets` of the input is replaced.
    """
    docs = without(docs, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_named(_base(text, *base), order, base[0]) for order, base in enumerate(BASE)]
    runs = F.when(text.rlike(CANDIDATE), judged(model, text, threshold))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")
    base = F.flatten(F.array(*[F.coalesce(k, none) for k in kinds]))
    extra = F.coalesce(_named(runs, len(BASE), "markov"), none)
    out = docs.withColumn("__sg_base", base).withColumn("__sg_extra", extra)
    added = F.filter("__sg_extra", lambda e: ~F.exists("__sg_base", lambda b: (b["start"] == e["start"]) & (b["stop"] == e["stop"])))
    out = out.withColumn("__sg_all", F.array_sort(F.concat("__sg_base", added)))
    return out.select(*[F.col(c) for c in docs.columns], F.transform("__sg_all", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))).alias("secrets"))


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input's rows and columns with `clean_text`: every span's characters replaced by one mark per merged span."""
    docs = without(docs, "secrets", "clean_text")
    found = scan(docs, model, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    cleaned = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.withColumn("clean_text", F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(cleaned)).select(*docs.columns, "secrets", "clean_text")
