"""Detectors over text: sensitive lines, endpoints, and the intent of a question."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEFT as B
from ..functions.text import RIGHT as E
from ..functions.text import sha_prefix, trim

# Patterns of sensitive lines.
SENSITIVE = {
    "credential": r"(?i)(api[_-]?key|access[_-]?token|secret|private[_-]?key|password|credential|token)",
    "private-key": r"(?i)BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY",
    "api-key": r"(?i)(?:aws|github|slack|stripe|openai|auth0)[-_]?(?:key|token)",
}


def sensitive_lines(texts: DataFrame) -> DataFrame:
    """texts(filePath, text) to one row per line and matching pattern; every line of an .env file matches all three."""
    env = F.lower("filePath").contains(".env")
    lines = texts.where(F.length("text") > 0).select("filePath", env.alias("env"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw"))
    lines = lines.withColumn("trimmed", trim(F.col("raw")))
    kinds = F.array_compact(F.array(*[F.when(F.col("env") | F.col("trimmed").rlike(p), F.lit(k)) for k, p in SENSITIVE.items()]))
    snippet = F.left(F.regexp_replace("trimmed", r"""(?s)^(.*?)(:|=|\s+)(['"]?)[^\s'"]+""", "$1$2$3[redacted]"), F.lit(160))
    return lines.select(
        "filePath", (F.col("at") + 1).alias("line"), F.explode(kinds).alias("kind"), F.when(F.col("env"), 0.9).otherwise(0.75).alias("confidence"),
        F.when(F.col("trimmed") == "", "sensitive configuration value").otherwise(snippet).alias("snippet"),
    )


# Patterns of endpoint declarations. Only those with a method and a route can give a row.
ENDPOINTS = [
    r"(?:app|router|server|fastify|api)\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"`](.+?)['\"`]",
    r"@(?:Get|Post|Put|Delete|Patch|RequestMapping|GetMapping|PostMapping)\s*\(\s*['\"`](.+?)['\"`]",
    r"(?:route|router)\s*\(\s*['\"`](.+?)['\"`]",
    r"(?:path|r)\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"`](.+?)['\"`]",
    r"\b(?:@app|@bp)\.(?:route|get|post|put|delete|patch)\s*\(\s*['\"`](.+?)['\"`]",
    r"\[(?:HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch)\]\s*(?:async\s+)?(?:function\s+)?([A-Za-z0-9_]+)",
]


def api_endpoints(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """texts(filePath, text) to endpoints; one match of two patterns is two rows. symbolId is the file's first symbol named before it."""
    names = symbols.groupBy("filePath").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    rows = texts.join(names, "filePath", "left").select("filePath", "text", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    patterns = [re.compile(p, re.I) for p in ENDPOINTS]

    def find(frames):
        for frame in frames:
            out = []
            for path, text, known in zip(frame["filePath"], frame["text"], frame["names"]):
                text = text or ""
                breaks = [m.start() for m in re.finditer("\n", text)]
                # Where each name has first been seen whole, and the first in order of those seen so far.
                seen = sorted((at + len(n), k) for k, n in enumerate(known) if (at := text.find(n)) >= 0)
                ends, first = [e for e, _ in seen], list(accumulate((k for _, k in seen), min))
                for pattern in patterns:
                    for m in pattern.finditer(text):
                        route = (m[2] if pattern.groups > 1 else m[0]).strip()
                        if not route.startswith(("/", "http", "{")):
                            continue
                        line, named = bisect_left(breaks, m.start()) + 1, bisect_right(ends, m.start())
                        out.append((path, m[1].upper(), route, known[first[named - 1]] if named else None, line, line + 1))
            yield pd.DataFrame(out, columns=["filePath", "method", "path", "symbolId", "startLine", "endLine"])

    found = rows.mapInPandas(find, "filePath string, method string, path string, symbolId string, startLine int, endLine int")
    return found.select(sha_prefix(F.concat_ws(":", "filePath", "method", "path", F.col("startLine").cast("string"))).alias("id"), "*")


# Patterns of questions, first match first.
INTENTS = [
    ("caller", 0.95, rf"{B}who\s+calls{E}|{B}calls?\s+.*\?|{B}callers?{E}|{B}called\s+by{E}|{B}invoked\s+by{E}", "Caller-focused phrasing"),
    ("callee", 0.9, rf"{B}what\s+(calls|calls\s+.*)|{B}callee|{B}called\s+from{E}|{B}who\s+is\s+called{E}", "Callee-focused phrasing"),
    ("definition", 0.82, rf"{B}where\s+is{E}|{B}what\s+is{E}|{B}show\s+.*symbol|{B}find\s+.*class|{B}find\s+.*function|{B}definition{E}", "Definition lookup phrasing"),
    ("reference", 0.8, rf"{B}reference|{B}references?{E}|{B}used\s+by{E}|{B}imports?{E}", "Reference-focused phrasing"),
    ("dependency", 0.8, rf"{B}dependency|{B}depends\s+on|{B}imports?{E}|{B}package{E}|{B}module{E}", "Dependency phrasing"),
    ("architecture", 0.84, rf"{B}architecture|{B}service\s+map|{B}how\s+.*works|{B}repository\s+structure|{B}module\s+layout{E}", "Architecture phrasing"),
    ("test", 0.85, rf"{B}test|{B}pytest|{B}jest|{B}vitest|{B}coverage|{B}affected\s+tests{E}", "Test-focused phrasing"),
    ("api", 0.88, rf"{B}api|{B}endpoint|{B}route|{B}post\s+/|{B}get\s+/|{B}controller{E}", "API-focused phrasing"),
    ("configuration", 0.82, rf"{B}config|{B}package\.json|{B}tsconfig|{B}dotenv|{B}settings|{B}env{E}|{B}build{E}", "Configuration phrasing"),
    ("history", 0.86, rf"{B}history|{B}commit|{B}changed|{B}recent{E}|{B}cochange{E}", "History-focused phrasing"),
]


def query_intent(query: Column) -> Column:
    """Struct (kind, confidence, normalized, reason)."""
    text = trim(query)
    lower = F.lower(text)

    def answer(kind: str, confidence: float, reason: str, normalized: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), normalized.alias("normalized"), F.lit(reason).alias("reason"))

    out = F.when(text == "", answer("semantic", 0.2, "Empty query", text))
    for kind, confidence, pattern, reason in INTENTS:
        out = out.when(lower.rlike(pattern), answer(kind, confidence, reason, lower))
    return out.otherwise(answer("symbol", 0.65, "Default symbol lookup", lower))
