"""URL filtering by a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Up to so many rules the trie is broadcast; more are joined.
BROADCAST_RULES = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class _Paths:
    """Path segments below a host; `tails` holds the rules that end within the next segment."""

    next: dict = field(default_factory=dict)
    tails: list = field(default_factory=list)


@dataclass
class _Hosts:
    next: dict = field(default_factory=dict)
    paths: _Paths | None = None


class Trie:
    """Of two rules that fit, that with more host labels wins, then that with the longer path, then block over allow."""

    def __init__(self, rules: list[Rule]):
        self.root = _Hosts()
        for rule in rules:
            node = self.root
            for label in reversed([x for x in rule.host.lower().split(".") if x]):
                node = node.next.setdefault(label, _Hosts())
            node.paths = spot = node.paths or _Paths()
            *whole, tail = rule.path.split("/")
            for segment in whole:
                spot = spot.next.setdefault(segment, _Paths())
            spot.tails.append((len(tail), rule.verdict == "block", tail, rule))
            spot.tails.sort(key=lambda x: x[:2], reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        found, node = None, self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.next.get(label)
            if node is None:
                break
            found = (node.paths and self._below(node.paths, path.split("/"))) or found
        return found

    @staticmethod
    def _below(spot: _Paths, segments: list[str]) -> Rule | None:
        found = None
        for segment in segments:
            found = next((rule for _, _, tail, rule in spot.tails if segment.startswith(tail)), found)
            spot = spot.next.get(segment)
            if spot is None:
                break
        return found


_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for a null or a URL without ``://``."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The input's rows and columns, with host, path, rule (null where none fits) and verdict, else `default`.

    A URL that is null, empty or without ``://`` has an empty host and path,
    which no rule with a host fits. URLs of any length are read whole, repeated
    rows each get their verdict, and an empty table gives an empty result.
    Existing columns of those names are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*names)
    if len(rules) > BROADCAST_RULES:
        return _joined(rows, rules, url_col, default)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    where = names.index(url_col)
    added = ["host", "path", "rule", "verdict"]
    schema = StructType(list(rows.schema.fields))
    for name in added:
        schema = schema.add(name, StringType())

    def run(batches):
        trie = shared.value
        for batch in batches:
            out = []
            for url in batch.column(where).to_pylist():
                host, path = split_url(url)
                rule = trie.find(host, path)
                out.append((host, path, rule.name if rule else None, rule.verdict if rule else default))
            columns = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=[*names, *added])

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, rules: list[Rule], url_col: str, default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: hosts' suffixes meet rules in a join."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host.lower(), r.path, r.verdict) for r in rules], "r_host string, r_path string, r_verdict string")
    whole = F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    keyed = rows.withColumn("host", F.coalesce(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")))
    keyed = keyed.withColumn("path", F.coalesce(F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit("")))
    pairs = keyed.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = pairs.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    fits = suffixes.join(table, "r_host").where(F.expr("startswith(path, r_path)"))
    order = F.struct(F.size(F.split("r_host", "\\.")), F.length("r_path"), F.col("r_verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("__sg_best"))
    out = keyed.join(best, ["host", "path"], "left")
    return out.select(*rows.columns, "host", "path", F.col("__sg_best.rule").alias("rule"), F.coalesce(F.col("__sg_best.r_verdict"), F.lit(default)).alias("verdict"))
