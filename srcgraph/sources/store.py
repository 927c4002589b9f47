"""Snapshots in any file system that Hadoop reaches: immutable layers of Parquet files that versions share, a manifest per version, and a pointer to the current one.

Rows are dealt to buckets by a hash of the path that they belong to. The first
layer has all buckets; a later one has the rows of the paths that changed, in
their buckets alone, and the keys whose earlier rows it takes the place of.
Reading merges the layers of each bucket. Buckets that have gathered many
layers are written anew, alone, and what no recent version needs goes.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS, Snapshot
from .fs import Files

FORMAT_VERSION = 2
#: What the rows of a table are dealt and replaced by.
OWNERS = {"files": "path", "symbols": "filePath", "relations": "filePath", "chunks": "filePath", "vectors": "chunkId"}
#: Buckets of a new index by the number of its files, and at most.
FILES_PER_BUCKET, MOST_BUCKETS = 2_000, 4_096
#: Layers of one bucket from which on it is compacted.
FAN = 8
#: Versions whose layers stay: readers of the one before are left in peace.
KEEP = 2
#: Buckets that a task writes side by side as its rows come; a task of more sorts them first, which spills where texts are large.
OPEN_BUCKETS = 8
#: Replaced keys that are broadcast to the rows of the layers (some 150 bytes each as a hash table).
BROADCAST_KEYS = 200_000


class StoredIndexError(Exception):
    """A stored index that cannot be read: `reason` is missing, malformed, version, uid, count or checksum."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def index_uid(root: str, partition: str | None = None) -> str:
    text = os.path.realpath(root) + (f"\0{partition}" if partition else "")
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def config_hash(**options) -> str:
    kept = {k: v for k, v in options.items() if v is not None}
    return hashlib.sha256(json.dumps(kept, separators=(",", ":")).encode()).hexdigest()


def _digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of their contents."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def _bucket(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(OWNERS[table]), F.lit(buckets)).cast("int")


@dataclass
class Delta:
    """What a version changes: for each table, keys whose rows go, and rows that come. Rows that come under a key that is still held must have it in `gone`."""

    gone: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, s: Snapshot) -> Snapshot:
        """The snapshot after it, as a plan."""
        out = {}
        for name, owner in OWNERS.items():
            df = getattr(s, name)
            if name in self.gone:
                df = df.join(self.gone[name].select(owner), owner, "left_anti").select(*df.columns)
            out[name] = df.unionByName(self.rows[name]) if name in self.rows else df
        return s.with_(**out)


class _Layers:
    """The layers that a manifest names. A layer has {name, tables: {table: {buckets, n, digest}}, replaced: {table: {buckets, n}}}; bases: {table: {bucket: its first layer that counts}}."""

    def __init__(self, spark: SparkSession, path: str, m: dict):
        self.spark, self.path, self.m = spark, path, m

    def _place(self, layer: dict, table: str, side: str = "rows") -> str:
        return f"{self.path}/layers/{layer['name']}/{side}-{table}"

    def _counting(self, table: str, k: int, bucket: int) -> bool:
        return k >= self.m["bases"].get(table, {}).get(str(bucket), 0)

    def _scan(self, layer: dict, table: str, side: str, schema: str, buckets: list[int]) -> DataFrame:
        at = self._place(layer, table, side)
        return self.spark.read.schema(schema).parquet(*[f"{at}/bucket={b}" for b in buckets])

    def raw(self, k: int, table: str) -> DataFrame:
        layer = self.m["layers"][k]
        return self._scan(layer, table, "rows", SCHEMAS[table], layer["tables"][table]["buckets"])

    def depths(self, table: str) -> dict[int, int]:
        """Layers that each bucket is read from."""
        out: dict[int, int] = {}
        for k, layer in enumerate(self.m["layers"]):
            for b in layer["tables"].get(table, {}).get("buckets", []):
                out[b] = out.get(b, 0) + self._counting(table, k, b)
        return out

    def table(self, table: str, only: set[int] | None = None) -> DataFrame:
        """The merged rows of a table, or of some of its buckets. Only buckets in which a layer replaces keys meet them; the others are plain scans."""
        owner, schema = OWNERS[table], SCHEMAS[table]
        wanted = lambda k, buckets: [b for b in buckets if self._counting(table, k, b) and (only is None or b in only)]
        replaced, touched = [], {}
        for k, layer in enumerate(self.m["layers"]):
            side = layer["replaced"].get(table, {})
            buckets = wanted(k, side.get("buckets", []))
            if buckets:
                replaced.append((self._scan(layer, table, "replaced", f"{owner} string", buckets).withColumn("until", F.lit(k)), side["n"]))
                touched.update(dict.fromkeys(buckets, k))
        plain, merged = [], []
        for k, layer in enumerate(self.m["layers"]):
            buckets = wanted(k, layer["tables"].get(table, {}).get("buckets", []))
            old = [b for b in buckets if touched.get(b, -1) > k]
            new = [b for b in buckets if touched.get(b, -1) <= k]
            if new:
                plain.append(self._scan(layer, table, "rows", schema, new))
            if old:
                merged.append(self._scan(layer, table, "rows", schema, old).withColumn("layer", F.lit(k)))
        if merged:
            keys = reduce(DataFrame.unionByName, [df for df, _ in replaced]).groupBy(F.col(owner).alias("key")).agg(F.max("until").alias("until"))
            keys = F.broadcast(keys) if sum(n for _, n in replaced) <= BROADCAST_KEYS else keys
            rows = reduce(DataFrame.unionByName, merged)
            plain.append(rows.join(keys, (F.col(owner) == F.col("key")) & (F.col("layer") < F.col("until")), "left_anti").drop("layer"))
        return reduce(DataFrame.unionByName, plain) if plain else self.spark.createDataFrame([], schema)


def _put(rows: DataFrame, table: str, place: str, buckets: int) -> dict | None:
    """Writes rows by bucket, one file for each; their buckets, number and digest, taken while they are written. None for no rows."""
    seen = Observation()
    row = F.xxhash64(*[F.col(c) for c in rows.columns])
    dealt = rows.withColumn("bucket", _bucket(table, buckets)).repartition(F.col("bucket"))
    conf, writers = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    conf.set(writers, OPEN_BUCKETS)
    try:
        dealt.observe(seen, F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest")).write.partitionBy("bucket").parquet(place)
    finally:
        conf.set(writers, before)
    if not seen.get["n"]:
        return None
    found = sorted(int(n.split("=")[1]) for n in Files(rows.sparkSession).folders(place) if n.startswith("bucket="))
    return {"buckets": found, "n": seen.get["n"], "digest": str(seen.get["digest"])}


def _layer(path: str, buckets: int, rows: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict:
    """Writes a layer; tables without rows leave nothing in it."""
    name = uuid.uuid4().hex
    place = f"{path}/layers/{name}"
    tables = {t: _put(df, t, f"{place}/rows-{t}", buckets) for t, df in rows.items()}
    replaced = {t: _put(df.select(OWNERS[t]).distinct(), t, f"{place}/replaced-{t}", buckets) for t, df in gone.items()}
    return {"name": name, "tables": {t: x for t, x in tables.items() if x}, "replaced": {t: x for t, x in replaced.items() if x}}


def _publish(spark: SparkSession, path: str, m: dict, seen: str | None) -> None:
    """Writes a manifest and points to it, if the version that it follows is still the current one."""
    files, version = Files(spark), f"v-{uuid.uuid4().hex}"
    files.replace(f"{path}/{version}/manifest.json", json.dumps(m))
    if _current(path) != seen:
        files.remove(f"{path}/{version}")
        raise StoredIndexError("conflict", "another run has written meanwhile")
    files.replace(f"{path}/CURRENT", version)


def write(s: Snapshot, path: str, uid: str, keep_old: bool = False, buckets: int | None = None, **metadata) -> dict:
    """A version of one new layer with everything; the pointer is replaced last, so readers see the old version or the new one whole."""
    if len(uid.encode()) > 65535:
        raise StoredIndexError("uid", "too long")
    seen = _current(path)
    if buckets is None:
        buckets = min(MOST_BUCKETS, 1 + s.files.count() // FILES_PER_BUCKET)
    layer = _layer(path, buckets, {t: df for t, df in s.tables().items() if t != "metadata"}, {})
    now = datetime.now(UTC).isoformat()
    counts = {t: layer["tables"].get(t, {}).get("n", 0) for t in OWNERS}
    digests = {t: layer["tables"].get(t, {}).get("digest", "0") for t in OWNERS}
    m = {"formatVersion": FORMAT_VERSION, "uid": uid, "createdAt": now, "updatedAt": now, **metadata, "buckets": buckets, "counts": counts, "digests": digests, "layers": [layer], "bases": {}, "previous": None}
    _publish(s.spark, path, m | {"previous": seen} if keep_old else m, seen)
    if seen and not keep_old:
        vacuum(s.spark, path, keep=1)
    return m


def commit(spark: SparkSession, path: str, delta: Delta, fan: int = FAN, **metadata) -> dict:
    """A version that adds one layer with what a delta changes, in the buckets of the changed keys; all other files are shared with the version before."""
    seen, old = _current(path), manifest(path)
    layers = _Layers(spark, path, old)
    layer = _layer(path, old["buckets"], delta.rows, delta.gone)
    counts = dict(old["counts"])
    for table, side in layer["replaced"].items():
        owner = OWNERS[table]
        keys = spark.read.schema(f"{owner} string").parquet(*[f"{path}/layers/{layer['name']}/replaced-{table}/bucket={b}" for b in side["buckets"]])
        counts[table] -= layers.table(table, set(side["buckets"])).join(keys, owner, "left_semi").count()
    for table, side in layer["tables"].items():
        counts[table] += side["n"]
    m = {**old, **metadata, "updatedAt": datetime.now(UTC).isoformat(), "counts": counts, "previous": seen}
    if layer["tables"] or layer["replaced"]:
        m["layers"] = [*old["layers"], layer]
        m["digests"] = {t: _sum(m["layers"], t) for t in OWNERS}
    _publish(spark, path, m, seen)
    if any(n >= fan for t in OWNERS for n in _Layers(spark, path, m).depths(t).values()):
        m = compact(spark, path, fan)
    vacuum(spark, path)
    return m


def _sum(layers: list[dict], table: str) -> str:
    """Digests are sums over rows, so a table's is that of its layers together."""
    return str(sum(int(x["tables"].get(table, {}).get("digest", "0")) for x in layers))


def compact(spark: SparkSession, path: str, fan: int = 2) -> dict:
    """Writes the buckets that are read from `fan` layers or more anew, as a layer in which they begin; other buckets stay as they are."""
    seen, old = _current(path), manifest(path)
    layers = _Layers(spark, path, old)
    deep = {t: {b for b, n in layers.depths(t).items() if n >= fan} for t in OWNERS}
    deep = {t: b for t, b in deep.items() if b}
    if not deep:
        return old
    layer = _layer(path, old["buckets"], {t: layers.table(t, b) for t, b in deep.items()}, {})
    bases = {t: dict(x) for t, x in old["bases"].items()}
    for table, buckets in deep.items():
        bases.setdefault(table, {}).update({str(b): len(old["layers"]) for b in buckets})
    m = {**old, "layers": [*old["layers"], layer], "bases": bases, "previous": seen}
    m["digests"] = {t: _sum(m["layers"], t) for t in OWNERS}
    _publish(spark, path, m, seen)
    return m


def vacuum(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Deletes versions but the newest `keep`, and the layers that none of these reads from; returns the names of what went."""
    files = Files(spark)
    kept, used, at = [], set(), _current(path)
    while at and len(kept) < keep:
        text = files.read(f"{path}/{at}/manifest.json")
        if text is None:
            break
        m = json.loads(text)
        live = _Layers(spark, path, m)
        for k, layer in enumerate(m["layers"]):
            parts = [(t, b) for side in ("tables", "replaced") for t, x in layer[side].items() for b in x["buckets"]]
            if any(live._counting(t, k, b) for t, b in parts):
                used.add(layer["name"])
        kept.append(at)
        at = m.get("previous")
    gone = [n for n in files.folders(path) if n.startswith("v-") and n not in kept]
    gone += [f"layers/{n}" for n in files.folders(f"{path}/layers") if n not in used]
    for name in gone:
        files.remove(f"{path}/{name}")
    return gone


def _current(path: str) -> str | None:
    text = Files().read(f"{path}/CURRENT")
    return text and text.strip()


def manifest(path: str) -> dict:
    version = _current(path)
    if not version:
        raise StoredIndexError("missing", path)
    try:
        return json.loads(Files().read(f"{path}/{version}/manifest.json") or "")
    except ValueError as e:
        raise StoredIndexError("malformed", str(e)) from e


def read(spark: SparkSession, path: str, uid: str | None = None, verify: bool = True) -> Snapshot:
    """The current version; with verify the counts and digests of all tables and layers are compared."""
    m = manifest(path)
    if m.get("formatVersion") != FORMAT_VERSION:
        raise StoredIndexError("version", str(m.get("formatVersion")))
    if uid is not None and m.get("uid") != uid:
        raise StoredIndexError("uid", str(m.get("uid")))
    layers = _Layers(spark, path, m)
    tables = {name: layers.table(name) for name in m["counts"]}
    if verify:
        for name, df in tables.items():
            try:
                total = 0
                for k, layer in enumerate(m["layers"]):
                    known = layer["tables"].get(name)
                    if known and any(layers._counting(name, k, b) for b in known["buckets"]):
                        got = _digest(layers.raw(k, name)).first()
                        total += int(got.digest) - int(known["digest"])
                n = df.count()
            except Exception as e:
                raise StoredIndexError("checksum", f"{name}: {str(e)[:200]}") from e
            if n != m["counts"][name]:
                raise StoredIndexError("count", name)
            if total or m["digests"][name] != _sum(m["layers"], name):
                raise StoredIndexError("checksum", name)
    flat = [(k, str(v)) for k, v in m.items() if k not in ("counts", "digests", "layers", "bases", "buckets", "previous")] + [(f"{k[:-1]}Count", str(v)) for k, v in m["counts"].items()]
    return Snapshot(**tables, metadata=spark.createDataFrame(flat, SCHEMAS["metadata"]))


def rows_of(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """The rows of one path, or chunk for vectors: its bucket is read, no other."""
    m = manifest(path)
    bucket = spark.range(1).select(F.lit(key).alias(OWNERS[table])).select(_bucket(table, m["buckets"]).alias("b")).first().b
    return _Layers(spark, path, m).table(table, {bucket}).where(F.col(OWNERS[table]) == key)


def catalog(spark: SparkSession, folder: str, verify: bool = False) -> tuple[dict[str, Snapshot], list[dict], list[tuple[str, str]]]:
    """All indexes below a folder by uid, their manifests by workspace, and the ones that cannot be read; one bad index spoils nothing."""
    good, found, bad = {}, [], []
    for name in Files(spark).folders(folder):
        path = f"{folder}/{name}"
        try:
            m = manifest(path)
            good[m["uid"]] = read(spark, path, verify=verify)
            found.append(m)
        except StoredIndexError as e:
            bad.append((name, str(e)))
    return good, sorted(found, key=lambda m: m.get("workspaceRoot", "")), bad


def union(indexes: dict[str, Snapshot], table: str) -> DataFrame:
    """One table of many indexes, with indexUid."""
    out = None
    for uid, s in indexes.items():
        part = getattr(s, table).withColumn("indexUid", F.lit(uid))
        out = part if out is None else out.unionByName(part)
    return out


def remove(path: str) -> bool:
    return Files().remove(path)
