"""Vectors of chunks by a pluggable provider."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Snapshot
from ..sources.store import Delta
from .incremental import missing_vectors, upsert

MICRO_BATCH = 4


class Provider(Protocol):
    """Must be picklable: it runs on the executors."""

    id: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic vectors from hashed terms; needs no model."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.id = dimensions, f"hash-{dimensions}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for word in text.lower().split():
            digest = hashlib.sha256(word.encode()).digest()
            out[int.from_bytes(digest[:4], "big") % self.dimensions] += 1.0 if digest[4] & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class HttpProvider:
    """An OpenAI-compatible endpoint; `post(url, body) -> reply` may be replaced."""

    def __init__(self, url: str, model: str, dimensions: int, prefix: str = "", post: Callable | None = None, timeout: float = 120):
        self.url, self.model, self.dimensions, self.prefix, self.timeout, self.id = url, model, dimensions, prefix, timeout, f"http-{model}-{dimensions}"
        self._post = post

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": [self.prefix + t for t in texts]}
        reply = self._post(self.url, body) if self._post else self._request(body)
        return [row["embedding"] for row in sorted(reply["data"], key=lambda r: r["index"])]

    def _request(self, body: dict) -> dict:
        import json
        import urllib.request

        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)


def embed_queue(provider: Provider, texts: list[str], progress: Callable[[int, int], None] | None = None) -> Iterator[list[float]]:
    """Micro-batches; a wrong count, size or value is an error."""
    for at in range(0, len(texts), MICRO_BATCH):
        batch = texts[at : at + MICRO_BATCH]
        vectors = provider.embed_batch(batch)
        if len(vectors) != len(batch):
            raise ValueError(f"provider gave {len(vectors)} vectors for {len(batch)} texts")
        for v in vectors:
            if len(v) != provider.dimensions or not all(math.isfinite(x) for x in v):
                raise ValueError(f"vectors must be {provider.dimensions} finite numbers")
            yield [float(x) for x in v]
        if progress:
            progress(at + len(batch), len(texts))


def self_test(query: Column, document: Column) -> Column:
    """Struct (dot, queryNorm, documentNorm) of two vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(dot(query, document).alias("dot"), F.sqrt(dot(query, query)).alias("queryNorm"), F.sqrt(dot(document, document)).alias("documentNorm"))


def embed_chunks(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Vectors of chunks(id, hash, text): each distinct text is embedded once and given to all chunks that have it."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"hash": frame["hash"], "values": list(embed_queue(provider, list(frame["text"])))})

    once = chunks.groupBy("hash").agg(F.min("text").alias("text"))
    vectors = once.mapInPandas(run, "hash string, values array<double>")
    return chunks.select("id", "hash").join(vectors, "hash").select(F.col("id").alias("chunkId"), F.col("hash").alias("chunkHash"), F.lit(provider.id).alias("providerId"), F.lit(provider.dimensions).alias("dimensions"), "values")


def generate(s: Snapshot, provider: Provider) -> Snapshot:
    """Vectors of the provider for all chunks; those it made before are kept, others are replaced."""
    kept = s.vectors.where((F.col("providerId") == provider.id) & (F.col("dimensions") == provider.dimensions))
    return s.with_(vectors=upsert(kept, embed_chunks(missing_vectors(s, provider.id, provider.dimensions), provider), "chunkId"))


def generate_delta(s: Snapshot, provider: Provider) -> Delta:
    """What generate() changes: vectors that come, in place of others of their chunks."""
    made = embed_chunks(missing_vectors(s, provider.id, provider.dimensions), provider)
    return Delta(gone={"vectors": s.vectors.where((F.col("providerId") != provider.id) | (F.col("dimensions") != provider.dimensions)).select("chunkId")}, rows={"vectors": made})
