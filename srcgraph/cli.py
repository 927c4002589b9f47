"""Command line: python -m srcgraph.cli VERB [QUERY ..] --root FOLDER"""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession

from .api import Codebase
from .operators.embeddings import HashProvider

#: Verbs with one query, and the method each calls.
QUERIES = {
    "symbols": "find_symbols", "references": "find_references", "callers": "find_callers", "callees": "find_callees", "dependencies": "find_dependencies", "dependents": "find_dependents",
    "impact": "change_impact", "context": "context", "intent": "classify", "chunks": "chunks",
}
PLAIN = {"status": "status", "inspect": "stats", "map": "repository_map", "api": "api_endpoints", "apis": "api_endpoints", "sensitive": "sensitive_regions", "architecture": "architecture", "remove": "remove", "health": "health"}


def size(text: str) -> int:
    """Bytes of 10, 10k, 10mb and the like."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmg]?)b?", text.strip().lower())
    if not m:
        raise argparse.ArgumentTypeError(f"not a size: {text}")
    return int(float(m[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[m[2]])


def plain(x, limit: int):
    if isinstance(x, DataFrame):
        return [r.asDict(True) for r in x.limit(limit).collect()]
    if isinstance(x, dict):
        return {k: plain(v, limit) for k, v in x.items()}
    return x


def run(args: list[str], spark: SparkSession | None = None) -> object:
    p = argparse.ArgumentParser(prog="srcgraph", description=__doc__)
    p.add_argument("verb", choices=sorted({*QUERIES, *PLAIN, "index", "embeddings", "watch", "files", "search", "path"}))
    p.add_argument("query", nargs="*")
    p.add_argument("--root", default=".")
    p.add_argument("--index")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--language")
    p.add_argument("--max-file-size", type=size, default=5 << 20)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--force", action="store_true")
    p.add_argument("--semantic", action="store_true")
    p.add_argument("--lexical", action="store_true")
    p.add_argument("--debounce", type=int, default=300)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("srcgraph").getOrCreate()
    code = Codebase(spark, a.root, a.index, a.exclude, a.max_file_size)
    query = " ".join(a.query)
    if a.verb == "index":
        return code.index(a.force)
    if a.verb == "embeddings":
        return {"vectors": code.generate_embeddings(HashProvider())}
    if a.verb == "watch":
        code.watch(a.debounce).query.awaitTermination()
        return None
    if a.verb == "files":
        return plain(code.filter_files(query, a.language, in_path_only=True), a.limit)
    if a.verb == "path":
        return code.path(a.query[0], a.query[1])
    if a.verb == "search":
        if a.semantic:
            code.provider = HashProvider()
            return plain(code.semantic_search(query, a.limit), a.limit)
        return plain(code.search(query, a.limit) if a.lexical else code.hybrid_search(query, a.limit), a.limit)
    return plain(getattr(code, QUERIES[a.verb])(query) if a.verb in QUERIES else getattr(code, PLAIN[a.verb])(), a.limit)


if __name__ == "__main__":
    print(json.dumps(run(sys.argv[1:]), indent=2, default=str))
