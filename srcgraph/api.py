"""One workspace and its index: the facade over all operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import architecture, context, detectors, embeddings, graph, incremental, lookup, reports, search
from .operators.extract import with_order
from .operators.indexed import TextIndexes
from .schema import Snapshot
from .sources import scan, store
from .sources.fs import Files
from .sources.staging import Staging


class Codebase:
    """Index of a workspace folder, kept below `index_path`."""

    def __init__(self, spark: SparkSession, root: str, index_path: str | None = None, patterns: list[str] = (), max_file_size: int = scan.MAX_FILE_SIZE, provider: embeddings.Provider | None = None, partition: str | None = None, include: set[str] | None = None, **metadata):
        self.spark, self.root, self.patterns, self.max_file_size, self.provider = spark, os.path.realpath(root), list(patterns), max_file_size, provider
        self.uid = store.index_uid(root, partition)
        self.include, self.metadata = include, metadata
        self.index_path = index_path or os.path.join(self.root, ".tmp", f"{self.uid}.index")
        self._snapshot: Snapshot | None = None

    # Life cycle

    def index(self, force: bool = False) -> dict:
        """Refreshes the index; counts of added, changed, deleted and unchanged files.

        A first run, and one with `force`, writes everything; any other only what has changed, in the buckets of its paths.
        """
        try:
            previous = None if force else self.snapshot()
        except store.StoredIndexError:
            previous = None
        options = store.config_hash(maxFileSize=self.max_file_size, patterns=self.patterns or None, includeFiles=sorted(self.include) if self.include else None)
        metadata = {"workspaceRoot": self.root, "configurationHash": options, **self.metadata}
        with Staging(self.spark) as stage:
            scanned = stage(scan.scan(self.spark, self.root, self.patterns, self.include, self.max_file_size).where("status = 'accepted'"), "scanned")
            delta = None
            if previous is not None:
                delta, changes = incremental.refresh_delta(previous, scanned, stage)
            if delta is None:
                before = previous or (self._stored() if force else Snapshot.empty(self.spark))
                fresh, changes = incremental.refresh(before, scanned, force, stage)
                if self.provider is not None:
                    fresh = embeddings.generate(fresh, self.provider)
                store.write(with_order(fresh, stage), self.index_path, self.uid, **metadata)
            else:
                if self.provider is not None:
                    vectors = embeddings.generate_delta(delta.apply(previous), self.provider)
                    delta.gone["vectors"] = delta.gone["vectors"].unionByName(vectors.gone["vectors"])
                    delta.rows["vectors"] = vectors.rows["vectors"]
                store.commit(self.spark, self.index_path, delta, **metadata)
            counts = incremental.diff_counts(changes).first().asDict()
        self._snapshot = None
        return counts

    def _stored(self) -> Snapshot:
        """The index as it is; empty if it can't be read."""
        try:
            return self.snapshot()
        except store.StoredIndexError:
            return Snapshot.empty(self.spark)

    def snapshot(self) -> Snapshot:
        if self._snapshot is None:
            self._snapshot = store.read(self.spark, self.index_path, self.uid, verify=False)
        return self._snapshot

    def generate_embeddings(self, provider: embeddings.Provider) -> int:
        self.provider = provider
        made = store.commit(self.spark, self.index_path, embeddings.generate_delta(self.snapshot(), provider))
        self._snapshot = None
        return made["counts"]["vectors"]

    def remove(self) -> bool:
        self._snapshot = None
        return store.remove(self.index_path)

    def listing(self) -> list[tuple]:
        return [r for r in scan.walk(self.root, self.patterns, self.include) if r[1] == "accepted"]

    def compact(self) -> dict:
        """Merges the layers that refreshes have left in each bucket."""
        self._snapshot = None
        return store.compact(self.spark, self.index_path)

    def text_indexes(self, *parts: str) -> TextIndexes:
        """Indexes of terms and substrings of the current version, all or some; each is built when it is first asked for."""
        folder, version = f"{self.index_path}/text", store._current(self.index_path)
        for old in Files(self.spark).folders(folder):
            if old != version:
                Files(self.spark).remove(f"{folder}/{old}")
        out = TextIndexes(self.spark, f"{folder}/{version}")
        missing = tuple(p for p in parts or TextIndexes.PARTS if not out.substrings(p).built)
        return TextIndexes.build(self.snapshot(), out.path, missing)

    def watch(self, debounce_ms: int = 500):
        from .streaming.watch import Watcher

        return Watcher(self, debounce_ms).start()

    def status(self) -> dict:
        try:
            return {"exists": True, **store.manifest(self.index_path)}
        except store.StoredIndexError as e:
            return {"exists": False, "reason": e.reason}

    def stats(self) -> dict:
        return self.snapshot().counts().first().asDict()

    # Records

    def files(self) -> DataFrame:
        return self.snapshot().files

    def symbols(self) -> DataFrame:
        return self.snapshot().symbols

    def relations(self) -> DataFrame:
        return self.snapshot().relations

    def read_file(self, path: str) -> str:
        return scan.read_indexed(self.files(), self.root, path)

    def texts(self) -> DataFrame:
        """(path, text) of the indexed files as they are now."""
        rows = scan.scan(self.spark, self.root, self.patterns, self.include, self.max_file_size)
        return rows.where("text IS NOT NULL").join(self.files().select("path"), "path", "left_semi").select("path", "text")

    # Everything that needs the files' texts

    def architecture(self) -> dict[str, DataFrame]:
        return architecture.analyze(self.snapshot(), self.texts().where(F.col("path").rlike(r"(^|/)(package|tsconfig|jsconfig)\.json$")))

    def api_endpoints(self) -> DataFrame:
        return detectors.api_endpoints(self.texts().withColumnRenamed("path", "filePath"), self.symbols())

    def sensitive_regions(self) -> DataFrame:
        return detectors.sensitive_lines(self.texts().withColumnRenamed("path", "filePath"))

    def health(self) -> DataFrame:
        now = self.spark.createDataFrame([(r[0],) for r in self.listing()], "path string")
        return reports.health(self.snapshot(), now)

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        if self.provider is None:
            raise ValueError("no embedding provider")
        return search.semantic_search(self.snapshot(), self.provider.embed_batch([query])[0], limit, self.provider.id)

    def hybrid_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.hybrid_search(self.snapshot(), query, self.provider.embed_batch([query])[0] if self.provider else None, limit)

    def classify(self, query: str) -> dict:
        return self.spark.range(1).select(detectors.query_intent(F.lit(query)).alias("i")).select("i.*").first().asDict()


#: Methods that only need the snapshot.
_SNAPSHOT = {
    "file": lookup.get_file, "find_symbols": lookup.find_symbols, "find_definition": lookup.find_symbols, "find_references": lookup.find_references, "find_callers": lookup.find_callers,
    "find_callees": lookup.find_callees, "chunks": lookup.get_chunks, "chunk_page": lookup.chunk_page, "filter_files": lookup.filter_files, "filter_symbols": lookup.filter_symbols,
    "filter_references": lookup.filter_references, "symbol_relations": lookup.symbol_relations, "call_graph": lookup.call_graph, "search": search.search,
    "change_impact": graph.change_impact, "path": graph.symbol_path, "relation_graph": graph.relation_graph, "cycles": graph.graph_cycles, "matrix": graph.dependency_matrix, "radial": graph.radial_graph,
    "flow": graph.flow_graph, "repository_map": reports.repository_map, "complexity": reports.complexity_summary, "duplicates": reports.duplicate_groups, "relation_kinds": reports.relation_kind_counts,
    "database_models": reports.database_models, "tests": reports.test_links, "configs": reports.configs, "docs": reports.docs, "modules": reports.module_rollup, "module_edges": reports.module_edges,
    "folders": reports.folder_counts, "export_csv": reports.symbols_csv, "export_json": reports.symbols_json, "context": context.get_context,
}


def _bind(operator):
    def method(self, *args, **kwargs):
        return operator(self.snapshot(), *args, **kwargs)

    method.__doc__ = operator.__doc__
    return method


for _name, _operator in _SNAPSHOT.items():
    setattr(Codebase, _name, _bind(_operator))


def _dependencies(self, query: str, depth: int = 1) -> DataFrame:
    return graph.dependency_relations(self.snapshot(), query, False, depth)


def _dependents(self, query: str, depth: int = 1) -> DataFrame:
    return graph.dependency_relations(self.snapshot(), query, True, depth)


Codebase.find_dependencies, Codebase.find_dependents = _dependencies, _dependents
