"""Workspace scans: which files count, and their rows."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import language

# Folders that are never scanned, and limits.
DEFAULT_EXCLUDES = ["node_modules/", ".git/", "dist/", "build/", "out/", "target/", "coverage/", ".cache/", ".tmp/", "temp/", "vendor/"]
MAX_FILE_SIZE, SNIFF_BYTES = 5 << 20, 8192
#: Bytes of files after which a task hands on what it has read, so a batch of paths is never held with all its texts.
READ_BYTES = 4 << 20


def compile_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern, negated, folders only) of one ignore line."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while line.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S | re.I), negated, folder


@dataclass
class Layer:
    base: str
    rules: list = field(default_factory=list)

    def ignores(self, path: str, folder: bool) -> bool:
        """A path below an ignored folder is ignored; otherwise the last rule that matches decides."""
        parts = path.split("/")
        return any(self.hits("/".join(parts[:n]), n < len(parts) or folder) for n in range(1, len(parts) + 1))

    def hits(self, path: str, folder: bool) -> bool:
        """Whether the rules ignore the path itself, whatever they say of the folders above."""
        hit = False
        for pattern, negated, only in self.rules:
            if (folder or not only) and pattern.match(path):
                hit = not negated
        return hit


class IgnoreMatcher:
    """Layers of rules; a path is ignored if any layer ignores it, so a nested layer cannot take back what an outer one excludes."""

    def __init__(self, patterns: list[str] = (), root_rules: str = ""):
        self.layers: list[Layer] = [self._layer("", [*DEFAULT_EXCLUDES, *patterns, *root_rules.split("\n")])]

    @staticmethod
    def _layer(base: str, lines: list[str]) -> Layer:
        return Layer(base, [r for r in map(compile_rule, lines) if r])

    def add(self, base: str, rules: str) -> None:
        self.layers.append(self._layer(base, rules.split("\n")))

    def ignores(self, path: str, folder: bool = False, walked: bool = False) -> bool:
        """A path whose folders have been `walked`, so none of them is ignored, is judged without them."""
        for layer in self.layers:
            below = path if not layer.base else path[len(layer.base) + 1 :] if path.startswith(layer.base + "/") else ""
            if below and (layer.hits if walked else layer.ignores)(below, folder):
                return True
        return False


def _rules(root: str, folder: str) -> str:
    try:
        with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def _entries(root: str, folder: str, matcher: IgnoreMatcher, folders_only: bool = False):
    """(path, kind, size, modifiedAt) of a folder's entries in order of names: folder, file or ignored. Links are passed over."""
    for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
        path = f"{folder}/{entry.name}" if folder else entry.name
        if entry.is_symlink() or folders_only and not entry.is_dir():
            continue
        if matcher.ignores(path, entry.is_dir(), walked=True):
            yield path, "ignored", 0, 0.0
        elif entry.is_dir():
            yield path, "folder", 0, 0.0
        elif entry.is_file():
            st = entry.stat()
            yield path, "file", st.st_size, st.st_mtime * 1000


def _below(matcher: IgnoreMatcher, root: str, folder: str) -> IgnoreMatcher:
    """The rules that hold in a folder: those above, and its own."""
    own = _rules(root, folder) if folder else ""
    if not own:
        return matcher
    out = copy.copy(matcher)
    out.layers = list(matcher.layers)
    out.add(folder, own)
    return out


def _walked(root: str, folder: str, matcher: IgnoreMatcher, include: set[str] | None, deep: bool = True):
    """Rows of a folder, whose rules `matcher` has, and of all folders below if deep."""
    for path, kind, size, modified in _entries(root, folder, matcher):
        if kind == "folder":
            if deep:
                yield from _walked(root, path, _below(matcher, root, path), include)
        elif kind == "ignored":
            yield path, "ignored", 0, 0.0
        elif include is None or path in include:
            yield path, "accepted", size, modified


def walk(root: str, patterns: list[str] = (), include: set[str] | None = None) -> list[tuple[str, str, int, float]]:
    """(path, status, size, modifiedAt) in order of names: accepted or ignored. Links are passed over, an ignored folder is one row."""
    return list(_walked(root, "", IgnoreMatcher(list(patterns), _rules(root, "")), include))


class FolderPartition(InputPartition):
    """A folder with the rules that hold in it; its files alone, or all that is below it."""

    def __init__(self, folder: str, matcher: IgnoreMatcher, deep: bool):
        self.folder, self.matcher, self.deep = folder, matcher, deep


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.wanted = options["path"], int(options.get("folders", 64))
        self.patterns = json.loads(options.get("patterns", "[]"))
        include = json.loads(options.get("include", "null"))
        self.include = None if include is None else set(include)
        self.limit = int(options.get("maxfilesize", MAX_FILE_SIZE))
        self.sniff = options.get("sniff", "true") == "true"

    def partitions(self) -> list[FolderPartition]:
        """Folders from the top, level by level, until there are enough to share among the tasks; only these are listed here."""
        out, level = [], [("", IgnoreMatcher(self.patterns, _rules(self.root, "")))]
        while level and len(level) < self.wanted:
            below = []
            for folder, matcher in level:
                out.append(FolderPartition(folder, matcher, deep=False))
                below += [(path, _below(matcher, self.root, path)) for path, kind, _, _ in _entries(self.root, folder, matcher, folders_only=True) if kind == "folder"]
            level = below
        return out + [FolderPartition(folder, matcher, deep=True) for folder, matcher in level]

    def read(self, partition: FolderPartition):
        for path, status, size, modified in _walked(self.root, partition.folder, partition.matcher, self.include, partition.deep):
            if status == "accepted":
                status = "skipped-large-file" if size > self.limit else self._sniffed(path) if self.sniff else status
            yield path, status, size, modified

    def _sniffed(self, path: str) -> str:
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return "skipped-binary" if b"\0" in f.read(SNIFF_BYTES) else "accepted"
        except OSError:
            return "error"


class Workspace(DataSource):
    """A workspace folder as a table of its files: `path`, and as JSON `patterns` and `include`; `maxFileSize`; `folders`, how many tasks should share it; `sniff` false leaves files unopened."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "path string, status string, size long, modifiedAt double"

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options)


def list_files(spark: SparkSession, root: str, patterns: list[str] = (), include: set[str] | None = None, max_file_size: int = MAX_FILE_SIZE, sniff: bool = True) -> DataFrame:
    """(path, status, size, modifiedAt), listed by the tasks, folder by folder. Of a file no more is read than tells whether it is binary; without `sniff` nothing is, and binaries count as accepted."""
    spark.dataSource.register(Workspace)
    reader = spark.read.format("workspace").option("patterns", json.dumps(list(patterns))).option("maxFileSize", max_file_size).option("sniff", sniff).option("folders", 2 * spark.sparkContext.defaultParallelism)
    if include is not None:
        reader = reader.option("include", json.dumps(sorted(include)))
    return reader.load(os.path.realpath(root))


def scan(spark: SparkSession, root: str, patterns: list[str] = (), include: set[str] | None = None, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """(path, status, language, hash, size, modifiedAt, text); text and hash of accepted files only.

    Folders are listed and contents read by the tasks, so the root must be a folder that all of them see.
    Hidden files count, which Spark's own file sources pass over.
    """
    root = os.path.realpath(root)
    # Large folders are one task's to list, but their files are dealt to all to be read: by number, since rows without
    # their texts are so small that an adaptive plan would put them together for one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    listed = list_files(spark, root, patterns, include, max_file_size, sniff=False).repartition(tasks, F.col("path"))

    def read_part(frame):
        status, digest, text, sizes = [], [], [], []
        for path, known, size in zip(frame["path"], frame["status"], frame["size"]):
            data = None
            if known == "accepted":
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read(SNIFF_BYTES)
                        if b"\0" in data:
                            known, data = "skipped-binary", None
                        else:
                            data += f.read()
                except OSError:
                    known, data = "error", None
            status.append(known)
            digest.append(hashlib.sha256(data).hexdigest() if data is not None else None)
            text.append(data.decode("utf-8", "replace") if data is not None else None)
            sizes.append(len(data) if data is not None else size)
        return pd.DataFrame({"path": frame["path"], "status": status, "hash": digest, "size": sizes, "modifiedAt": frame["modifiedAt"], "text": text})

    def read(frames):
        for frame in frames:
            # By the listed sizes: a part ends where their running sum passes a multiple of READ_BYTES.
            group = frame["size"].where(frame["status"] == "accepted", 0).cumsum() // READ_BYTES
            for _, part in frame.groupby(group, sort=False):
                yield read_part(part)

    out = listed.mapInPandas(read, "path string, status string, hash string, size long, modifiedAt double, text string")
    return out.select("path", "status", language(F.col("path")).alias("language"), "hash", "size", "modifiedAt", "text")


def status_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def read_indexed(files: DataFrame, root: str, path: str) -> str:
    """Text of an indexed file; a path that is not indexed, or leads out of the root, is an error."""
    real, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if files.where(F.col("path") == path).isEmpty() or not full.startswith(real + os.sep):
        raise PermissionError(f"{path} is not an indexed file")
    with open(full, encoding="utf-8", errors="replace") as f:
        return f.read()
