"""Small files and folders of any file system that Hadoop reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Paths without a scheme are those of the session's default file system."""

    def __init__(self, spark: SparkSession | None = None):
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.spark, self._hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._hadoop.Path(path)
        fs = at.getFileSystem(self._conf)
        fs.setVerifyChecksum(False)
        return fs, at

    def read(self, path: str) -> str | None:
        """The text of a file; None if there is none."""
        fs, at = self._at(path)
        if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
            return None
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a file beside, then renames it over: readers see the old text or the new one whole."""
        fs, at = self._at(path)
        _, beside = self._at(f"{path}.tmp")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        over = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        over[0] = getattr(self._hadoop, "Options$Rename").OVERWRITE
        qualified = fs.makeQualified(at)
        self._hadoop.FileContext.getFileContext(qualified.toUri(), self._conf).rename(fs.makeQualified(beside), qualified, over)

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if there is no such."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())

    def remove(self, path: str) -> bool:
        """Whether there was anything."""
        fs, at = self._at(path)
        return fs.delete(at, True)
