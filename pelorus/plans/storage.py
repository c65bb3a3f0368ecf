"""Files of the warehouse through Hadoop's file system, so a path may lie on any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_dir(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, source: str, target: str) -> None:
        fs, at = self._at(source)
        fs.mkdirs(self._jvm.org.apache.hadoop.fs.Path(target).getParent())
        if not fs.rename(at, self._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def files(self, path: str) -> Iterator[tuple[str, int]]:
        """Path and length of every regular file below ``path``."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return
        found = fs.listFiles(at, True)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toString(), status.getLen()

    def size(self, path: str) -> tuple[int, int]:
        """Number of files and bytes below ``path``."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return 0, 0
        summary = fs.getContentSummary(at)
        return summary.getFileCount(), summary.getLength()

    def write_text(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
