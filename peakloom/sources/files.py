"""Files and folders on whatever file system a path names: local, mounted or distributed."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A few operations of Hadoop's file system API; a path without a scheme is one of the default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def rename(self, old: str, new: str) -> None:
        """Move a file or folder; new must not be there. One step of the file system's directory, where that has one."""
        fs, where = self._at(old)
        if fs.exists(self._jvm.org.apache.hadoop.fs.Path(new)):
            raise FileExistsError(new)
        if not fs.rename(where, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def names(self, path: str) -> list[str]:
        """Names of the entries of a folder, in order; none if it isn't there."""
        fs, where = self._at(path)
        return sorted(e.getPath().getName() for e in fs.listStatus(where)) if fs.exists(where) else []

    def write_text(self, path: str, text: str) -> None:
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
