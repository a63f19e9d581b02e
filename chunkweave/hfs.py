"""Small files of a folder, through the filesystem that Spark would use for its URI."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str = "") -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def list(self, name: str = "") -> list[str]:
        fs, p = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> bytes:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """All of it or an error; without ``overwrite``, an error where the name is taken."""
        fs, p = self._at(name)
        out = fs.create(p, overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        _, q = self._at(new)
        return not fs.exists(q) and fs.rename(p, q)

    def delete(self, name: str = "") -> None:
        fs, p = self._at(name)
        fs.delete(p, True)
