"""Small files of a store, in whatever file system its path names."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """The few small files of a store, in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(x for s in (fs.listStatus(p) if fs.exists(p) else []) if not (x := s.getPath().getName()).startswith((".", "_")))

    def write(self, name: str, value: object) -> None:
        """A file that appears whole, by a rename, or not at all; an older one stays."""
        fs, p = self._at(name)
        folder, _, last = name.rpartition("/")
        _, tmp = self._at(f"{folder}/.{last}.{self.spark._jvm.java.util.UUID.randomUUID().toString()}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not fs.rename(tmp, p):
            fs.delete(tmp, False)

    def read(self, name: str) -> dict:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
