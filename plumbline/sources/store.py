"""Small files through Spark's file systems, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """One writer's folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, *parts: object) -> str:
        return "/".join([self.root, *map(str, parts)])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))  # Spark's readers pass over names with an underscore
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it: a reader sees the old file or the new one."""
        beside = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(beside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf).rename(self._path(beside), self._path(path), array)
