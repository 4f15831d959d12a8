"""Folders, and small files, of whatever file system Spark is on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local session without it gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodeseek-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}{uuid.uuid4().hex}"


class Files:
    """Hadoop's file system API, for the small files that say which version counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.root = root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet, as a whole; False if somebody else has written it."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            return False
        return True

    def remove(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def copy(self, name: str, to: str) -> None:
        path = self.jvm.org.apache.hadoop.fs.Path(to)
        conf = self.spark._jsc.hadoopConfiguration()
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), path.getFileSystem(conf), path, False, conf)
