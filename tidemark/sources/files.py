"""Folders and small files in the store that Spark reads, through its own file systems: a commit is one rename."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder of a store. Paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        fs, target = self._at(name)
        return fs.exists(target)

    def names(self, name: str) -> list[str]:
        """The entries of a folder, in order; none if there is no such folder."""
        fs, target = self._at(name)
        if not fs.exists(target):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(target))

    def remove(self, name: str) -> None:
        fs, target = self._at(name)
        fs.delete(target, True)

    def scratch(self, name: str) -> str:
        """A new name beside the committed ones, for data that is not committed yet."""
        return f"_pending/{name}-{uuid.uuid4().hex}"

    def commit(self, pending: str, name: str) -> None:
        """Give ``pending`` its final name. If the name is taken, another writer was first: nothing is replaced."""
        fs, target = self._at(name)
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(self._at(pending)[1], target):
            raise FileExistsError(self.path(name))

    def write_json(self, name: str, value: Any) -> None:
        """A small file with ``value``, there as a whole or not at all."""
        pending = self.scratch("json")
        fs, target = self._at(pending)
        out = fs.create(target, False)
        out.write(bytearray(json.dumps(value, sort_keys=True, default=str).encode()))
        out.close()
        self.commit(pending, name)

    def read_json(self, name: str) -> Any:
        fs, target = self._at(name)
        stream = fs.open(target)
        try:
            size = fs.getFileStatus(target).getLen()
            jvm = self.spark.sparkContext._jvm
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)))
        finally:
            stream.close()
