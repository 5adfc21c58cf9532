"""Versioned commits of several tables at once, with a check of the version they were made from.

Parquet has no transaction over tables. A commit writes all tables into a folder of its own, then creates the marker of
the next version, which fails if someone else was first; readers follow the newest marker. A commit that loses leaves only
an unreferenced folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, version: int) -> str:
        return f"{self.root}/_versions/{version:012d}.json"

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(n[:12]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table."""
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(self._marker(version), wholetext=True).first()
        return json.loads(lines[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.tables(version)[name])

    def commit(self, changed: dict[str, DataFrame], expected: int, appended: dict[str, DataFrame] | None = None) -> int:
        """Writes the tables and makes version ``expected`` + 1 of them and the unchanged ones; Conflict if that version is there already.

        ``changed`` tables are replaced, to ``appended`` ones rows are added.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        now = self.tables(expected)
        for name, df in changed.items():
            df.write.parquet(f"{folder}/{name}")
            now[name] = [f"{folder}/{name}"]
        for name, df in (appended or {}).items():
            df.write.parquet(f"{folder}/{name}+")
            now[name] = [*now.get(name, []), f"{folder}/{name}+"]
        if self.version() != expected:
            raise Conflict(f"version {expected} is no longer the newest")
        path = self._path(self._marker(expected + 1))
        self._fs.mkdirs(path.getParent())
        # The claim is made once, by one writer; the marker gets its name only when it is whole, so a reader never sees a part of it.
        try:
            self._fs.create(self._path(f"{self._marker(expected + 1)}.claim"), False).close()
        except Exception as e:
            raise Conflict(f"version {expected + 1} was claimed by another") from e
        part = self._path(f"{self._marker(expected + 1)}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(part, path):
            raise Conflict(f"version {expected + 1} could not be named")
        return expected + 1
