"""Tables that are replaced whole (S9), or kept up by a stream.

Every version is a Parquet folder of its own; a small commit file, created
last and never overwritten, names it.  A reader takes the highest commit, so
it sees the old table or the new one, never a part; a version whose writer
was lost has no commit and is never read.  Two writers cannot both commit a
version: creating the second commit file fails.

Folders are reached through Hadoop's file system, as Spark's own sinks do,
so any shared store works.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 12


class VersionedTable:
    """A table at ``root`` with a schema; ``commit`` swaps in a new version."""

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def current(self) -> dict:
        """version (0: none yet), folder and tag of the last commit."""
        names = self._commits()
        if not names:
            return {"version": 0, "folder": None, "tag": None}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/commits/{names[-1]}").first()[0]
        return json.loads(text)

    def read(self) -> DataFrame:
        """The last committed version (empty before the first)."""
        folder = self.current()["folder"]
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def commit(self, rows: DataFrame, tag=None, after: int | None = None) -> int:
        """Writes ``rows`` as the version after ``after`` (the current one) and swaps it in."""
        version = (self.current()["version"] if after is None else after) + 1
        folder = f"v{version:0{_DIGITS}d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        text = json.dumps({"version": version, "folder": folder, "tag": tag})
        # Fails if the version has been committed by another writer.
        out = self._fs.create(self._path(f"{self.root}/commits/{version:0{_DIGITS}d}.json"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return version
