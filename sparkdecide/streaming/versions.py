"""A table in versions: each is written aside and then named by a marker, whose creation is one step.

Readers list the markers, so they see whole versions only, while a stream goes on writing
new ones. A version that has a marker is never written again: a micro-batch that is run again
after a failure finds it and leaves it. One stream writes, any number of jobs read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def marks(spark: SparkSession, folder: str) -> dict[int, str]:
    """number -> text of the markers in a folder. A marker is an empty file, named by both."""
    fs, at = file_system(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return {int(n): text for n, _, text in (name.partition("-") for name in names if not name.startswith((".", "_")))}


def mark(spark: SparkSession, folder: str, number: int, text: str) -> None:
    fs, at = file_system(spark, f"{folder}/{number:012d}-{text}")
    fs.create(at, False).close()


class Versions:
    """A table at ``path`` in versions with growing numbers."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def known(self) -> dict[int, str]:
        return marks(self.spark, f"{self.path}/versions")

    def newest(self) -> int | None:
        return max(self.known(), default=None)

    def put(self, rows: DataFrame, number: int) -> None:
        """Write a version, unless it is there."""
        if number in self.known():
            return
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{attempt}")
        mark(self.spark, f"{self.path}/versions", number, attempt)

    def at(self, number: int) -> DataFrame:
        return self._read(self.known()[number])

    def _read(self, attempt: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{attempt}")

    def all(self, number_col: str | None = None) -> DataFrame:
        """The rows of all versions, for versions that add to each other; no rows if there are none."""
        found = [self._read(a) if number_col is None else self._read(a).withColumn(number_col, F.lit(n).cast("long")) for n, a in sorted(self.known().items())]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.schema)

    def pin(self, number: int, choice: str) -> str:
        """The choice made for a version before it is written: the first one, if there was any before."""
        folder = f"{self.path}/choices"
        known = marks(self.spark, folder)
        if number not in known:
            mark(self.spark, folder, number, choice)
        return known.get(number, choice)

    def expire(self, keep: int) -> None:
        """Remove all but the newest ``keep`` versions; none of the others may be in use or pinned by a batch to come."""
        for n, attempt in sorted(self.known().items())[: -keep or None]:
            for p in (f"{self.path}/versions/{n:012d}-{attempt}", f"{self.path}/data/{attempt}"):
                fs, at = file_system(self.spark, p)
                fs.delete(at, True)
