"""Tables that jobs share: written to the folder in ``spark.checkpoint.dir`` and read back.

Writing a table cuts the lineage, so that a lost executor costs a re-read and not
a re-computation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folder of each table that ``materialize`` wrote and that is still in use.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster that is ``spark.checkpoint.dir`` and it has to be set; a local
    session without it gets a temporary folder, as driver and executors are one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that is made of them is written; other DataFrames are left alone."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new``, made of ``old``, written in its place."""
    out = materialize(new, name)
    remove(old)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
