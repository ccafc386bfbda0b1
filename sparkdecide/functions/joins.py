"""Joins of tables without a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merged(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """a joined with b by sorting both, whatever their sizes seem to be.

    Spark takes exploded rows for as few bytes as those they come from, and keys of a small file for few rows, so it would
    gather tables that grow with the items on the driver and copy them to every executor.
    """
    return a.join(b.hint("merge"), on, how)


def dealt(rows: DataFrame, key: str = "item") -> DataFrame:
    """rows by ``key`` in as many tasks as there are shuffle partitions; grids shrink so much in a shuffle that Spark would join many into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
