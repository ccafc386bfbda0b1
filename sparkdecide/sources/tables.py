"""Logical inputs from raw tables, and results as tables.

Each function declares the columns it gives; inputs may have any more. Nulls: rows
without a key (item, context, arm) are left out of counts and distributions, as they
belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def demand_pmf(df: DataFrame, item: Column, qty: Column) -> DataFrame:
    """item, d, p: share of each demand value of an item."""
    n = df.select(item.alias("item"), qty.cast("int").alias("d")).dropna().groupBy("item", "d").agg(F.count("*").alias("n"))
    total = Window.partitionBy("item")
    return n.select("item", "d", (F.col("n") / F.sum("n").over(total)).alias("p"))


def decision_log(df: DataFrame, *, step: Column, ts: Column, context: Column, arm: Column, reward: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """step, ts, context, arm, reward (and ``keys``) of a raw table or stream of decisions."""
    return df.select(
        step.cast("long").alias("step"), ts.alias("ts"), context.cast("long").alias("context"), arm.cast("int").alias("arm"), reward.cast("int").alias("reward"),
        *(c.alias(k) for k, c in (keys or {}).items()),
    ).filter("context is not null and arm is not null and reward is not null")


def demand_history(df: DataFrame, item: Column, qty: Column, ts: Column, order: list[Column]) -> DataFrame:
    """item, seq (1, 2, ... in order), ts, d."""
    seq = F.row_number().over(Window.partitionBy("item").orderBy("ts", *(f"_o{k}" for k in range(len(order)))))
    rows = df.select(item.alias("item"), ts.alias("ts"), qty.cast("int").alias("d"), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    return rows.filter("item is not null and d is not null").select("item", seq.cast("int").alias("seq"), "ts", "d")


def write_results(df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A result as Parquet, in folders by ``keys``; rows of a key are written together."""
    out = df.repartition(*keys) if keys else df
    w = out.write.mode(mode)
    (w.partitionBy(*keys) if keys else w).parquet(path)
