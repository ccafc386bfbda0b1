"""Grids of states, actions and arms, and per-item starting points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import merged


def state_grid(params: DataFrame) -> DataFrame:
    """item, x: all integer states from x_min to x_max."""
    return params.filter("x_min <= x_max").select("item", F.explode(F.sequence("x_min", "x_max")).alias("x"))


def action_grid(states: DataFrame, span: int = 10) -> DataFrame:
    """Pairs x, y with x <= y <= x + span."""
    return states.withColumn("y", F.explode(F.sequence(F.col("x"), F.col("x") + span)))


def masked_action_grid(states: DataFrame, y_max: Column | int) -> DataFrame:
    """Pairs x, y with x <= y <= y_max; states above y_max have none."""
    top = F.lit(y_max) if isinstance(y_max, int) else y_max
    return states.filter(F.col("x") <= top).withColumn("y", F.explode(F.sequence(F.col("x"), top.cast("int"))))


def arm_grid(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every combination of context and arm that the log has in part, with n = 0 and q = 0.

    The arms are few: they are gathered into one row and repeated beside each context.
    """
    by = ["context"] if by is None else by
    arms = log.agg(F.sort_array(F.collect_set("arm")).alias("arms"))
    return log.select(*by).distinct().crossJoin(F.broadcast(arms)).select(*by, F.explode("arms").alias("arm"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("q"))


def instance_grid(d_max: DataFrame) -> DataFrame:
    """item, d_max, x_min, x_max, y_max, n_states, n_actions: problem sizes for each largest demand."""
    g = d_max.select("item", F.col("d_max").cast("int").alias("d_max"))
    g = g.withColumns({"x_min": -F.greatest(F.lit(2), F.floor(F.col("d_max") / 2).cast("int")), "x_max": 2 * F.col("d_max")})
    g = g.withColumn("y_max", F.col("x_max") + 2)
    return g.withColumns({"n_states": F.col("x_max") - F.col("x_min") + 1, "n_actions": F.col("y_max") - F.col("x_min") + 1})


def instance_demand(grid: DataFrame) -> DataFrame:
    """item, d, p: uniform demand from 0 to d_max of each instance."""
    return grid.select("item", F.explode(F.sequence(F.lit(0), F.col("d_max"))).alias("d"), (F.lit(1.0) / (F.col("d_max") + 1)).alias("p"))


def initial_policy(states: DataFrame, pmf: DataFrame) -> DataFrame:
    """item, x, y: order up to the largest demand."""
    return merged(states, pmf.groupBy("item").agg(F.max("d").alias("d_max")), "item").select("item", "x", F.greatest("x", "d_max").alias("y"))
