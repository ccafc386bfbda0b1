"""Lookups and expectations of the inventory model, for many items at once.

Keys are ``item`` and states or actions; every index of a dense table is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import next_state
from ..functions.joins import dealt, merged


def value_lookup(keys: DataFrame, v: DataFrame, at: str = "x") -> DataFrame:
    """keys with value: V at the state, taken at the ends of the range where it lies outside."""
    ends = v.groupBy("item").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    k = merged(keys, ends, "item").withColumn("_x", F.greatest("_lo", F.least("_hi", F.col(at)))).drop("_lo", "_hi")
    return merged(k, v.select("item", F.col("x").alias("_x"), "value"), ["item", "_x"], "left").drop("_x")


def policy_lookup(keys: DataFrame, policy: DataFrame) -> DataFrame:
    """keys with y of their item and state."""
    return merged(keys, policy.select("item", "x", "y"), ["item", "x"], "left")


def nearest_known(keys: DataFrame, known: DataFrame) -> DataFrame:
    """keys with nearest: the known state of the item at the least distance, the lower on ties; known states may be sparse.

    Keys and known states are merged in their order, so each row sees the last known state up to it and the next one from
    it on: rows grow with the keys and the known states, not with their product.
    """
    rows = keys.withColumns({"_k": F.lit(None).cast("long"), "_key": F.lit(1)})
    there = known.select("item", F.col("x"), F.col("x").cast("long").alias("_k"), F.lit(0).alias("_key")).filter("item is not null and x is not null").distinct()
    of_item = Window.partitionBy("item")
    below, above = (F.last("_k", ignorenulls=True).over(of_item.orderBy(x, "_key").rowsBetween(Window.unboundedPreceding, 0)) for x in (F.asc("x"), F.desc("x")))
    both = rows.unionByName(there, allowMissingColumns=True).withColumns({"_below": below, "_above": above}).filter("_key = 1")
    lower = F.col("_above").isNull() | (F.col("x") - F.col("_below") <= F.col("_above") - F.col("x"))
    nearest = F.when(F.col("x").isNotNull(), F.when(F.col("_below").isNotNull() & lower, F.col("_below")).otherwise(F.col("_above")))
    return both.select(*keys.columns, nearest.cast(known.schema["x"].dataType).alias("nearest"))


def demand_cross(actions: DataFrame, pmf: DataFrame) -> DataFrame:
    """Every action of an item beside every demand of the item, with its probability."""
    return merged(actions, pmf.select("item", "d", "p"), "item")


def expected_cost(actions: DataFrame, pmf: DataFrame, params: DataFrame) -> DataFrame:
    """item, y, cost: expected holding and shortage cost of one period.

    From running sums of p and p * d over an item's demands, merged with its levels in their order: at a level the
    demands up to it are held against, the others are short. No level meets each demand.
    """
    levels = dealt(actions.select("item", F.col("y").alias("_at"))).distinct().withColumns({"_p": F.lit(0.0), "_pd": F.lit(0.0), "_level": F.lit(1)})
    demands = pmf.select("item", F.col("d").alias("_at"), F.col("p").alias("_p"), (F.col("p") * F.col("d")).alias("_pd"), F.lit(0).alias("_level"))
    of_item = Window.partitionBy("item")
    up_to = of_item.orderBy("_at", "_level").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}_{name}": F.sum(c).over(w) for c in ("_p", "_pd") for name, w in (("low", up_to), ("all", of_item))}
    rows = dealt(levels.unionByName(demands)).withColumns(sums | {"_known": F.min("_level").over(of_item)}).filter("_level = 1 and _known = 0")
    y = F.col("_at")
    held, short = y * F.col("_p_low") - F.col("_pd_low"), (F.col("_pd_all") - F.col("_pd_low")) - y * (F.col("_p_all") - F.col("_p_low"))
    return merged(rows, params.select("item", "h", "b"), "item").select("item", y.alias("y"), (F.col("h") * held + F.col("b") * short).alias("cost"))


def transitions(actions: DataFrame, pmf: DataFrame, params: DataFrame) -> DataFrame:
    """item, y, x_next, p: demands that lead to one state are one row."""
    pairs = merged(demand_cross(dealt(actions.select("item", "y")).distinct(), pmf), params.select("item", "x_min", "x_max"), "item")
    to = next_state(F.col("y"), F.col("d"), F.col("x_min"), F.col("x_max"))
    return pairs.groupBy("item", "y", to.alias("x_next")).agg(F.sum("p").alias("p"))


def expected_next_value(moves: DataFrame, v: DataFrame) -> DataFrame:
    """item, y, ev: expected value of the next state. moves: as ``transitions`` gives them."""
    both = merged(moves, v.select("item", F.col("x").alias("x_next"), "value"), ["item", "x_next"])
    return both.groupBy("item", "y").agg(F.sum(F.col("p") * F.col("value")).alias("ev"))


def sliding_best_action(g: DataFrame, span: int = 10) -> DataFrame:
    """item, y, best, arg: highest g and its smallest action among y .. y + span. Values within 1e-9 are ties."""
    ahead = Window.partitionBy("item").orderBy("y").rangeBetween(0, span)
    top = F.max(F.struct(F.round("g", 9).alias("r"), (-F.col("y")).alias("m"), F.col("g").alias("g"))).over(ahead)
    return g.withColumn("_t", top).select("item", "y", F.col("_t.g").alias("best"), (-F.col("_t.m")).alias("arg"))
