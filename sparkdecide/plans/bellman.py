"""Value and policy iteration over all items.

Costs other than c * (y - x) do not depend on the state, so values of levels stand for all
pairs. Action values and one sweep under a policy (``Model.evaluate_once``) are projections of a row that holds an
item's demand and values as arrays. Items don't depend on each other, so loops over sweeps don't come back to
the driver: each item's parameters, demand, policy and start values meet in one row, and
tasks sweep batches of items until each has converged. That is one job with shuffles by
item, whatever the number of sweeps; an item's states and demands have to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.joins import merged
from ..operators.grids import initial_policy, state_grid
from ..storage import materialize
from .batches import SOLVED_DDL, solver, sweeper

SPAN = 10


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Few bytes, much work: rows by ``keys`` (item) in as many tasks as there are shuffle partitions, however small they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*(keys or ("item",))))


class Model:
    """Models of a set of items: their states, parameters and demand.

    params: item, h, b, c, gamma, theta, x_min, x_max. pmf: item, d, p.
    """

    def __init__(self, params: DataFrame, pmf: DataFrame, span: int = SPAN):
        self.span = span
        self.params, self.pmf = params, pmf
        self.states = state_grid(params)

    def by_item(self, policy: DataFrame | Callable[[Column], Column] | None = None, start: DataFrame | None = None) -> DataFrame:
        """item, its parameters, demand, policy and start, each in one row. A policy is a table or an expression of the state;
        such an expression needs no rows of states."""
        demand = self.pmf.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.col("d").cast("int").alias("d"), F.col("p").cast("double").alias("p")))).alias("demand"))
        rows = self.params.select(F.col("item").cast("long").alias("item"), *(F.col(k).cast("double").alias(k) for k in ("h", "b", "c", "gamma", "theta")), "x_min", "x_max")
        rows = merged(rows, demand, "item")
        if callable(policy):
            rows = rows.withColumn("policy", F.transform(F.sequence("x_min", "x_max"), lambda x: F.struct(x.alias("x"), policy(x).cast("int").alias("y"))))
        elif policy is not None:
            rows = merged(rows, policy.groupBy("item").agg(F.collect_list(F.struct("x", "y")).alias("policy")), "item")
        if start is not None:
            rows = merged(rows, start.groupBy("item").agg(F.collect_list(F.struct("x", "value")).alias("start")), "item")
        return rows.withColumns({k: F.lit(None).cast(t) for k, t in (("policy", "array<struct<x:int,y:int>>"), ("start", "array<struct<x:int,value:double>>")) if k not in rows.columns})

    def in_tasks(self, rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        """item, rounds, done, states (x, value, y), changes: a loop over each item, written once."""
        return materialize(spread(rows).mapInArrow(kernel, SOLVED_DDL), "solved")

    def solved(self, kind: str, most: int, most_sweeps: int = 0, policy: DataFrame | Callable[[Column], Column] | None = None, start: DataFrame | None = None, told: bool = True) -> DataFrame:
        return self.in_tasks(self.by_item(policy, start), solver(kind, self.span, most, most_sweeps, told))

    def zero(self) -> DataFrame:
        return self.states.select("item", "x", F.lit(0.0).alias("value"))

    def _with_values(self, v: DataFrame) -> DataFrame:
        """A row for each item: its parameters, demand, and v, the values of its states in order (0 for missing ones)."""
        of = v.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("x", "value"))).alias("_values"))
        values = F.transform(F.sequence("x_min", "x_max"), lambda x: F.coalesce(F.try_element_at("_values", x), F.lit(0.0)))
        return spread(merged(self.by_item(), of, "item")).withColumn("v", values).drop("_values")

    def _fixed(self) -> Column:
        """What each level from x_min on is worth without a next state."""
        nil = F.lit(0.0)

        def worth(y: Column) -> Column:
            def cost(e: Column) -> Column:
                left = (y - e["d"]).cast("double")
                return e["p"] * (F.col("h") * F.greatest(nil, left) + F.col("b") * F.greatest(nil, -left))

            return -F.col("c") * y - F.aggregate("demand", nil, lambda s, e: s + cost(e))

        return F.transform(F.sequence(F.col("x_min"), F.col("x_max") + self.span), worth)

    def _levels(self, fixed: Column, v: Column) -> Column:
        """g, the value of each level with v ahead: level number i is x_min + i, and a demand d leads to state number i - d, inside the range."""
        last = F.col("x_max") - F.col("x_min")

        def ahead(own: Column, i: Column) -> Column:
            return own + F.col("gamma") * F.aggregate("demand", F.lit(0.0), lambda s, e: s + e["p"] * F.get(v, F.greatest(F.lit(0), F.least(last, i - e["d"]))))

        return F.transform(fixed, ahead)

    def action_values(self, v: DataFrame) -> DataFrame:
        """item, y, c, g: value of having y on hand, without the part that depends on the state."""
        g = let(F.col("v"), lambda v: self._levels(self._fixed(), v))
        rows = self._with_values(v).select("item", "c", "x_min", F.posexplode(g).alias("i", "g"))
        return rows.select("item", (F.col("x_min") + F.col("i")).alias("y"), "c", "g")

    def q_values(self, v: DataFrame) -> DataFrame:
        """item, x, y, q for all pairs of state and action."""
        options = lambda g: F.transform(F.sequence("x_min", "x_max"), lambda x: F.struct(x.alias("x"), F.slice(g, x - F.col("x_min") + 1, F.lit(self.span + 1)).alias("g")))
        states = let(F.col("v"), lambda v: let(self._levels(self._fixed(), v), options))
        rows = self._with_values(v).select("item", "c", F.explode(states).alias("s"))
        rows = rows.select("item", "c", F.col("s.x").alias("x"), F.posexplode("s.g").alias("o", "g"))
        return rows.select("item", "x", (F.col("x") + F.col("o")).alias("y"), (F.col("c") * F.col("x") + F.col("g") + F.lit(0.0)).alias("q"))

    def backup(self, v: DataFrame | None, sweeps: int = 1) -> DataFrame:
        """item, x, value, y: optimality sweeps and the greedy policy of the last, from v (0 for missing values, and for all
        without a table). Levels within 1e-9 are ties, the lowest wins."""
        return self.backups(v, sweeps).select("item", F.explode("last").alias("s")).select("item", "s.x", "s.value", "s.y")

    def backups(self, v: DataFrame | None, sweeps: int) -> DataFrame:
        """item, last, before: the states (x, value, y) after so many sweeps and, if there are more than one, after one less.

        An item's values stay in its row, so several sweeps have no shuffle between them.
        """
        return spread(self.by_item(start=v)).mapInArrow(*sweeper(self.span, sweeps))

    def evaluate_once(self, policy: DataFrame, v: DataFrame) -> DataFrame:
        """item, x, value: one sweep under a fixed policy."""
        g = self.action_values(v)
        return merged(policy.select("item", "x", "y"), g, ["item", "y"]).select("item", "x", (F.col("c") * F.col("x") + F.col("g") + F.lit(0.0)).alias("value"))


def sweep_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """item, delta: largest change of a value."""
    both = merged(new.select("item", "x", F.col("value").alias("_n")), old.select("item", "x", F.col("value").alias("_o")), ["item", "x"])
    return both.groupBy("item").agg(F.max(F.abs(F.col("_n") - F.col("_o"))).alias("delta"))


def policy_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """item, changed (states with another action), stable."""
    both = merged(new.select("item", "x", F.col("y").alias("_n")), old.select("item", "x", F.col("y").alias("_o")), ["item", "x"])
    return both.groupBy("item").agg(F.sum((F.col("_n") != F.col("_o")).cast("long")).alias("changed")).withColumn("stable", F.col("changed") == 0)


def last_changes(model: Model, v: DataFrame | None, sweeps: int) -> DataFrame:
    """item, delta, changed, stable: what the last of ``sweeps`` sweeps (two or more) changed, compared in an item's row."""
    rows = model.backups(v, sweeps)
    delta = F.array_max(F.zip_with("last", "before", lambda a, b: F.abs(a["value"] - b["value"])))
    changed = F.size(F.filter(F.zip_with("last", "before", lambda a, b: a["y"] != b["y"]), lambda c: c)).cast("long")
    return rows.select("item", delta.alias("delta"), changed.alias("changed")).withColumn("stable", F.col("changed") == 0)


def value_range(v: DataFrame) -> DataFrame:
    return v.groupBy("item").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def by_state(solved: DataFrame, rounds: str, done: str) -> DataFrame:
    return solved.select("item", F.explode("states").alias("s"), F.col("rounds").alias(rounds), F.col("done").alias(done)).select("item", "s.*", rounds, done)


def _changes(solved: DataFrame) -> DataFrame:
    """item, sweep, delta."""
    return solved.select("item", F.posexplode("changes").alias("at", "delta")).select("item", (F.col("at") + 1).alias("sweep"), "delta")


def value_iteration(model: Model, max_sweeps: int = 1000, told: bool = True) -> tuple[DataFrame, DataFrame]:
    """(item, x, value, y, sweeps, converged; item, sweep, delta), each item until its change is under theta. The changes of all
    sweeps are more bytes than the values: they are only written if ``told``, and the second table is empty otherwise."""
    solved = model.solved("values", max_sweeps, told=told)
    return by_state(solved, "sweeps", "converged"), _changes(solved)


def policy_evaluation(model: Model, policy: DataFrame | Callable[[Column], Column], start: DataFrame | None = None, max_sweeps: int = 100, told: bool = True) -> tuple[DataFrame, DataFrame]:
    """(item, x, value, sweeps, converged; history) of a fixed policy."""
    solved = model.solved("policy", max_sweeps, policy=policy, start=start, told=told)
    return by_state(solved, "sweeps", "converged").drop("y"), _changes(solved)


def policy_improvement(model: Model, v: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, x, y greedy for v; item, changed, stable)."""
    better = model.backup(v).select("item", "x", "y")
    return better, policy_changes(better, policy)


def policy_iteration(model: Model, policy: DataFrame | Callable[[Column], Column] | None = None, pmf: DataFrame | None = None, max_iter: int = 100, max_sweeps: int = 100) -> DataFrame:
    """item, x, y, value, iterations, stable; values carry over between iterations, and items with a stable policy stop."""
    policy = initial_policy(model.states, pmf) if policy is None else policy
    return by_state(model.solved("iterate", max_iter, max_sweeps, policy=policy), "iterations", "stable")
