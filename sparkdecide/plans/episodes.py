"""Episodes from real demand or logs: backtests, returns, Monte Carlo values.

An episode is rows of (item, episode_id, t, x, y, reward). Returns are scanned in blocks of
steps, so one endless episode runs in parallel too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period_cost
from ..functions.joins import merged
from ..operators.inventory import nearest_known
from .batches import tracer
from .bellman import Model, by_state, spread

#: Steps of a block whose discounted sums one window takes, periods of one whose states are mapped together, and blocks of a group.
BLOCK, PERIODS, GROUP = 1 << 12, 1 << 8, 1 << 8


def base_stock_backtest(history: DataFrame, params: DataFrame, level: DataFrame, x0: int = 0) -> DataFrame:
    """item, seq, x, y, d, reward, x_next of an order-up-to policy on real demand.

    From x0 at or below the level the stock before an order is the level less the last
    demand, so one lag window does it. params: item, h, b, c, x_min, x_max; level: item, s.
    """
    rows = merged(merged(history, params.select("item", "h", "b", "c", "x_min", "x_max"), "item"), level.select("item", "s"), "item")
    last = F.lag("d").over(Window.partitionBy("item").orderBy("seq"))
    x = F.when(last.isNull(), F.lit(x0)).otherwise(F.greatest("x_min", F.least("x_max", F.col("s") - last)))
    rows = rows.withColumn("x", x.cast("int")).withColumn("y", F.greatest("x", "s"))
    reward = -period_cost(F.col("y"), F.col("d"), F.col("x"), F.col("h"), F.col("b"), F.col("c")) + F.lit(0.0)
    to = F.greatest("x_min", F.least("x_max", F.col("y") - F.col("d")))
    return rows.select("item", "seq", "x", "y", "d", reward.alias("reward"), to.alias("x_next"))




def _levels(params: DataFrame, policy: DataFrame, x0: int) -> DataFrame:
    """item, x_min, x_max, lo, levels: the policy's action of every state from lo on, that of the nearest one it has."""
    grid = params.select("item", F.explode(F.sequence(F.least("x_min", F.lit(x0)), F.greatest("x_max", F.lit(x0)))).alias("x"))
    acts = policy.select("item", F.col("x").alias("nearest"), "y")
    of = merged(nearest_known(grid, acts.select("item", F.col("nearest").alias("x"))), acts, ["item", "nearest"]).groupBy("item")
    levels = of.agg(F.min("x").alias("lo"), F.transform(F.array_sort(F.collect_list(F.struct("x", F.col("y").cast("int").alias("y")))), lambda s: s["y"]).alias("levels"))
    return merged(params.select("item", "x_min", "x_max"), levels, "item")


def policy_backtest(history: DataFrame, params: DataFrame, policy: DataFrame, x0: int = 0, block: int = PERIODS, group: int = GROUP) -> DataFrame:
    """The same for any policy (item, x, y), one long history in parallel too.

    Under a policy a demand is a map from the state before it to the next one. A block of ``block`` numbers of seq is the
    composition of its maps, and a group of ``group`` blocks that of theirs; from x0 over an item's groups, the blocks of a
    group and the periods of a block, every period's state follows. A state that the policy doesn't have takes the
    action of the nearest one it has, the lower on ties.
    """
    known = _levels(params, policy, x0)
    cut = history.select("item", F.floor(F.col("seq") / block).alias("k"), "seq", F.col("d").cast("int").alias("d"))
    steps = cut.groupBy("item", "k").agg(F.array_sort(F.collect_list(F.struct("seq", "d"))).alias("steps"))
    # nothing follows an item's last block, so that needs no map; most items have no other
    steps = steps.withColumn("last", F.max("k").over(Window.partitionBy("item")))
    blocks = spread(merged(steps, known, "item"), "item", "k")

    def act(x: Column) -> Column:
        return F.get("levels", x - F.col("lo"))

    def after(x: Column, d: Column) -> Column:
        return F.greatest("x_min", F.least("x_max", act(x) - d))

    states = F.transform(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: i + F.col("lo"))
    mapped = F.aggregate("steps", states, lambda at, s: F.transform(at, lambda x: after(x, s["d"])))
    pieces = blocks.select("item", "k", "lo", F.size("levels").alias("n"), F.when(F.col("k") < F.col("last"), mapped).alias("to"))
    piece = F.array_sort(F.collect_list(F.struct("k", "to"))).alias("pieces")
    groups = pieces.groupBy("item", F.floor(F.col("k") / group).alias("g")).agg(piece, F.first("lo").alias("lo"), F.first("n").alias("n"))
    start = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i + F.col("lo"))
    whole = F.aggregate("pieces", start, lambda at, p: F.transform(at, lambda x: F.get(p["to"], x - F.col("lo"))))
    # k and the state before it, for maps in order
    none = F.expr("cast(array() as array<struct<k:bigint,x:int>>)")

    def before(maps: Column, x: Column) -> Column:
        begin = F.struct(x.cast("int").alias("x"), none.alias("seen"))
        return F.explode(F.aggregate(maps, begin, lambda at, p: F.struct(F.get(p["to"], at["x"] - F.col("lo")).alias("x"), F.concat(at["seen"], F.array(F.struct(p["k"].alias("k"), at["x"].alias("x")))).alias("seen")))["seen"])

    each = groups.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("k"), whole.alias("to")))).alias("groups"), F.first("lo").alias("lo"))
    each = each.select("item", before(F.col("groups"), F.lit(x0)).alias("s")).select("item", F.col("s.k").alias("g"), F.col("s.x").alias("x"))
    each = groups.join(each, ["item", "g"]).select("item", before(F.col("pieces"), F.col("x")).alias("s")).select("item", "s.k", "s.x")
    run = F.aggregate("steps", F.array("x"), lambda at, s: F.concat(at, F.array(after(F.element_at(at, -1), s["d"]))))
    rows = blocks.join(each, ["item", "k"]).withColumn("_run", run)
    period = F.explode(F.transform("steps", lambda s, i: F.struct(s["seq"].alias("seq"), s["d"].alias("d"), F.get("_run", i).alias("x"), F.get("_run", i + 1).alias("x_next"), act(F.get("_run", i)).alias("y"))))
    rows = merged(rows.select("item", period.alias("s")).select("item", "s.*"), params.select("item", "h", "b", "c"), "item")
    reward = -period_cost(F.col("y"), F.col("d"), F.col("x"), F.col("h"), F.col("b"), F.col("c")) + F.lit(0.0)
    return rows.select("item", "seq", "x", "y", "d", reward.alias("reward"), "x_next")




def block_length(gamma: float, most: int = BLOCK) -> int:
    """Steps over which powers of gamma stay within 1e-100 and 1e100."""
    return most if gamma in (0.0, 1.0) else max(1, min(most, int(230 / abs(math.log(gamma)))))


def _from_the_end(pieces: Column, end: Column) -> Column:
    """For pieces (k, a, c) in order, each with value c + a * (value of the next one): (k, ahead), the next one's value; ``end`` is after the last."""
    start = F.struct(end.alias("value"), F.expr("cast(array() as array<struct<k:bigint,ahead:double>>)").alias("seen"))
    done = F.aggregate(F.reverse(pieces), start, lambda at, x: F.struct((x["c"] + x["a"] * at["value"]).alias("value"), F.concat(F.array(F.struct(x["k"].alias("k"), at["value"].alias("ahead"))), at["seen"]).alias("seen")))
    return done["seen"]


def _composed(pieces: Column) -> Column:
    """(a, c) of all pieces as one."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
    return F.aggregate(F.reverse(pieces), start, lambda at, x: F.struct((x["a"] * at["a"]).alias("a"), (x["c"] + x["a"] * at["c"]).alias("c")))


def values_ahead(blocks: DataFrame, keys: list[str], end: Column, group: int = GROUP) -> DataFrame:
    """keys, k, ahead: the value after block k, over blocks keys, k, a, c, last, terminal of maps value -> c + a * value.

    ``end`` is what stands after an episode's last block, from ``last`` of that block and ``terminal``. Blocks are composed
    within groups of ``group`` numbers, then the groups of an episode one after the other, and each group
    is gone through again with what stands after it. An episode's row holds three numbers for each of its blocks.
    """
    piece = F.sort_array(F.collect_list(F.struct("k", "a", "c"))).alias("pieces")
    groups = blocks.groupBy(*keys, F.floor(F.col("k") / group).alias("_g")).agg(piece, F.max_by("last", "k").alias("last"), F.max("terminal").alias("terminal")).withColumn("_of", _composed(F.col("pieces")))
    over = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_g").alias("k"), F.col("_of.a").alias("a"), F.col("_of.c").alias("c"), "pieces"))).alias("groups"), F.max_by("last", "_g").alias("last"), F.max("terminal").alias("terminal"))
    after = F.explode(F.arrays_zip(_from_the_end(F.col("groups"), end).alias("at"), F.col("groups.pieces").alias("pieces"))).alias("_x")
    each = over.select(*keys, after).select(*keys, F.explode(_from_the_end(F.col("_x.pieces"), F.col("_x.at.ahead"))).alias("_y"))
    return each.select(*keys, "_y.k", "_y.ahead")


def discounted_return(
    episodes: DataFrame, gamma: float = 0.95, convention: str = "shifted", terminal: DataFrame | None = None, keys: list[str] | None = None, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """episodes with g, the return from each step on.

    standard: g_t = r_t + gamma * g_(t+1), the terminal value after the last step.
    shifted: as the inventory evaluation counts it: at the last step T, r_T + gamma * r_(T+1)
    with the terminal value as r_(T+1), before that r_(t+1) + gamma * g_(t+1).
    A null reward counts as 0; equal t are ordered by the other columns. gamma is 0 or more.

    A suffix scan in blocks of ``block`` numbers of t, so that an endless episode is spread over its blocks.
    Inside a block, sums of gamma^j r_j run from its end; over the blocks, a block is the map from the value after it
    to its own. t are step numbers: far apart ones cost more blocks, not another result.
    """
    if gamma < 0:
        raise ValueError("gamma is 0 or more")
    keys = ["item", "episode_id"] if keys is None else keys
    plain = [f for f in episodes.schema.fields if f.name not in (*keys, "t") and f.dataType.typeName() not in ("map", "variant")]
    back = [F.desc("t"), *(F.desc(f.name) for f in plain)]
    in_block = Window.partitionBy(*keys, "_block").orderBy(*back)
    rows = episodes.withColumn("_block", F.floor(F.col("t") / block_length(gamma, block)).cast("long")).withColumn("_r", F.coalesce(F.col("reward").cast("double"), F.lit(0.0)))
    rows = rows.withColumn("_k", F.row_number().over(in_block))
    standard = convention == "standard"
    # sums from the block's end to this step, or to the one after it
    to = 0 if standard else -1
    if gamma == 0:
        rows = rows.withColumn("_s", F.col("_r") if standard else F.coalesce(F.lag("_r").over(in_block), F.lit(0.0)))
        power = F.when(F.col("_k") == (0 if standard else 1), 1.0).otherwise(0.0)
        own = F.col("_r")
    else:
        run = F.sum(F.col("_r") * F.pow(F.lit(gamma), -F.col("_k"))).over(in_block.rowsBetween(Window.unboundedPreceding, to))
        power = F.pow(F.lit(gamma), F.col("_k") + (0 if standard else -1))
        rows = rows.withColumn("_s", F.coalesce(run, F.lit(0.0)) * power)
        own = F.col("_s") if standard else F.col("_r") + gamma * F.col("_s")
    blocks = rows.groupBy(*keys, F.col("_block").alias("k")).agg(F.pow(F.lit(gamma), F.max("_k")).alias("a"), F.max_by(own, "_k").alias("c"), F.min_by("_r", "_k").alias("last"))
    if terminal is None:
        blocks = blocks.withColumn("terminal", F.lit(0.0))
    else:
        blocks = blocks.join(terminal.groupBy(*keys).agg(F.max(F.col("terminal").cast("double")).alias("terminal")), keys, "left")
    end = F.coalesce("terminal", F.lit(0.0))
    if not standard:  # the last reward counts at the last step too
        end = F.col("last") + gamma * end
    ahead = values_ahead(blocks, keys, end, group).select(*(F.col(c).alias(f"_{c}") for c in keys), "k", "ahead")
    same = F.col("_block") == F.col("k")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(ahead, same).select(*episodes.columns, (F.col("_s") + power * F.col("ahead") + F.lit(0.0)).alias("g"))


def _nth_visit(visit: str, keys: list[str]) -> Column:
    """1 at an episode's last (or first) visit of a state."""
    return F.row_number().over(Window.partitionBy(*keys, "x").orderBy(F.desc("t") if visit == "last" else F.asc("t")))


def visit_filter(returns: DataFrame, visit: str = "last", keys: list[str] | None = None) -> DataFrame:
    """One row for each episode and state: its last visit, or its first."""
    return returns.withColumn("_n", _nth_visit(visit, ["item", "episode_id"] if keys is None else keys)).filter("_n = 1").drop("_n")


def mc_value(returns: DataFrame, states: DataFrame) -> DataFrame:
    """item, x, value, n: mean return of each state, 0 where it was never visited."""
    seen = returns.groupBy("item", "x").agg(F.avg("g").alias("value"), F.count("*").alias("n"))
    return merged(states.select("item", "x"), seen, ["item", "x"], "left").fillna(0.0, ["value"]).fillna(0, ["n"])


def visit_counts(episodes: DataFrame, states: DataFrame) -> DataFrame:
    """item, x, n, share (percent of the item's visits)."""
    seen = episodes.groupBy("item", "x").agg(F.count("*").alias("n"))
    n = merged(states.select("item", "x"), seen, ["item", "x"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("item"))
    return n.withColumn("share", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0))


def visit_extremes(visits: DataFrame) -> DataFrame:
    """item, total, most, least: most and least visited state, the lowest on ties."""
    return visits.groupBy("item").agg(F.sum("n").alias("total"), F.max_by("x", F.struct("n", -F.col("x"))).alias("most"), F.min_by("x", F.struct("n", "x")).alias("least"))


def episode_reward(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = ["item", "episode_id"] if keys is None else keys
    return rows.groupBy(*keys).agg(F.sum("reward").alias("total_reward"), F.count("*").alias("steps"))


def mc_evaluate(episodes: DataFrame, states: DataFrame, gamma: float = 0.95, visit: str = "last", convention: str = "shifted", terminal: DataFrame | None = None) -> DataFrame:
    """item, x, value, n, visits from logged episodes, in one pass over the returns."""
    g = discounted_return(episodes, gamma, convention, terminal).withColumn("_n", _nth_visit(visit, ["item", "episode_id"]))
    counted = F.when(F.col("_n") == 1, F.col("g"))
    seen = g.groupBy("item", "x").agg(F.avg(counted).alias("value"), F.count(counted).alias("n"), F.count("*").alias("visits"))
    return merged(states.select("item", "x"), seen, ["item", "x"], "left").fillna(0.0, ["value"]).fillna(0, ["n", "visits"])


def cut_episodes(backtest: DataFrame, length: int) -> DataFrame:
    """A backtest as episodes of ``length`` periods: item, episode_id, t, x, y, reward."""
    return backtest.select("item", F.floor((F.col("seq") - 1) / length).cast("long").alias("episode_id"), (F.pmod(F.col("seq") - 1, F.lit(length)) + 1).alias("t"), "x", "y", "reward", "x_next")


def trace_policy_iteration(
    model: Model, history: DataFrame, policy: DataFrame | Callable[[Column], Column], terminal_value: Callable[[Column, Column], Column], gamma: float = 0.95, length: int = 10, max_iter: int = 5, x0: int = 0
) -> DataFrame:
    """item, x, y, value, iterations, stable: Monte Carlo policy iteration on fixed historical demand.

    An iteration rolls the policy over the item's demand (a backtest cut into episodes of ``length`` periods), takes the mean
    shifted return of each state's last visits, and improves. Items don't depend on each other, so tasks run batches of
    items until their policies stay: one job, whatever the number of iterations. ``terminal_value`` is an expression
    of the end state and the cost of an item; it is computed for every state beforehand. So may ``policy`` be, of the state. An item's history has to fit a task.
    """
    return by_state(model.in_tasks(traced_rows(model, history, policy, terminal_value), tracer(model.span, max_iter, x0, length, gamma)), "iterations", "stable")


def traced_rows(model: Model, history: DataFrame, policy: DataFrame | Callable[[Column], Column], terminal_value: Callable[[Column, Column], Column]) -> DataFrame:
    """The model's rows with policy, history and terminal values, as ``tracer`` takes them."""
    demand = history.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("d").cast("long").alias("d")))), lambda x: x["d"]).alias("history"))
    at_end = F.transform(F.sequence("x_min", "x_max"), lambda x: F.struct(x.alias("x"), terminal_value(x, F.col("c")).cast("double").alias("value")))
    return merged(model.by_item(policy if callable(policy) else policy.select("item", "x", "y")).withColumn("terminal", at_end), demand, "item", "left")
