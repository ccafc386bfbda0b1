"""Arm statistics, policies and audits over logs of decisions.

Ties go to the lowest arm. Statistics are sums over the log, so they are order-free
and partial sums are taken before the shuffle. Empty logs give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ucb_score, unit_hash
from ..functions.draws import beta_draw
from ..functions.joins import dealt
from .grids import arm_grid

Score = Callable[[Column, Column, Column], Column]


def arm_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, arm, n, q: pulls and mean reward, 0 where an arm was never pulled."""
    by = ["context"] if by is None else by
    seen = log.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.avg("reward").alias("q"))
    return arm_grid(log, by).select(*by, "arm").join(seen, [*by, "arm"], "left").select(*by, "arm", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0.0)).alias("q"))


def arm_stats_blind(log: DataFrame) -> DataFrame:
    """arm, n, q over all contexts."""
    return log.groupBy("arm").agg(F.count("*").alias("n"), F.avg("reward").alias("q"))


def beta_posterior(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, arm, alpha, beta, mean of a Beta(1, 1) prior after the log."""
    by = ["context"] if by is None else by
    seen = log.groupBy(*by, "arm").agg((1 + F.sum("reward")).cast("double").alias("alpha"), (1 + F.sum(1 - F.col("reward"))).cast("double").alias("beta"))
    full = arm_grid(log, by).select(*by, "arm").join(seen, [*by, "arm"], "left").fillna(1.0, ["alpha", "beta"])
    return full.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def best_arm(stats: DataFrame, value: str = "prob", by: list[str] | None = None) -> DataFrame:
    """by, best, best_prob: the arm with the highest value."""
    by = ["context"] if by is None else by
    return stats.groupBy(*by).agg(F.max_by("arm", F.struct(value, -F.col("arm"))).alias("best"), F.max(value).alias("best_prob"))


def greedy_pick(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, arm of the highest score."""
    return scores.groupBy(*by).agg(F.max_by("arm", F.struct(score, -F.col("arm"))).alias("arm"))


def ucb_scores(stats: DataFrame, c: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """stats and score: the bound before the next choice of each context."""
    by = ["context"] if by is None else by
    t = (F.sum("n").over(Window.partitionBy(*by)) + 1).cast("double")
    return stats.withColumn("score", ucb_score(F.col("n"), F.col("q"), t, c))


def ucb_scores_blind(stats: DataFrame, c: float = 2.0) -> DataFrame:
    """The same over stats without a context; the arms are a handful of rows."""
    total = stats.agg((F.sum("n") + 1).cast("double").alias("t"))
    return stats.crossJoin(F.broadcast(total)).withColumn("score", ucb_score(F.col("n"), F.col("q"), F.col("t"), c)).drop("t")


def custom_scores(stats: DataFrame, score: Score, by: list[str] | None = None) -> DataFrame:
    """stats and score, from any expression over n, q and t (pulls of the context, the next included)."""
    by = ["context"] if by is None else by
    t = (F.sum("n").over(Window.partitionBy(*by)) + 1).cast("double")
    return stats.withColumn("score", score(F.col("n"), F.col("q"), t))


def epsilon_greedy_assign(requests: DataFrame, stats: DataFrame, eps: float = 0.1, seed: int = 1) -> DataFrame:
    """request_id, context, arm, explored. The draw depends on the request's id and the seed alone."""
    arms = stats.groupBy("context").agg(F.sort_array(F.collect_set("arm")).alias("arms"))
    known = greedy_pick(stats, ["context"], "q").withColumnRenamed("arm", "greedy").join(arms, "context")
    rows = requests.select("request_id", "context").join(known, "context")
    explored = unit_hash(F.col("request_id"), seed) < eps
    place = F.floor(unit_hash(F.col("request_id"), seed + 7) * F.size("arms")).cast("int")
    return rows.select("request_id", "context", F.when(explored, F.element_at("arms", place + 1)).otherwise(F.col("greedy")).alias("arm"), explored.cast("int").alias("explored"))


def thompson_assign(requests: DataFrame, posterior: DataFrame, seed: int = 1) -> DataFrame:
    """request_id, context, arm: the arm with the highest draw from its posterior. request_id and arm are integers.

    A context's arms stand beside its requests as a list, and a request's draws are made and compared where it is.
    """
    arms = posterior.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("arm", F.col("alpha").cast("double").alias("alpha"), F.col("beta").cast("double").alias("beta")))).alias("arms"))

    def picked(key: pa.Array, arms: pa.Array) -> pa.Array:
        sizes = arms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, flat = np.cumsum(sizes) - sizes, arms.flatten()
        arm, alpha, beta = (flat.field(k) for k in ("arm", "alpha", "beta"))
        known = np.repeat(key.is_valid().to_numpy(zero_copy_only=False), sizes)
        of = np.repeat(key.fill_null(0).to_numpy(zero_copy_only=False), sizes)
        score = np.where(known, beta_draw(of, alpha.to_numpy(), beta.to_numpy(), seed, arm.cast(pa.int64()).to_numpy()), -np.inf)
        top = np.repeat(np.maximum.reduceat(score, starts), sizes)
        best = np.minimum.reduceat(np.where(score == top, np.arange(len(score)), len(score) - 1), starts)
        return arm.take(pa.array(best))

    # few bytes, much work: Spark would draw for millions of requests in one task
    rows = dealt(requests.select("request_id", "context").distinct().join(arms, "context"), "request_id")
    pick = F.arrow_udf(picked, posterior.schema["arm"].dataType)(F.col("request_id").cast("long"), F.col("arms"))
    return rows.select("request_id", "context", pick.alias("arm"))


#: Decisions of a block whose running sums one window takes.
BLOCK = 1 << 14


def running_arm_stats(log: DataFrame, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """step, by, arm, chosen, n, q, t, alpha, beta before each decision, a row for each arm.

    Arms of one decision stand beside it, so the rows are log x arms. Running sums are taken in two
    levels: inside blocks of ``block`` consecutive step numbers, and over the blocks' totals, one row for
    each block and arm; so a context that holds most of the log is spread over its blocks. t counts the
    coming choice.
    """
    by = ["context"] if by is None else by
    arms = log.agg(F.sort_array(F.collect_set("arm")).alias("arms"))
    rows = log.select("step", *by, F.col("arm").alias("chosen"), "reward", F.floor(F.col("step") / block).alias("_block"))
    rows = rows.crossJoin(F.broadcast(arms)).select("*", F.explode("arms").alias("arm")).drop("arms")
    hit = (F.col("arm") == F.col("chosen")).cast("long")
    sums = {"n": hit, "s": hit * F.col("reward"), "t": F.lit(1)}
    totals = rows.groupBy(*by, "arm", "_block").agg(*(F.sum(x).alias(f"_{k}") for k, x in sums.items()))
    blocks = Window.partitionBy(*by, "arm").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*by, "arm", "_block", *(F.coalesce(F.sum(f"_{k}").over(blocks), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy(*by, "arm", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in sums.items()}).join(earlier, [*by, "arm", "_block"])
    n, s, t = (F.col(k) + F.col(f"_{k}") for k in ("n", "s", "t"))
    rows = rows.select("step", *by, "arm", "chosen", n.alias("n"), s.alias("s"), (t + 1).alias("t"))
    return rows.select("step", *by, "arm", "chosen", "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("q"), "t", (1.0 + F.col("s")).alias("alpha"), (1.0 + F.col("n") - F.col("s")).alias("beta"))


def policy_audit(log: DataFrame, c: float = 2.0, score: Score | None = None) -> DataFrame:
    """step, context, chosen, greedy, ucb, agrees_greedy, agrees_ucb: what each policy would have taken from the history so far.

    With ``score``, an expression over n, q and t (pulls of the context, the coming one included), also custom and agrees_custom.
    """
    r = running_arm_stats(log).withColumn("score", ucb_score(F.col("n"), F.col("q"), F.col("t").cast("double"), c))
    scores = {"greedy": F.col("q"), "ucb": F.col("score")}
    if score is not None:
        scores["custom"] = score(F.col("n"), F.col("q"), F.col("t"))
    low = -F.col("arm")
    picked = r.groupBy("step", "context", "chosen").agg(*(F.max_by("arm", F.struct(F.round(x, 9), low)).alias(name) for name, x in scores.items()))
    return picked.select("*", *((F.col("chosen") == F.col(name)).cast("int").alias(f"agrees_{name}") for name in scores))


def blind_audit(log: DataFrame, key: str, c: float = 2.0) -> DataFrame:
    """step, key, chosen, blind, agrees_blind: the context-blind bound within each log named by ``key``."""
    r = running_arm_stats(log, [key]).withColumn("score", ucb_score(F.col("n"), F.col("q"), F.col("t").cast("double"), c))
    picked = r.groupBy("step", key, "chosen").agg(F.max_by("arm", F.struct(F.round("score", 9), -F.col("arm"))).alias("blind"))
    return picked.withColumn("agrees_blind", (F.col("chosen") == F.col("blind")).cast("int"))
