"""Regret of logged policies against arm probabilities, its curves and summaries.

Regret is of probabilities, not of rewards. All windows are partitioned by run or
series; none moves a whole log into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import instant_regret, is_optimal
from .bandit import best_arm


def attach_truth(log: DataFrame, arm_probs: DataFrame) -> DataFrame:
    """log with prob, best, best_prob, regret, optimal. arm_probs: context, arm, prob."""
    truth = arm_probs.join(best_arm(arm_probs), "context")
    joined = log.join(truth.select("context", "arm", "prob", "best", "best_prob"), ["context", "arm"])
    return joined.withColumns({"regret": instant_regret(F.col("best_prob"), F.col("prob")), "optimal": is_optimal(F.col("arm"), F.col("best"))})


def cumulative_metrics(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """log with cum_regret and cum_reward along each run."""
    keys = ["alg", "run"] if keys is None else keys
    so_far = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({"cum_regret": F.sum("regret").over(so_far), "cum_reward": F.sum("reward").over(so_far)})


def run_summary(metrics: DataFrame) -> DataFrame:
    """alg, step, and over the runs: mean and population deviation of regret, mean regret and reward, percent optimal."""
    return metrics.groupBy("alg", "step").agg(
        F.count("*").alias("n_runs"), F.avg("cum_regret").alias("mean_cum_regret"), F.stddev_pop("cum_regret").alias("std_cum_regret"),
        F.avg("regret").alias("mean_regret"), F.avg("cum_reward").alias("mean_cum_reward"), (100 * F.avg("optimal")).alias("pct_optimal"),
    )


def final_step(summary: DataFrame) -> DataFrame:
    """The last row of each algorithm."""
    rest = [c for c in summary.columns if c not in ("alg", "step")]
    return summary.groupBy("alg").agg(F.max("step").alias("step"), F.max_by(F.struct(*rest), "step").alias("s")).select("alg", "step", "s.*")


def uncertainty_band(summary: DataFrame) -> DataFrame:
    """alg, step, low, high: mean less and plus one deviation."""
    m, s = F.col("mean_cum_regret"), F.col("std_cum_regret")
    return summary.select("alg", "step", (m - s).alias("low"), (m + s).alias("high"))


def regret_report(log: DataFrame, arm_probs: DataFrame) -> DataFrame:
    """alg and its final summary."""
    return final_step(run_summary(cumulative_metrics(attach_truth(log, arm_probs))))


def forward_smooth(series: DataFrame, value: str, keys: list[str], order: str = "step", width: int = 50) -> DataFrame:
    """Mean of each row and the width - 1 after it; rows without a full window are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    full = series.withColumns({"smooth": F.avg(value).over(w), "_n": F.count(F.lit(1)).over(w)})
    return full.filter(F.col("_n") == width).drop("_n")


def trailing_smooth(series: DataFrame, value: str, keys: list[str], order: str = "step", width: int | None = None) -> DataFrame:
    """Mean of each row and those before it, up to ``width`` rows; by default a tenth of the series, at most 1000."""
    if width is not None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
        return series.withColumn("smooth", F.avg(value).over(w))
    # A width that differs by series: a series is cut into blocks of its width, so the last rows of a width are the end of one
    # block and the start of the next. Sums never run over more than a block, and the end of a block goes to the next one.
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    w = F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 10))).cast("int")
    s = series.withColumns({"_i": i, "_w": w}).withColumns({"_block": F.floor(F.col("_i") / F.col("_w")), "_off": F.pmod("_i", "_w")})
    block = Window.partitionBy(*keys, "_block")
    start, end = block.orderBy("_off").rowsBetween(Window.unboundedPreceding, 0), block.orderBy(F.desc("_off")).rowsBetween(Window.unboundedPreceding, 0)
    some = F.col(value).isNotNull().cast("int")
    s = s.withColumns({"_s": F.coalesce(F.sum(value).over(start), F.lit(0.0)), "_n": F.sum(some).over(start), "_rest": F.struct(F.coalesce(F.sum(value).over(end), F.lit(0.0)).alias("s"), F.sum(some).over(end).alias("n"))})
    own = s.select(*series.columns, "_block", "_off", "_s", "_n", F.lit(None).cast(s.schema["_rest"].dataType).alias("_rest"), F.lit(True).alias("_own"))
    sent = s.filter("_off > 0").select(*keys, (F.col("_block") + 1).alias("_block"), (F.col("_off") - 1).alias("_off"), "_rest", F.lit(False).alias("_own"))
    met = own.unionByName(sent, allowMissingColumns=True).withColumn("_rest", F.max("_rest").over(Window.partitionBy(*keys, "_block", "_off"))).filter("_own")
    total, n = (F.col(f"_{c}") + F.coalesce(f"_rest.{c}", F.lit(0)) for c in ("s", "n"))
    return met.select(*series.columns, F.when(n > 0, total / n).alias("smooth"))


def recent_mean(series: DataFrame, value: str, keys: list[str], order: str = "step", back: int = 1000, reports: int = 5) -> DataFrame:
    """Mean over the last back + 1 rows, at each n / reports-th row of a series."""
    by = Window.partitionBy(*keys).orderBy(order)
    s = series.withColumns({"recent": F.avg(value).over(by.rowsBetween(-back, 0)), "_i": F.row_number().over(by), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / reports))
    return s.filter(F.pmod(F.col("_i"), every) == 0).drop("_i", "_n")


def strided_rows(df: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """Every k-th row of each group from its first, k = max(1, rows // n)."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / n))
    return df.withColumns({"_i": i, "_k": k}).filter(F.pmod(F.col("_i"), F.col("_k")) == 0).drop("_i", "_k")
