import random

import pytest
from pyspark.sql import functions as F

from sparkdecide.functions import columns as C
from sparkdecide.operators import bandit as B
from sparkdecide.operators import regret as R

LOG = "step long, context long, arm int, reward int, alg string, run long"


def some_log(spark, n=200):
    r = random.Random(4)
    return spark.createDataFrame([(k, r.randrange(2), r.randrange(3), int(r.random() < 0.4), "a", k % 4) for k in range(n)], LOG)


def test_ties_go_to_the_lowest_arm(spark):
    s = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 0, 0.5)], "context int, arm int, score double")
    assert B.greedy_pick(s, ["context"]).first()["arm"] == 1


def test_arms_never_pulled_come_first(spark):
    log = spark.createDataFrame([(0, 0, 0, 1, "a", 0), (1, 1, 1, 0, "a", 0)], LOG)
    s = B.ucb_scores(B.arm_stats(log))
    assert {(r.context, r.arm): r.score == float("inf") for r in s.collect()} == {(0, 0): False, (0, 1): True, (1, 0): True, (1, 1): False}


def test_statistics_fit_together(spark):
    log = some_log(spark)
    by_arm = {r.arm: r.n for r in B.arm_stats_blind(log).collect()}
    assert by_arm == {r[0]: r[1] for r in B.arm_stats(log).groupBy("arm").agg(F.sum("n")).collect()}
    for r in B.beta_posterior(log).join(B.arm_stats(log), ["context", "arm"]).collect():
        assert r.alpha + r.beta - 2 == r.n


@pytest.mark.parametrize("block", [7, B.BLOCK])
def test_running_statistics_by_hand(spark, block):
    rows = [tuple(r) for r in some_log(spark, 60).select("step", "context", "arm", "reward").collect()]
    got = {(r.step, r.arm): (r.n, round(r.q, 9), r.t) for r in B.running_arm_stats(some_log(spark, 60), block=block).collect()}
    for step, context, _, _ in rows:
        before = [x for x in rows if x[0] < step and x[1] == context]
        for arm in range(3):
            mine = [x[3] for x in before if x[2] == arm]
            assert got[step, arm] == (len(mine), round(sum(mine) / len(mine), 9) if mine else 0.0, len(before) + 1)


def test_regret_is_never_negative_and_grows(spark):
    log = some_log(spark)
    probs = log.groupBy("context", "arm").agg(F.avg("reward").alias("prob"))
    m = R.cumulative_metrics(R.attach_truth(log, probs))
    assert m.filter("regret < 0").count() == 0
    runs = {}
    for r in m.orderBy("step").collect():
        runs.setdefault(r.run, []).append(r.cum_regret)
    assert all(a <= b + 1e-12 for v in runs.values() for a, b in zip(v, v[1:]))


def test_assignments_do_not_depend_on_partitions(spark):
    log = some_log(spark)
    requests = spark.range(300).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("context"))
    stats, post = B.arm_stats(log), B.beta_posterior(log)
    for make in (lambda q: B.epsilon_greedy_assign(q, stats, 0.3, 2), lambda q: B.thompson_assign(q, post, 2)):
        a = sorted(map(tuple, make(requests).collect()))
        assert a == sorted(map(tuple, make(requests.repartition(7)).collect()))
        assert len(a) == 300
    explored = B.epsilon_greedy_assign(requests, stats, 0.3, 2).agg(F.avg("explored")).first()[0]
    assert 0.2 < explored < 0.4


def test_thompson_prefers_the_better_arm(spark):
    post = spark.createDataFrame([(0, 0, 90.0, 10.0), (0, 1, 10.0, 90.0)], "context long, arm int, alpha double, beta double")
    q = spark.range(200).select(F.col("id").alias("request_id"), F.lit(0).cast("long").alias("context"))
    assert B.thompson_assign(q, post).filter("arm = 0").count() == 200


def test_smoothing(spark):
    s = spark.createDataFrame([("a", k, float(k)) for k in range(1, 101)], "alg string, step int, v double")
    f = {r.step: r.smooth for r in R.forward_smooth(s, "v", ["alg"], width=50).collect()}
    assert sorted(f) == list(range(1, 52)) and f[1] == 25.5
    t = {r.step: r.smooth for r in R.trailing_smooth(s, "v", ["alg"]).collect()}  # a tenth: ten wide
    assert t[1] == 1.0 and t[2] == 1.5 and abs(t[100] - 95.5) < 1e-9
    m = R.recent_mean(s, "v", ["alg"], back=4).collect()
    assert {r.step: r.recent for r in m} == {20: 18.0, 40: 38.0, 60: 58.0, 80: 78.0, 100: 98.0}


def test_empty_log(spark):
    none = spark.createDataFrame([], LOG)
    assert B.arm_stats(none).count() == B.beta_posterior(none).count() == B.policy_audit(none).count() == 0


def test_beta_draws_have_their_mean_and_spread(spark):
    for a, b in ((1.0, 1.0), (3.0, 9.0), (400.0, 100.0)):
        r = spark.range(20000).select(C.beta_sample(F.col("id"), F.lit(a), F.lit(b), 4).alias("x")).agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
        var = a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(r[0] - a / (a + b)) < 5 * (var / 20000) ** 0.5 and abs(r[1] / var - 1) < 0.1 and 0 < r[2] < r[3] < 1


def test_trailing_means_keep_small_values_beside_large_ones(spark):
    """Widths differ by series; a series on a high level loses nothing to long sums; nulls don't count."""
    rows = [("a", k, 1e9 + (k % 3) / 8) for k in range(4000)] + [("b", k, None if k % 5 == 0 else float(k)) for k in range(57)] + [("c", 0, 2.5)]
    s = spark.createDataFrame(rows, "alg string, step int, v double").repartition(4)
    got = {(r.alg, r.step): r.smooth for r in R.trailing_smooth(s, "v", ["alg"]).collect()}
    assert len(got) == len(rows)
    for alg, width in (("a", 400), ("b", 5), ("c", 1)):
        values = [v for a, _, v in rows if a == alg]
        for k in range(0, len(values), 37):
            some = [v for v in values[max(0, k - width + 1) : k + 1] if v is not None]
            want = sum(v - 1e9 for v in some) / len(some) + 1e9 if alg == "a" else sum(some) / len(some) if some else None
            assert got[alg, k] == (want if want is None else pytest.approx(want, abs=3e-6)), (alg, k)
