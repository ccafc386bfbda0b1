"""Comparisons of methods keep an item's states in its row."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkdecide import catalog
from sparkdecide.functions import columns as C
from sparkdecide.operators import bandit as B
from sparkdecide.plans import bellman as P
from sparkdecide.plans import qlearning as Q
from tests import oracle


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "explodes"), [("e2_learned_against_optimum", 0), ("e2_all_methods", 1)])
def test_no_row_for_a_state_and_one_job_for_all_loops(spark, name, explodes):
    written = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/*"))
    before = written()
    plan = _plan(catalog.QUERIES[name](spark, oracle.SF))
    # the states' list of an item comes from a grid; besides, only methods are exploded
    assert plan.count("Generate explode") <= explodes + 1 and "Broadcast" not in plan
    assert [os.path.basename(p).split("-")[0] for p in written() - before] == ["solved"]


def test_greedy_from_q_makes_no_grid_and_equals_a_plain_search(spark):
    r = random.Random(3)
    q = [(i, x, y, r.choice((-1.0, 0.0, 2.0, 2.0, None, float("nan")))) for i in range(30) for x in range(-2, 5) for y in range(-3, 9) if r.random() < i / 30]
    states = [(i, x) for i in range(31) for x in range(-2, 9)]
    df = Q.greedy_from_q(spark.createDataFrame(q, "item long, x int, y int, q double"), spark.createDataFrame(states, "item long, x int"), 6)
    assert _plan(df).count("Generate") == 1
    known = {(i, x, y): v if v and v == v else 0.0 for i, x, y, v in q}
    want = {(i, x): max((known.get((i, x, y), 0.0), -y) for y in range(x, 7)) for i, x in states if x <= 6}
    assert {(s.item, s.x): (s.value, -s.y) for s in df.collect()} == want


def test_changes_of_sweeps_are_written_only_if_told(spark):
    params = spark.createDataFrame([(1, 1.0, 9.0, 0.0, 0.95, 1e-4, -2, 8)], "item long, h double, b double, c double, gamma double, theta double, x_min int, x_max int")
    pmf = spark.createDataFrame([(1, d, 0.2) for d in range(5)], "item long, d int, p double")
    m = P.Model(params, pmf)
    (out, changes), (same, none) = P.value_iteration(m), P.value_iteration(m, told=False)
    assert sorted(out.collect()) == sorted(same.collect()) and changes.count() == out.first().sweeps and none.count() == 0


def test_thompson_draws_where_the_request_is(spark):
    post = spark.createDataFrame([(c, a, 1.0 + 3 * a, 2.0 + c) for c in (0, 1) for a in (0, 1, 2)], "context long, arm int, alpha double, beta double")
    requests = spark.createDataFrame([(k, k % 2) for k in (*range(200), 7, 2**40, -5)] + [(None, 0)], "request_id long, context long")
    df = B.thompson_assign(requests, post, 3)
    # draws are dealt out over all tasks, however few bytes they take, and compared there
    assert "REPARTITION_BY_NUM" in _plan(df) and "max_by" not in _plan(df)
    scores = requests.distinct().join(post, "context").withColumn("score", C.beta_sample(F.col("request_id"), F.col("alpha"), F.col("beta"), 3, F.col("arm")))
    assert sorted(B.greedy_pick(scores, ["request_id", "context"]).collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["a12_sweep_delta", "a13_policy_changes", "c2_value_error"])
def test_neighbouring_sweeps_are_compared_in_the_item_s_row(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, oracle.SF))
    assert plan.count("Generate") == 0 and plan.count("lineitem.parquet") == 1
