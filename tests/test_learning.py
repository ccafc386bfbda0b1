import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdecide.plans import bellman as P
from sparkdecide.plans import episodes as E
from sparkdecide.plans import qlearning as Q
from sparkdecide.streaming import bandit as S


def test_returns_by_hand(spark):
    e = spark.createDataFrame([(1, 1, t, t, 0, float(t)) for t in (1, 2, 3)], "item long, episode_id long, t int, x int, y int, reward double")
    end = spark.createDataFrame([(1, 1, 4.0)], "item long, episode_id long, terminal double")
    g = {r.t: r.g for r in E.discounted_return(e, 0.5, terminal=end).collect()}
    assert g == {3: 5.0, 2: 5.5, 1: 4.75}
    g = {r.t: r.g for r in E.discounted_return(e, 0.5, "standard", end).collect()}
    assert g == {3: 5.0, 2: 4.5, 1: 3.25}


def test_visits_and_values(spark):
    e = spark.createDataFrame([(1, 1, 1, 0, 0, 1.0), (1, 1, 2, 0, 0, 2.0), (1, 1, 3, 5, 0, 3.0)], "item long, episode_id long, t int, x int, y int, reward double")
    states = spark.createDataFrame([(1, x) for x in (0, 5, 7)], "item long, x int")
    assert sorted(r.t for r in E.visit_filter(e).collect()) == [2, 3]
    assert sorted(r.t for r in E.visit_filter(e, "first").collect()) == [1, 3]
    v = {r.x: (r.value, r.n, r.visits) for r in E.mc_evaluate(e, states, 1.0).collect()}
    assert v[7] == (0.0, 0, 0) and v[0][1:] == (1, 2)
    assert abs(sum(r.share for r in E.visit_counts(e, states).collect()) - 100) < 1e-9


def history(spark, items=3, n=40):
    r = random.Random(9)
    return spark.createDataFrame([(i, k, r.randrange(5)) for i in range(items) for k in range(1, n + 1)], "item long, seq int, d int")


PARAMS = "item long, h double, b double, c double, gamma double, theta double, x_min int, x_max int"


def test_backtest_of_a_level_equals_the_fold(spark):
    params = spark.createDataFrame([(i, 1.0, 9.0, 0.5, 0.5, 0.01, -2, 8) for i in range(3)], PARAMS)
    level = spark.createDataFrame([(i, 3 + i) for i in range(3)], "item long, s int")
    policy = level.select("item", F.explode(F.sequence(F.lit(-2), F.lit(8))).alias("x"), "s").select("item", "x", F.greatest("x", "s").alias("y"))
    a = E.base_stock_backtest(history(spark), params, level)
    b = E.policy_backtest(history(spark), params, policy).select(*a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_trace_policy_iteration_ends(spark):
    params = spark.createDataFrame([(i, 1.0, 9.0, 0.0, 0.5, 0.01, -2, 8) for i in range(2)], PARAMS)
    pmf = spark.createDataFrame([(i, d, 0.2) for i in range(2) for d in range(5)], "item long, d int, p double")
    m = P.Model(params, pmf)
    start = m.states.select("item", "x", F.greatest("x", F.lit(2)).alias("y"))
    out = E.trace_policy_iteration(m, history(spark, 2), start, lambda x, c: -c * F.greatest(x, F.lit(0)), 0.5, 10, 3)
    assert out.count() == 22 and out.filter("y < x").count() == 0


TRANSITIONS = "item long, episode_id string, t int, x int, y int, reward double, x_next int"


def transitions(spark):
    r = random.Random(2)
    return spark.createDataFrame([(i, f"e{k // 5}", k % 5, r.randrange(4), r.randrange(4, 6), r.random(), r.randrange(4)) for i in range(3) for k in range(30)], TRANSITIONS)


def test_q_learning_by_hand(spark):
    got = {(r.item, r.x, r.y): (round(r.q, 9), r.n) for r in Q.q_learning(transitions(spark).repartition(5), 6).collect()}
    want, count = {}, {}
    for r in sorted(transitions(spark).collect(), key=lambda r: (r.item, r.episode_id, r.t)):
        k = (r.item, r.x, r.y)
        count[k] = count.get(k, 0) + 1
        top = max(want.get((r.item, r.x_next, a), 0.0) for a in range(r.x_next, 7))
        want[k] = want.get(k, 0.0) + 0.1 / (1 + 0.001 * count[k]) * (r.reward + 0.95 * top - want.get(k, 0.0))
    assert got == {k: (round(v, 9), count[k]) for k, v in want.items()}


def test_greedy_from_q_fills_gaps(spark):
    q = spark.createDataFrame([(1, 0, 3, 2.0), (1, 0, 1, 2.0), (1, 5, 6, -1.0)], "item long, x int, y int, q double")
    states = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "item long, x int")
    got = {r.x: (r.y, r.value) for r in Q.greedy_from_q(q, states, 6).collect()}
    assert got == {0: (1, 2.0), 5: (5, 0.0)}  # state 9 has no action up to 6


def test_stream_q_learning_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = transitions(spark)
    for k, name in enumerate(("e0", "e1", "e2", "e3", "e4", "e5")):  # one episode a file, in order
        rows.filter(F.col("episode_id") == name).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def put(batch, number):
        for r in batch.collect():
            out[r.item, r.x, r.y] = (round(r.q, 9), r.n)

    S.stream_q_learning(stream, 6).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert out == {(r.item, r.x, r.y): (round(r.q, 9), r.n) for r in Q.q_learning(rows, 6).collect()}


def returned(rewards, gamma, convention, end):
    """Returns of one episode, step by step from its end."""
    out, g = [], None
    for t in range(len(rewards) - 1, -1, -1):
        if convention == "standard":
            g = rewards[t] + gamma * (end if g is None else g)
        else:
            g = rewards[t] + gamma * end if g is None else rewards[t + 1] + gamma * g
        out.append(g)
    return out[::-1]


@pytest.mark.parametrize("convention", ["shifted", "standard"])
@pytest.mark.parametrize("gamma", [0.0, 1e-9, 0.5, 0.95, 1.0, 1.01])
def test_returns_over_many_blocks(spark, gamma, convention):
    r = random.Random(4)
    episodes = {(1, "a"): 300, (1, "b"): 1, (2, "a"): 17, (None, "c"): 8, (3, None): 2}
    rewards = {k: [r.choice([None, r.uniform(-2, 2)]) for _ in range(n)] for k, n in episodes.items()}
    rows = [(*k, 5 + 3 * t if k == (2, "a") else t, 0, 0, x) for k, xs in rewards.items() for t, x in enumerate(xs)]
    e = spark.createDataFrame(rows, "item long, episode_id string, t int, x int, y int, reward double").repartition(5)
    end = spark.createDataFrame([(1, "a", 4.0), (2, "a", None)], "item long, episode_id string, terminal double")
    got = {}
    for x in E.discounted_return(e, gamma, convention, end, block=7, group=4).orderBy("t").collect():
        got.setdefault((x.item, x.episode_id), []).append(x.g)
    for k, xs in rewards.items():
        assert got[k] == pytest.approx(returned([x or 0.0 for x in xs], gamma, convention, 4.0 if k == (1, "a") else 0.0), rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError, match="gamma"):
        E.discounted_return(e, -0.1)


def test_returns_need_no_python_and_no_whole_episode(spark):
    e = spark.range(200_000).select(F.lit(1).alias("item"), F.lit(1).alias("episode_id"), F.col("id").cast("int").alias("t"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("id") % 7).cast("double").alias("reward"))
    g = E.discounted_return(e, 0.999, "standard")
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = returned([float(t % 7) for t in range(200_000)], 0.999, "standard", 0.0)
    got = {x.t: x.g for x in g.filter("t % 9973 = 0 or t > 199990").collect()}
    assert len(got) == 30 and all(got[t] == pytest.approx(want[t], rel=1e-9) for t in got)


def test_backtest_over_many_blocks(spark):
    """Composed maps equal one period after the other, also from outside the range and with states that the policy lacks."""
    r = random.Random(8)
    demand = {1: [r.randrange(6) for _ in range(300)], 2: [3], 3: [r.randrange(4) for _ in range(33)]}
    rows = spark.createDataFrame([(i, k, d) for i, ds in demand.items() for k, d in enumerate(ds, 1)], "item long, seq int, d int").repartition(4)
    params = spark.createDataFrame([(i, 1.0, 9.0, 0.5, 0.5, 0.01, -2, 8) for i in demand], PARAMS)
    acts = {(i, x): x + r.randrange(5) for i in demand for x in (-2, 1, 2, 5, 8)}
    policy = spark.createDataFrame([(*k, y) for k, y in acts.items()], "item long, x int, y int")
    for x0 in (0, -5, 12):
        got = {(g.item, g.seq): (g.x, g.y, g.d, g.x_next, round(g.reward, 9)) for g in E.policy_backtest(rows, params, policy, x0, block=7, group=3).collect()}
        assert len(got) == 334
        for i, ds in demand.items():
            x = x0
            for k, d in enumerate(ds, 1):
                y = acts[i, min((-2, 1, 2, 5, 8), key=lambda z: (abs(z - x), z))]  # noqa: B023
                to = max(-2, min(8, y - d))
                assert got[i, k] == (x, y, d, to, round(-(0.5 * (y - x) + max(0, y - d) + 9 * max(0, d - y)) + 0.0, 9))
                x = to


@pytest.mark.parametrize(("rows_at_once", "cells", "few"), [(1 << 16, 1 << 22, 8), (37, 1 << 22, 2), (11, 60, 0), (5, 1, 8)])
def test_q_learning_in_any_pieces(rows_at_once, cells, few, monkeypatch):
    """Items cut anywhere, stepped together or alone, learn what one update after the other does."""
    r = random.Random(6)
    log = [(i, r.randrange(-2, 4), r.randrange(0, 9), r.random(), r.randrange(-2, 9)) for i, n in enumerate((40, 1, 3, 90, 17, 2, 2, 5, 9, 30, 1, 1)) for _ in range(n)]
    monkeypatch.setattr(Q, "CELLS", cells)
    monkeypatch.setattr(Q, "FEW", few)
    learner, got = Q.Learner(6, 0.1, 0.9, 0.01), {}
    told = []
    for k in range(0, len(log), rows_at_once):
        told += learner.take(*map(np.array, zip(*log[k : k + rows_at_once])))
    for b in [*told, *learner.rest()]:
        for x in b.to_pylist():
            assert (x["item"], x["x"], x["y"]) not in got
            got[x["item"], x["x"], x["y"]] = (x["q"], x["n"])
    want = {}
    for i in range(12):
        q, n = {}, {}
        for row in log:
            if row[0] == i:
                Q.update(q, n, *row[1:], 6, 0.1, 0.9, 0.01)
        want |= {(i, *p): (q[p], n[p]) for p in q}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_late_rows_are_learned_in_the_order_of_their_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(7)
    rows = sorted(map(tuple, transitions(spark).collect()), key=lambda x: (int(x[1][1:]), x[2], x[0]))
    day = 86_400
    timed = [(*x, at, at + r.randrange(day)) for at, x in zip(range(10**6, 10**7, 3600), rows)]  # a row an hour, up to a day late
    end = (-1, "", 0, 0, 0, 0.0, 0, 10**8, 10**8)
    late = (0, "late", 0, 0, 4, 1e6, 0, 10**6, 10**9)  # after the watermark has passed it
    for k, part in enumerate((*(sorted(timed, key=lambda x: x[-1])[at : at + 15] for at in range(0, 90, 15)), [end], [late], [(*end[:-2], 2 * 10**8, 0)])):
        df = spark.createDataFrame(part, TRANSITIONS + ", at long, arrived long").withColumn("ts", F.timestamp_seconds("at")).drop("at", "arrived")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def put(batch, number):
        for x in batch.collect():
            out[x.item, x.x, x.y] = (round(x.q, 9), x.n)

    w = S.stream_late_q_learning(stream, 6, "1 day").writeStream.outputMode("update").foreachBatch(put)
    w.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    # by time: the learner's order is that of rows, as episodes are named in it
    want = {(x.item, x.x, x.y): (round(x.q, 9), x.n) for x in Q.q_learning(transitions(spark), 6).collect()}
    got = {k: v for k, v in out.items() if k[0] >= 0}
    assert got == want
