import pytest
from pyspark.sql import functions as F

from sparkdecide.functions import columns as C
from sparkdecide.operators import compare as M
from sparkdecide.operators import inventory as V
from sparkdecide.plans import bellman as P

PARAMS = "item long, h double, b double, c double, gamma double, theta double, x_min int, x_max int"


@pytest.fixture(scope="module")
def model(spark):
    """The default instance, with a weaker discount so that few sweeps converge, beside one of other costs."""
    params = spark.createDataFrame([(1, 1.0, 9.0, 0.0, 0.5, 1e-3, -2, 8), (2, 1.0, 9.0, 0.4, 0.3, 1e-3, -2, 8)], PARAMS)
    pmf = spark.createDataFrame([(i, d, 0.2) for i in (1, 2) for d in range(5)], "item long, d int, p double")
    return P.Model(params, pmf), pmf


def alone(h, b, c, gamma, theta, sweeps=1000):
    """Value iteration of one item, by plain loops."""
    states, v = range(-2, 9), {x: 0.0 for x in range(-2, 9)}
    for k in range(1, sweeps + 1):
        new, act = {}, {}
        for x in states:
            best = None
            for y in range(x, x + 11):
                cost = sum(0.2 * (h * max(0, y - d) + b * max(0, d - y)) for d in range(5))
                q = -c * (y - x) - cost + gamma * sum(0.2 * v[max(-2, min(8, y - d))] for d in range(5))
                if best is None or q > best + 1e-9:
                    best, act[x] = q, y
            new[x] = best
        delta = max(abs(new[x] - v[x]) for x in states)
        v = new
        if delta < theta:
            break
    return v, act, k


def test_costs(model):
    m, pmf = model
    levels = m.states.select("item", F.col("x").alias("y")).unionByName(m.states.select("item", (F.col("x") + 8).alias("y")))
    cost = {r.y: r.cost for r in V.expected_cost(levels, pmf, m.params).filter("item = 1").collect()}
    assert [round(cost[y], 9) for y in (3, 4, 5, 9)] == [3.0, 2.0, 3.0, 7.0]


def test_value_iteration_stops_each_item_where_it_would_alone(model):
    out, history = P.value_iteration(model[0])
    for item, args in ((1, (1.0, 9.0, 0.0, 0.5, 1e-3)), (2, (1.0, 9.0, 0.4, 0.3, 1e-3))):
        v, act, sweeps = alone(*args)
        got = {r.x: r for r in out.filter(F.col("item") == item).collect()}
        assert {x: round(r.value, 6) for x, r in got.items()} == {x: round(u, 6) for x, u in v.items()}
        assert {x: r.y for x, r in got.items()} == act
        assert {r.sweeps for r in got.values()} == {sweeps}
        assert history.filter(F.col("item") == item).count() == sweeps


def test_golden_values_of_the_default_instance(spark):
    """gamma 0.95: V(x <= 4) after k sweeps is -40 (1 - 0.95^k), the policy is to order up to 4, and it stops at sweep 195."""
    params = spark.createDataFrame([(1, 1.0, 9.0, 0.0, 0.95, 1e-4, -2, 8), (2, 1.0, 9.0, 0.0, 0.95, 1e-4, 0, 3)], PARAMS)
    pmf = spark.createDataFrame([(i, d, 0.2) for i in (1, 2) for d in range(5)], "item long, d int, p double")
    model = P.Model(params, pmf)
    eight = {r.x: r for r in P.value_iteration(model, 8)[0].filter("item = 1").collect()}
    assert abs(eight[0].value + 40 * (1 - 0.95**8)) < 1e-9 and not eight[0].converged
    out, history = P.value_iteration(model)
    got = {r.x: r for r in out.filter("item = 1").collect()}
    assert [got[x].y for x in range(-2, 9)] == [4] * 7 + [5, 6, 7, 8]
    assert [round(got[x].value, 4) for x in (-2, 4, 5, 6, 7, 8)] == [-39.9982, -39.9982, -41.2328, -42.7569, -44.6386, -46.9616]
    assert {(r.sweeps, r.converged) for r in got.values()} == {(195, True)} and history.filter("item = 1").count() == 195
    assert sorted(r.x for r in out.filter("item = 2").collect()) == [0, 1, 2, 3]
    start = model.states.select("item", "x", F.greatest("x", F.lit(4)).alias("y"))
    found = [r for r in P.policy_iteration(model, start).filter("item = 1 and x <= 4").collect()]
    assert {(r.iterations, r.stable, round(r.value, 4)) for r in found} == {(1, True, -39.7632)}
    raised, _ = P.policy_evaluation(model, start, out.select("item", "x", "value"), 3)
    assert raised.filter("item = 1 and sweeps = 1 and converged").count() == 11
    nothing = P.value_iteration(P.Model(params.limit(0), pmf))[0]
    assert nothing.count() == 0


def test_policy_iteration_agrees_with_value_iteration(model, spark):
    m, pmf = model
    start = m.states.select("item", "x", (F.col("x") + 2).alias("y"))
    p = P.policy_iteration(m, start, max_sweeps=40)
    v, _ = P.value_iteration(m)
    assert M.compare_policies(p, v).filter("agree < states").count() == 0
    assert p.filter("not stable").count() == 0
    assert M.value_error(p, v).filter("max_error > 0.01").count() == 0


def test_backup_contracts(model):
    m = model[0]
    a, b = m.zero(), m.states.select("item", "x", (F.col("x") * 1.5).alias("value"))
    before = {r.item: r.delta for r in P.sweep_delta(a, b).collect()}
    after = {r.item: r.delta for r in P.sweep_delta(m.backup(a), m.backup(b)).collect()}
    assert after[1] <= 0.5 * before[1] + 1e-9 and after[2] <= 0.3 * before[2] + 1e-9


def test_rounding_of_the_base_stock_level(spark):
    df = spark.createDataFrame([(1.0, 9.0, 0.0, 0.95, 0, 4), (1.0, 1.0, 0.0, 0.9, 0, 5), (1.0, 1.0, 0.0, 0.9, 0, 3)], "h double, b double, c double, g double, lo int, hi int")
    s = df.select(C.base_stock_level(*(F.col(k) for k in ("h", "b", "c", "g", "lo", "hi"))).alias("s"))
    assert [r.s for r in s.collect()] == [4, 2, 2]  # 3.6, 2.5 and 1.5


def test_nearest_state_of_a_sparse_grid(spark):
    known = spark.createDataFrame([(1, 0), (1, 4)], "item long, x int")
    keys = spark.createDataFrame([(1, 2), (1, 3), (1, -9)], "item long, x int")
    assert {r.x: r.nearest for r in V.nearest_known(keys, known).collect()} == {2: 0, 3: 4, -9: 0}


def test_no_negative_zero(spark):
    v = spark.range(1).select(C.terminal_value(F.lit(0), F.lit(0.0)).alias("v")).first().v
    assert str(v) == "0.0"


def test_method_report_by_hand(spark):
    def rows(*cells):
        return spark.createDataFrame([(7, *c) for c in cells], "item long, x int, y int, value double")

    best = rows((-1, 3, 1.0), (0, 3, 2.0), (1, 4, 3.0))
    other = rows((-1, 2, 1.5), (0, 3, 4.0), (1, 4, 3.0), (9, 9, 9.0))
    level = spark.createDataFrame([(7, 5)], "item long, s int")
    got = {r.method: r for r in M.method_report({"best": best, "other": other}, "best", level).collect()}
    r = got["other"]
    assert (r.states, r.agree, r.max_error, round(r.mean_error, 9), r.s, r.s_formula, r.s_error) == (3, 2, 2.0, round(2.5 / 3, 9), 2, 5, 3)
    assert got["best"].agree == 3 and got["best"].max_error == 0.0 and got["best"].s_error == 2


def test_sparse_and_odd_keys(spark):
    """As-of lookups with null keys, ties, items without known states, and repeated keys with columns of their own."""
    known = spark.createDataFrame([(1, 0), (1, 4), (1, 4), (2, 9), (None, 3), (3, None)], "item long, x int")
    keys = spark.createDataFrame([(1, 2, "tie"), (1, 2, "tie"), (1, -7, "below"), (1, 99, "above"), (1, 4, "same"), (1, None, "null"), (2, 0, "one"), (3, 0, "none"), (None, 3, "no item")], "item long, x int, note string")
    got = sorted((r.note, r.nearest) for r in V.nearest_known(keys, known).collect())
    assert got == sorted([("tie", 0), ("tie", 0), ("below", 0), ("above", 4), ("same", 4), ("null", None), ("one", 9), ("none", None), ("no item", None)], key=lambda x: x[0])
