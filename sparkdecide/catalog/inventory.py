"""Queries over demand and the inventory model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.joins import merged
from ..operators import compare as M
from ..operators import grids as G
from ..operators import inventory as V
from ..operators.regret import strided_rows
from ..plans import bellman as P
from ..storage import table
from . import inputs as I
from .inputs import HISTORY, MODEL, PARAMS, rounded, sweep

#: Sweeps that the chained SQL spells out; every item has converged before.
SWEEPS = 12


def _model(s, d):
    return P.Model(merged(I.params(s, d), I.pmf(s, d).select("item").distinct(), "item"), I.pmf(s, d))


def _whole_model(s, d):
    """The model with the reference's discount and threshold."""
    pmf = I.pmf(s, d)
    return P.Model(merged(I.reference_params(s, d), pmf.select("item").distinct(), "item"), pmf)


def _sweeping(s, d):
    """The model for sweeps alone: they leave out parts without demand by themselves, so demand is read once."""
    return P.Model(I.params(s, d), I.pmf(s, d))


def _swept(s, d, k):
    """The model and values after k sweeps."""
    return _model(s, d), _sweeping(s, d).backup(None, k)


def _levels(s, d):
    ends = I.pmf(s, d).groupBy("item").agg(F.min("d").alias("d_min"), F.max("d").alias("d_max"))
    p = merged(I.params(s, d), ends, "item")
    return p.select("item", C.base_stock_level(F.col("h"), F.col("b"), F.col("c"), F.col("gamma"), F.col("d_min"), F.col("d_max")).alias("s"))


def _costs(s, d):
    rows = merged(I.history(s, d), I.params(s, d), "item").withColumns({"x": F.pmod(F.col("seq") * 3, F.lit(7)), "y": F.pmod(F.col("seq") * 3, F.lit(7)) + F.pmod("seq", F.lit(4))})
    return rows.select(
        "item", "seq", "x", "y",
        (C.period_cost(F.col("y"), F.col("d"), F.col("x"), F.col("h"), F.col("b"), F.col("c")) + F.lit(0.0)).alias("cost"),
        C.next_state(F.col("y"), F.col("d"), F.col("x_min"), F.col("x_max")).alias("x_next"),
        C.nearest_state(F.col("y") * 2, F.col("x_min"), F.col("x_max")).alias("near"), C.terminal_value(F.col("x"), F.col("c")).alias("terminal"),
    )


def _instances(s, d):
    return G.instance_grid(table(s, d, "part").select(F.col("p_partkey").alias("item"), (2 + F.col("p_size") % 15).alias("d_max")))


def _start_policy(s, d):
    return G.initial_policy(I.states(s, d), I.pmf(s, d))


def _four(x):
    return F.greatest(x, F.lit(4))


def _raise_to_four(states):
    return states.select("item", "x", F.greatest("x", F.lit(4)).alias("y"))


def _evaluated(s, d):
    m = _model(s, d)
    return P.policy_evaluation(m, _four, max_sweeps=3, told=False)[0]


def _evaluated_whole(s, d):
    m = _whole_model(s, d)
    return P.policy_evaluation(m, _four, max_sweeps=1000, told=False)[0]


def _iterated(s, d):
    m = _whole_model(s, d)
    return P.policy_iteration(m, _four)


def _solved_instances(s, d):
    """Every part's instance solved; equal instances are solved once, all of them together."""
    parts = _instances(s, d)
    kinds = parts.drop("item").distinct().withColumn("item", F.col("d_max").cast("long"))
    params = kinds.select("item", "x_min", "x_max", *(F.lit(v).alias(k) for k, v in (("h", 1.0), ("b", 9.0), ("c", 0.0), ("gamma", 0.95), ("theta", 1e-4))))
    solved = P.value_iteration(P.Model(params, G.instance_demand(kinds)), told=False)[0]
    return parts.select("item", "d_max").join(solved.withColumnRenamed("item", "d_max"), "d_max")


def _vectors(step: str) -> str:
    """CTEs m (an item's model in lists; level y stands at y + 3) and it: rows of item, k, v, delta of repeated sweeps."""
    return f"""WITH RECURSIVE {PARAMS}, m0 AS (SELECT p.item, any_value(q.h) AS h, any_value(q.b) AS b, any_value(q.c) AS c, list(p.d ORDER BY p.d) AS ds, list(p.p::DOUBLE ORDER BY p.d) AS ps FROM pmf p JOIN params q USING (item) GROUP BY p.item),
m AS (SELECT item, c, ds, ps, list_transform(range(1, 22), lambda j: -c * (j - 3) - list_sum(list_transform(range(1, len(ds) + 1), lambda i: ps[i] * (h * greatest(0, j - 3 - ds[i]) + b * greatest(0, ds[i] - j + 3))))) AS fixed FROM m0),
{step}"""


#: Values of each level from values of the states.
_LEVELS = "list_transform(range(1, 22), lambda j: m.fixed[j] + 0.95 * list_sum(list_transform(range(1, len(m.ds) + 1), lambda i: m.ps[i] * it.v[greatest(1, least(11, j - m.ds[i]))])))"
_DELTA = "list_max(list_transform(range(1, 12), lambda i: abs(nv[i] - v[i])))"
#: Levels that are best in states -2 to 8, the lowest of those within 1e-9.
_BEST = "list_transform(range(1, 12), lambda x: list_position(list_transform({g}[x : x + 10], lambda z: round(z, 9)), list_max(list_transform({g}[x : x + 10], lambda z: round(z, 9)))) + x - 4)"
_OPTIMAL = f"""it AS (SELECT item, 0 AS k, list_transform(range(0, 11), lambda i: 0.0::DOUBLE) AS v, 1e9::DOUBLE AS delta, list_transform(range(0, 11), lambda i: 0::BIGINT) AS y FROM m
  UNION ALL SELECT item, k + 1, nv, {_DELTA}, y FROM (SELECT item, k, v, y, list_transform(range(1, 12), lambda x: c * (x - 3) + g[y[x] + 3]) AS nv
    FROM (SELECT *, {_BEST.format(g="g")} AS y FROM (SELECT it.item, it.k, it.v, m.c, {_LEVELS} AS g FROM it JOIN m USING (item) WHERE it.delta >= 1e-4 AND it.k < 1000)))),
last AS (SELECT item, max(k) AS k, arg_max(v, k) AS v, arg_max(y, k) AS y, arg_max(delta, k) AS delta FROM it GROUP BY item)
SELECT item, CAST(unnest(range(-2, 9)) AS INTEGER) AS x, round(unnest(v), 5) + 0.0 AS value, CAST(unnest(y) AS INTEGER) AS y, CAST(k AS INTEGER) AS sweeps, delta < 1e-4 AS converged FROM last"""
_RAISED = f"""it AS (SELECT item, 0 AS k, list_transform(range(0, 11), lambda i: 0.0::DOUBLE) AS v, 1e9::DOUBLE AS delta FROM m
  UNION ALL SELECT item, k + 1, nv, {_DELTA} FROM (SELECT item, k, v, list_transform(range(1, 12), lambda x: c * (x - 3) + g[greatest(x, 7)]) AS nv
    FROM (SELECT it.item, it.k, it.v, m.c, {_LEVELS} AS g FROM it JOIN m USING (item) WHERE it.delta >= 1e-4 AND it.k < 1000))),
last AS (SELECT item, max(k) AS k, arg_max(v, k) AS v, arg_max(delta, k) AS delta FROM it GROUP BY item)
SELECT item, CAST(unnest(range(-2, 9)) AS INTEGER) AS x, round(unnest(v), 6) + 0.0 AS value, CAST(k AS INTEGER) AS sweeps, delta < 1e-4 AS converged FROM last"""
#: A step is a sweep under the policy; where its change is small, or it is the 100th, the policy is improved.
_ITERATED = f"""it AS (SELECT item, 0 AS k, 1 AS round, 0 AS n, list_transform(range(0, 11), lambda i: 0.0::DOUBLE) AS v, list_transform(range(-2, 9), lambda x: greatest(x, 4)) AS y, false AS stable FROM m
  UNION ALL SELECT item, k + 1, CASE WHEN ends AND better <> y THEN round + 1 ELSE round END, CASE WHEN ends THEN 0 ELSE n + 1 END, nv, CASE WHEN ends THEN better ELSE y END, ends AND better = y
  FROM (SELECT item, k, round, n, nv, y, {_DELTA} < 1e-4 OR n = 99 AS ends, {_BEST.format(g="after")} AS better
    FROM (SELECT z.item, z.k, z.round, z.n, z.v, z.y, z.nv, {_LEVELS.replace("it.v", "z.nv")} AS after
      FROM (SELECT item, k, round, n, v, y, list_transform(range(1, 12), lambda x: c * (x - 3) + g[y[x] + 3]) AS nv
        FROM (SELECT it.item, it.k, it.round, it.n, it.v, it.y, m.c, {_LEVELS} AS g FROM it JOIN m USING (item) WHERE NOT it.stable AND it.round <= 100)) z JOIN m USING (item)))),
last AS (SELECT item, arg_max(v, k) AS v, arg_max(y, k) AS y, arg_max(round, k) AS round, bool_or(stable) AS stable FROM it GROUP BY item)
SELECT item, CAST(unnest(range(-2, 9)) AS INTEGER) AS x, CAST(unnest(y) AS INTEGER) AS y, round(unnest(v), 4) + 0.0 AS value, CAST(round AS INTEGER) AS iterations, stable FROM last"""


def _known_states(s, d):
    """Stock levels that an item has in fact held; far apart for rare items."""
    return I.history(s, d).select("item", (F.col("d") * 3 - 4).alias("x")).distinct()


QUERIES = {
    "s1_demand_pmf": lambda s, d: rounded(I.pmf(s, d), "p"),
    "s3_state_grid": lambda s, d: I.states(s, d),
    "s4_action_grid": lambda s, d: G.action_grid(I.states(s, d)),
    "s5_masked_action_grid": lambda s, d: G.masked_action_grid(I.states(s, d), 6),
    "s7_instance_grid": lambda s, d: _instances(s, d),
    "s7_instance_demand": lambda s, d: rounded(G.instance_demand(_instances(s, d)), "p"),
    "s8_initial_policy": _start_policy,
    "p1_p2_p3_p4_period": lambda s, d: rounded(_costs(s, d), "cost", "terminal"),
    "p3_nearest_known": lambda s, d: V.nearest_known(I.states(s, d), _known_states(s, d)),
    "p5_base_stock_level": _levels,
    "p9_strided_rows": lambda s, d: strided_rows(I.history(s, d).select("item", "seq", "d"), ["item"], "seq", 10),
    "l2_value_lookup": lambda s, d: rounded(V.value_lookup(G.action_grid(I.states(s, d), 4), I.states(s, d).select("item", "x", (F.col("x") * F.col("x") * 0.5).alias("value")), "y"), "value"),
    "l3_policy_lookup": lambda s, d: V.policy_lookup(_costs(s, d).select("item", "seq", F.col("x_next").alias("x")), _start_policy(s, d)),
    "l4_demand_cross": lambda s, d: rounded(V.demand_cross(I.states(s, d).select("item", F.col("x").alias("y")), I.pmf(s, d)), "p"),
    "a6_expected_cost": lambda s, d: rounded(V.expected_cost(I.states(s, d).select("item", F.col("x").alias("y")), I.pmf(s, d), I.params(s, d)), "cost"),
    "a7_expected_next_value": lambda s, d: rounded(V.expected_next_value(V.transitions(I.states(s, d).select("item", F.col("x").alias("y")), I.pmf(s, d), I.params(s, d)), I.states(s, d).select("item", "x", (F.col("x") * F.col("x") * 0.5).alias("value"))), "ev"),
    "a12_sweep_delta": lambda s, d: rounded(P.last_changes(_sweeping(s, d), None, 2).select("item", "delta"), "delta"),
    "a13_policy_changes": lambda s, d: P.last_changes(_sweeping(s, d), None, 2).drop("delta"),
    "a14_value_range": lambda s, d: rounded(P.value_range(_swept(s, d, 2)[1]), "low", "high"),
    "w8_sliding_best": lambda s, d: rounded(V.sliding_best_action(V.expected_cost(I.states(s, d).select("item", F.col("x").alias("y")), I.pmf(s, d), I.params(s, d)).select("item", "y", F.col("cost").alias("g")), 3), "best"),
    "m1_q_values": lambda s, d: (lambda m, v: rounded(m.q_values(v), "q"))(*_swept(s, d, 1)),
    "m2_bellman_backup": lambda s, d: rounded(_swept(s, d, 3)[1], "value"),
    "m3_value_iteration": lambda s, d: rounded(P.value_iteration(_whole_model(s, d), told=False)[0], "value", places=5),
    "e3_instance_sweep": lambda s, d: rounded(_solved_instances(s, d), "value", places=5),
    "m3_twelve_sweeps": lambda s, d: rounded(P.value_iteration(_model(s, d), SWEEPS, told=False)[0], "value", places=5),
    "m4_policy_evaluation": lambda s, d: rounded(_evaluated_whole(s, d), "value"),
    "m4_three_sweeps": lambda s, d: rounded(_evaluated(s, d), "value"),
    "m5_policy_improvement": lambda s, d: (lambda m, v: P.policy_improvement(m, v, _raise_to_four(m.states))[0])(*_swept(s, d, 2)),
    "m6_policy_iteration": lambda s, d: rounded(_iterated(s, d), "value", places=4),
    "c1_compare_policies": lambda s, d: rounded(M.compare_policies(_start_policy(s, d), _swept(s, d, 2)[1]), "pct_agree"),
    "c2_value_error": lambda s, d: rounded(_sweeping(s, d).backups(None, 3).select("item", *M.state_gaps(F.col("before"), F.col("last"))[3:]), "max_error", "mean_error"),
    "c3_base_stock_report": lambda s, d: M.base_stock_report(M.method_union({"start": _start_policy(s, d), "swept": _swept(s, d, 3)[1].select("item", "x", "y")}), _levels(s, d)),
    "c4_convergence_report": lambda s, d: rounded(M.convergence_report(P.value_iteration(_model(s, d), SWEEPS)[1].withColumn("method", F.lit("vi"))), "last_delta", places=5),
    "t3_method_union": lambda s, d: M.method_union({"start": _start_policy(s, d), "four": _raise_to_four(I.states(s, d))}),
}

_PER = """, costs AS (SELECT h.item, h.seq, (h.seq * 3) % 7 AS x, (h.seq * 3) % 7 + h.seq % 4 AS y, h.d, p.h AS hh, p.b, p.c, p.x_min, p.x_max FROM history h JOIN params p USING (item))"""
_ENDS = """, ends AS (SELECT item, min(d) AS d_min, max(d) AS d_max FROM pmf GROUP BY item),
levels AS (SELECT item, CAST(round_even(d_min + (d_max - d_min) * ((b - (1.0 - gamma) * c) / (b + h)), 0) AS INTEGER) AS s FROM params JOIN ends USING (item)),
start AS (SELECT s.item, s.x, greatest(s.x, e.d_max) AS y FROM states s JOIN ends e USING (item))"""
_INST = """inst AS (SELECT p_partkey AS item, CAST(2 + p_size % 15 AS INTEGER) AS d_max, CAST(-greatest(2, (2 + p_size % 15) // 2) AS INTEGER) AS x_min, CAST(2 * (2 + p_size % 15) AS INTEGER) AS x_max FROM part)"""
_ALL = "".join(sweep(k) for k in range(1, SWEEPS + 1))
_CONV = ", ".join(f"dl{k} AS MATERIALIZED (SELECT a.item, {k} AS sweep, max(abs(a.value - b.value)) AS delta FROM v{k} a JOIN v{k - 1} b USING (item, x) GROUP BY a.item)" for k in range(1, SWEEPS + 1))
_STOP = f", {_CONV}, deltas AS ({' UNION ALL '.join(f'SELECT * FROM dl{k}' for k in range(1, SWEEPS + 1))}), stops AS (SELECT item, coalesce(min(sweep) FILTER (delta < 0.01), {SWEEPS}) AS sweeps, count(*) FILTER (delta < 0.01) > 0 AS converged FROM deltas GROUP BY item)"
_V = " UNION ALL ".join(f"SELECT item, x, value, y, {k} AS sweep FROM v{k}" for k in range(1, SWEEPS + 1))
_HALF = ", half AS (SELECT item, x, x * x * 0.5::DOUBLE AS value FROM states)"


def _evaluation() -> str:
    sql = ", e0 AS (SELECT * FROM v0), four AS (SELECT s.item, s.x, greatest(s.x, 4) AS y FROM states s)"
    for k in range(1, 4):
        sql += f""", e{k} AS MATERIALIZED (SELECT f.item, f.x, pr.c * f.x - pr.c * f.y - c.cost + pr.gamma * ev.ev AS value FROM four f JOIN params pr USING (item) JOIN cost c ON c.item = f.item AND c.y = f.y
  JOIN (SELECT m.item, m.y, sum(m.p * v.value) AS ev FROM moves m JOIN e{k - 1} v ON v.item = m.item AND v.x = m.x_next GROUP BY m.item, m.y) ev ON ev.item = f.item AND ev.y = f.y),
ed{k} AS (SELECT a.item, max(abs(a.value - b.value)) AS delta FROM e{k} a JOIN e{k - 1} b USING (item, x) GROUP BY a.item)"""
    return sql


#: Lists of an instance: level j is y = x_min + j - 1, and n states; demand is uniform, costs are 1 and 9.
_SWEPT_LEVELS = "list_transform(range(1, n + 11), lambda j: fixed[j] + 0.95 * list_sum(list_transform(range(0, d_max + 1), lambda e: v[greatest(1, least(n, j - e))])) / (d_max + 1))"
_SWEPT_BEST = "list_transform(range(1, n + 1), lambda i: list_position(list_transform(g[i : i + 10], lambda z: round(z, 9)), list_max(list_transform(g[i : i + 10], lambda z: round(z, 9)))) + i - 1)"
_INSTANCES = f"""WITH RECURSIVE {_INST}, kinds AS (SELECT DISTINCT d_max, x_min, x_max - x_min + 1 AS n FROM inst),
m AS (SELECT *, list_transform(range(1, n + 11), lambda j: -list_sum(list_transform(range(0, d_max + 1), lambda e: 1.0::DOUBLE * greatest(0, x_min + j - 1 - e) + 9.0::DOUBLE * greatest(0, e - x_min - j + 1))) / (d_max + 1)) AS fixed FROM kinds),
it AS (SELECT d_max, x_min, n, fixed, 0 AS k, list_transform(range(0, n), lambda i: 0.0::DOUBLE) AS v, list_transform(range(0, n), lambda i: 0::BIGINT) AS pick, 1e9::DOUBLE AS delta FROM m
  UNION ALL SELECT d_max, x_min, n, fixed, k + 1, nv, pick, list_max(list_transform(range(1, n + 1), lambda i: abs(nv[i] - v[i])))
  FROM (SELECT d_max, x_min, n, fixed, k, v, pick, list_transform(pick, lambda a: g[a]) AS nv
    FROM (SELECT *, {_SWEPT_BEST} AS pick FROM (SELECT * EXCLUDE (pick), {_SWEPT_LEVELS} AS g FROM it WHERE delta >= 1e-4 AND k < 1000)))),
last AS (SELECT d_max, x_min, n, max(k) AS k, arg_max(v, k) AS v, arg_max(pick, k) AS pick, arg_max(delta, k) AS delta FROM it GROUP BY d_max, x_min, n),
solved AS (SELECT d_max, CAST(unnest(range(x_min, x_min + n)) AS INTEGER) AS x, round(unnest(v), 5) + 0.0 AS value, CAST(x_min - 1 + unnest(pick) AS INTEGER) AS y, CAST(k AS INTEGER) AS sweeps, delta < 1e-4 AS converged FROM last)
SELECT i.item, s.* FROM inst i JOIN solved s USING (d_max)"""

ORACLES = {
    "e3_instance_sweep": _INSTANCES,
    "m3_value_iteration": _vectors(_OPTIMAL),
    "m4_policy_evaluation": _vectors(_RAISED),
    "m6_policy_iteration": _vectors(_ITERATED),
    "s1_demand_pmf": f"WITH {PARAMS} SELECT item, d, round(p, 6) + 0.0 AS p FROM pmf",
    "s3_state_grid": f"WITH {PARAMS} SELECT item, x FROM states",
    "s4_action_grid": f"WITH {PARAMS} SELECT item, x, CAST(unnest(range(x, x + 11)) AS INTEGER) AS y FROM states",
    "s5_masked_action_grid": f"WITH {PARAMS} SELECT item, x, CAST(unnest(range(x, 7)) AS INTEGER) AS y FROM states WHERE x <= 6",
    "s7_instance_grid": f"WITH {_INST} SELECT *, x_max + 2 AS y_max, x_max - x_min + 1 AS n_states, x_max + 2 - x_min + 1 AS n_actions FROM inst",
    "s7_instance_demand": f"WITH {_INST} SELECT item, CAST(unnest(range(0, d_max + 1)) AS INTEGER) AS d, round(1.0::DOUBLE / (d_max + 1), 6) + 0.0 AS p FROM inst",
    "s8_initial_policy": f"WITH {PARAMS}{_ENDS} SELECT * FROM start",
    "p1_p2_p3_p4_period": f"WITH {PARAMS}{HISTORY}{_PER} SELECT item, seq, x, y, round(c * (y - x) + hh * greatest(0, y - d) + b * greatest(0, d - y), 6) + 0.0 AS cost, greatest(x_min, least(x_max, y - d)) AS x_next, greatest(x_min, least(x_max, y * 2)) AS near, round(-c * greatest(x, 0), 6) + 0.0 AS terminal FROM costs",
    "p3_nearest_known": f"WITH {PARAMS}{HISTORY}, known AS (SELECT DISTINCT item, d * 3 - 4 AS k FROM history) SELECT s.item, s.x, k.k AS nearest FROM states s LEFT JOIN known k ON k.item = s.item QUALIFY row_number() OVER (PARTITION BY s.item, s.x ORDER BY abs(s.x - k.k), k.k) = 1",
    "p5_base_stock_level": f"WITH {PARAMS}{_ENDS} SELECT item, s FROM levels",
    "p9_strided_rows": f"WITH {PARAMS}{HISTORY} SELECT item, seq, d FROM history QUALIFY (row_number() OVER (PARTITION BY item ORDER BY seq) - 1) % greatest(1, count(*) OVER (PARTITION BY item) // 10) = 0",
    "l2_value_lookup": f"WITH {PARAMS}{_HALF}, a AS (SELECT item, x, CAST(unnest(range(x, x + 5)) AS INTEGER) AS y FROM states) SELECT a.item, a.x, a.y, round(h.value, 6) + 0.0 AS value FROM a JOIN half h ON h.item = a.item AND h.x = greatest(-2, least(8, a.y))",
    "l3_policy_lookup": f"WITH {PARAMS}{HISTORY}{_PER}{_ENDS}, n AS (SELECT item, seq, greatest(x_min, least(x_max, y - d)) AS x FROM costs) SELECT n.item, n.seq, n.x, s.y FROM n LEFT JOIN start s USING (item, x)",
    "l4_demand_cross": f"WITH {PARAMS} SELECT s.item, s.x AS y, d, round(p, 6) + 0.0 AS p FROM states s JOIN pmf USING (item)",
    "a6_expected_cost": f"WITH {PARAMS} SELECT s.item, s.x AS y, round(sum(p * (h * greatest(0, s.x - d) + b * greatest(0, d - s.x))), 6) + 0.0 AS cost FROM states s JOIN pmf USING (item) JOIN params USING (item) GROUP BY s.item, s.x",
    "a7_expected_next_value": f"WITH {PARAMS}{_HALF} SELECT s.item, s.x AS y, round(sum(p * v.value), 6) + 0.0 AS ev FROM states s JOIN pmf USING (item) JOIN half v ON v.item = s.item AND v.x = greatest(-2, least(8, s.x - d)) GROUP BY s.item, s.x",
    "a12_sweep_delta": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)} SELECT a.item, round(max(abs(a.value - b.value)), 6) + 0.0 AS delta FROM v2 a JOIN v1 b USING (item, x) GROUP BY a.item",
    "a13_policy_changes": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)} SELECT a.item, CAST(sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) AS BIGINT) AS changed, sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) = 0 AS stable FROM v2 a JOIN v1 b USING (item, x) GROUP BY a.item",
    "a14_value_range": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)} SELECT item, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM v2 GROUP BY item",
    "w8_sliding_best": f"WITH {PARAMS}, g AS (SELECT s.item, s.x AS y, sum(p * (h * greatest(0, s.x - d) + b * greatest(0, d - s.x))) AS g FROM states s JOIN pmf USING (item) JOIN params USING (item) GROUP BY s.item, s.x) SELECT a.item, a.y, round(b.g, 6) + 0.0 AS best, b.y AS arg FROM g a JOIN g b ON a.item = b.item AND b.y BETWEEN a.y AND a.y + 3 QUALIFY row_number() OVER (PARTITION BY a.item, a.y ORDER BY round(b.g, 9) DESC, b.y) = 1",
    "m1_q_values": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)} SELECT s.item, s.x, g.y, round(g.c * s.x + g.g, 6) + 0.0 AS q FROM states s JOIN g2 g ON g.item = s.item AND g.y BETWEEN s.x AND s.x + 10",
    "m2_bellman_backup": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)}{sweep(3)} SELECT item, x, round(value, 6) + 0.0 AS value, y FROM v3",
    "m3_twelve_sweeps": _vectors(_OPTIMAL.replace("k < 1000", f"k < {SWEEPS}").replace("1e-4", "0.01").replace("0.95 *", "0.4712393331::DOUBLE *")),
    "m4_three_sweeps": f"WITH {PARAMS}{MODEL}{_evaluation()} SELECT e.item, e.x, round(e.value, 6) + 0.0 AS value, k AS sweeps, k < 3 OR (SELECT delta FROM ed3 WHERE ed3.item = e.item) < 0.01 AS converged FROM (SELECT *, 1 AS k FROM e1 UNION ALL SELECT *, 2 FROM e2 UNION ALL SELECT *, 3 FROM e3) e JOIN (SELECT a.item, CASE WHEN a.delta < 0.01 THEN 1 WHEN b.delta < 0.01 THEN 2 ELSE 3 END AS stop FROM ed1 a JOIN ed2 b USING (item)) s ON s.item = e.item AND s.stop = e.k",
    "m5_policy_improvement": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)}{sweep(3)} SELECT item, x, y FROM v3",
    "c1_compare_policies": f"WITH {PARAMS}{MODEL}{_ENDS}{sweep(1)}{sweep(2)} SELECT a.item, count(*) AS states, CAST(sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS BIGINT) AS agree, round(100.0::DOUBLE * sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) / count(*), 6) + 0.0 AS pct_agree FROM start a JOIN v2 b USING (item, x) GROUP BY a.item",
    "c2_value_error": f"WITH {PARAMS}{MODEL}{sweep(1)}{sweep(2)}{sweep(3)} SELECT a.item, round(max(abs(a.value - b.value)), 6) + 0.0 AS max_error, round(avg(abs(a.value - b.value)), 6) + 0.0 AS mean_error FROM v2 a JOIN v3 b USING (item, x) GROUP BY a.item",
    "c3_base_stock_report": f"WITH {PARAMS}{MODEL}{_ENDS}{sweep(1)}{sweep(2)}{sweep(3)}, u AS (SELECT 'start' AS method, item, x, y FROM start UNION ALL SELECT 'swept', item, x, y FROM v3) SELECT u.method, u.item, arg_min(u.y, u.x) AS s, any_value(l.s) AS s_formula, abs(arg_min(u.y, u.x) - any_value(l.s)) AS error FROM u JOIN levels l USING (item) GROUP BY u.method, u.item",
    "c4_convergence_report": f"WITH {PARAMS}{MODEL}{_ALL}{_STOP} SELECT 'vi' AS method, s.item, s.sweeps, round(d.delta, 5) + 0.0 AS last_delta FROM stops s JOIN deltas d ON d.item = s.item AND d.sweep = s.sweeps",
    "t3_method_union": f"WITH {PARAMS}{_ENDS} SELECT item, x, y, 'start' AS method FROM start UNION ALL SELECT item, x, greatest(x, 4), 'four' FROM states",
}
