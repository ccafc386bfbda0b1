"""Queries over logs of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bandit as B
from ..operators import regret as R
from ..operators.grids import arm_grid
from ..storage import table
from . import inputs as I
from .inputs import ARMS, LOG, PROBS, RUNS, rounded


def _metrics(s, d):
    return R.cumulative_metrics(R.attach_truth(I.run_log(s, d), I.arm_probs(s, d)))


def _summary(s, d):
    return R.run_summary(_metrics(s, d))


_SUMMARY = ("mean_cum_regret", "std_cum_regret", "mean_regret", "mean_cum_reward", "pct_optimal")
_SUMMARY_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _SUMMARY)


def _requests(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 2).alias("context"))


_FRAME = """, framed AS (SELECT l.step, l.{key}, a.arm, l.arm AS chosen, CASE WHEN a.arm = l.arm THEN 1 ELSE 0 END AS hit, l.reward FROM log l CROSS JOIN (SELECT DISTINCT arm FROM log) a),
before AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS n, coalesce(sum(hit * reward) OVER w, 0) AS s, count(*) OVER w + 1 AS t FROM framed
  WINDOW w AS (PARTITION BY {key}, arm ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
running AS (SELECT step, {key}, arm, chosen, n, CASE WHEN n > 0 THEN s / n ELSE 0.0 END AS q, t, 1.0 + s AS alpha, 1.0 + n - s AS beta FROM before),
scored AS (SELECT *, CASE WHEN n = 0 THEN CAST('inf' AS DOUBLE) ELSE round(q + 2.0 * sqrt(ln(t) / n), 9) END AS score FROM running)"""


def _unit(key: str, seed: int) -> str:
    return f"((({key} % 1000003) * {48271 + 2 * seed} + {11 + seed}) % 2147483647 * 69621 % 2147483647) / 2147483647.0::DOUBLE"


def _mixing(name: str, source: str, x: str) -> str:
    """CTEs that mix a number x of each row of ``source`` into h, one step a CTE."""
    return f""", {name}a AS (SELECT *, (xor(z, z >> 16) * {C.MIX_A}) & {C.WORD} AS z1 FROM (SELECT * EXCLUDE (h), {x} AS z FROM {source})),
{name}b AS (SELECT * EXCLUDE (z, z1), (xor(z1, z1 >> 15) * {C.MIX_B}) & {C.WORD} AS z2 FROM {name}a),
{name} AS (SELECT * EXCLUDE (z2), xor(z2, z2 >> 15) AS h FROM {name}b)"""


def _thompson_sql(seed: int) -> str:
    """Draws by the same counters. A proposal is a row; an arm's draw is its first accepted one."""
    posts = "posts AS (SELECT g.context, g.arm, 1.0::DOUBLE + coalesce(sum(reward), 0) AS alpha, 1.0::DOUBLE + coalesce(sum(1 - reward), 0) AS beta FROM grid g LEFT JOIN log l USING (context, arm) GROUP BY g.context, g.arm)"
    rows = "pairs AS (SELECT event_id AS request_id, 0 AS h, p.* FROM events JOIN posts p ON p.context = user_id % 2)"
    keyed = _mixing("k1", "pairs", f"xor(arm & {C.WORD}, {seed * C.STEP & C.WORD})")
    keyed += _mixing("k2", "k1", f"xor(h, request_id & {C.WORD})") + _mixing("k3", "k2", "xor(h, request_id >> 32)")
    proposals = f""", tries AS (SELECT request_id, context, arm, side, k, CASE side WHEN 0 THEN alpha ELSE beta END - 1.0::DOUBLE / 3.0 AS d, i, h AS own, 0 AS h FROM k3, range(0, 2) s(side), range(0, {C.PROPOSALS}) r(k), range(0, 3) n(i))"""
    uniform = _mixing("u", "tries", f"xor(own, ((side * {3 * C.PROPOSALS} + k * 3 + i) * {C.STEP}) & {C.WORD})")
    return f"""WITH {LOG}{ARMS}, {posts}, {rows}{keyed}{proposals}{uniform},
us AS (SELECT request_id, context, arm, side, k, d, max((h + 0.5) / 4294967296.0::DOUBLE) FILTER (i = 0) AS u, max((h + 0.5) / 4294967296.0::DOUBLE) FILTER (i = 1) AS w, max((h + 0.5) / 4294967296.0::DOUBLE) FILTER (i = 2) AS a FROM u GROUP BY ALL),
zs AS (SELECT *, sqrt(-2.0::DOUBLE * ln(u)) * cos(2.0::DOUBLE * pi() * w) AS z FROM us),
vs AS (SELECT *, (1.0 + z / sqrt(9.0 * d)) * (1.0 + z / sqrt(9.0 * d)) * (1.0 + z / sqrt(9.0 * d)) AS v FROM zs),
draws AS (SELECT request_id, context, arm, side, coalesce(first(d * v ORDER BY k) FILTER (v > 0 AND ln(a) < 0.5 * z * z + d * (1.0 - v + ln(CASE WHEN v > 0 THEN v ELSE 1 END))), any_value(d)) AS g FROM vs GROUP BY ALL),
scores AS (SELECT request_id, context, arm, max(g) FILTER (side = 0) / (max(g) FILTER (side = 0) + max(g) FILTER (side = 1)) AS score FROM draws GROUP BY ALL)
SELECT request_id, context, arm FROM scores QUALIFY row_number() OVER (PARTITION BY request_id, context ORDER BY score DESC, arm) = 1"""


QUERIES = {
    "s2_decision_log": lambda s, d: I.log(s, d).select("step", "context", "arm", "reward", "alg", "run"),
    "s6_arm_grid": lambda s, d: arm_grid(I.log(s, d)),
    "a1_arm_stats": lambda s, d: rounded(B.arm_stats(I.log(s, d)), "q"),
    "a2_arm_stats_blind": lambda s, d: rounded(B.arm_stats_blind(I.log(s, d)), "q"),
    "a3_beta_posterior": lambda s, d: rounded(B.beta_posterior(I.log(s, d)), "mean"),
    "a4_best_arm": lambda s, d: rounded(B.best_arm(I.arm_probs(s, d)), "best_prob"),
    "t1_greedy_pick": lambda s, d: B.greedy_pick(B.arm_stats(I.log(s, d), ["run"]).withColumn("score", F.round("q", 9)), ["run"]),
    "l1_attach_truth": lambda s, d: rounded(R.attach_truth(I.log(s, d), I.arm_probs(s, d)).select("step", "arm", "prob", "best", "best_prob"), "prob", "best_prob"),
    "p6_is_optimal": lambda s, d: R.attach_truth(I.log(s, d), I.arm_probs(s, d)).select("step", "optimal"),
    "p8_instant_regret": lambda s, d: rounded(R.attach_truth(I.log(s, d), I.arm_probs(s, d)).select("step", "regret"), "regret"),
    "b1_epsilon_greedy": lambda s, d: B.epsilon_greedy_assign(_requests(s, d), B.arm_stats(I.log(s, d)), 0.1, 5),
    "b2_ucb_scores": lambda s, d: rounded(B.ucb_scores(B.arm_stats(I.log(s, d))), "q", "score"),
    "b3_ucb_scores_blind": lambda s, d: rounded(B.ucb_scores_blind(B.arm_stats_blind(I.log(s, d))), "q", "score"),
    "b4_thompson_assign": lambda s, d: B.thompson_assign(_requests(s, d), B.beta_posterior(I.log(s, d)), 5),
    "b5_policy_audit": lambda s, d: B.policy_audit(I.log(s, d)),
    "u2_custom_audit": lambda s, d: B.policy_audit(I.log(s, d), score=lambda n, q, t: (q * n + 1) / (n + 2) + F.sqrt(F.ln(t + 1.0)) / (n + 1)).select("step", "context", "chosen", "custom", "agrees_custom"),
    "b5_blind_audit": lambda s, d: B.blind_audit(I.log(s, d), "run"),
    "b6_regret_report": lambda s, d: rounded(R.regret_report(I.run_log(s, d), I.arm_probs(s, d)), *_SUMMARY),
    "b7_uncertainty_band": lambda s, d: rounded(R.uncertainty_band(_summary(s, d)), "low", "high"),
    "w1_cumulative_metrics": lambda s, d: rounded(_metrics(s, d).select("run", "step", "cum_regret", "cum_reward"), "cum_regret"),
    "w2_forward_smooth": lambda s, d: rounded(R.forward_smooth(_summary(s, d), "mean_regret", ["alg"], width=50).select("alg", "step", "smooth"), "smooth"),
    "w3_trailing_smooth": lambda s, d: rounded(R.trailing_smooth(_summary(s, d), "mean_regret", ["alg"]).select("alg", "step", "smooth"), "smooth"),
    "w4_recent_mean": lambda s, d: rounded(R.recent_mean(_metrics(s, d), "reward", ["run"], back=20).select("run", "step", "recent"), "recent"),
    "w5_running_arm_stats": lambda s, d: rounded(B.running_arm_stats(I.log(s, d)), "q"),
    "a5_run_summary": lambda s, d: rounded(_summary(s, d), *_SUMMARY),
    "t2_final_step": lambda s, d: rounded(R.final_step(_summary(s, d)), *_SUMMARY),
    "u2_custom_score": lambda s, d: rounded(B.custom_scores(B.arm_stats(I.log(s, d)), lambda n, q, t: q + 1 / F.sqrt(n + 1) + t * 0), "q", "score"),
}

ORACLES = {
    "s2_decision_log": f"WITH {LOG} SELECT step, context, arm, reward, alg, run FROM log",
    "s6_arm_grid": f"WITH {LOG}{ARMS} SELECT context, arm, 0::BIGINT AS n, 0.0::DOUBLE AS q FROM grid",
    "a1_arm_stats": f"WITH {LOG}{ARMS} SELECT context, arm, n, round(q, 6) + 0.0 AS q FROM stats",
    "a2_arm_stats_blind": f"WITH {LOG} SELECT arm, count(*) AS n, round(avg(reward), 6) + 0.0 AS q FROM log GROUP BY arm",
    "a3_beta_posterior": f"WITH {LOG}{ARMS} SELECT g.context, g.arm, 1.0::DOUBLE + coalesce(sum(reward), 0) AS alpha, 1.0::DOUBLE + coalesce(sum(1 - reward), 0) AS beta, round((1.0 + coalesce(sum(reward), 0)) / (2.0::DOUBLE + count(reward)), 6) + 0.0 AS mean FROM grid g LEFT JOIN log l USING (context, arm) GROUP BY g.context, g.arm",
    "a4_best_arm": f"WITH {LOG}{PROBS} SELECT context, best, round(best_prob, 6) + 0.0 AS best_prob FROM best",
    "t1_greedy_pick": f"WITH {LOG}, s AS (SELECT c.run, a.arm, round(coalesce(avg(l.reward), 0.0), 9) AS q FROM (SELECT DISTINCT run FROM log) c CROSS JOIN (SELECT DISTINCT arm FROM log) a LEFT JOIN log l ON l.run = c.run AND l.arm = a.arm GROUP BY ALL) SELECT run, arm FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY q DESC, arm) = 1",
    "l1_attach_truth": f"WITH {LOG}{PROBS} SELECT l.step, l.arm, round(p.prob, 6) + 0.0 AS prob, b.best, round(b.best_prob, 6) + 0.0 AS best_prob FROM log l JOIN probs p USING (context, arm) JOIN best b USING (context)",
    "p6_is_optimal": f"WITH {LOG}{PROBS} SELECT l.step, CASE WHEN l.arm = b.best THEN 1 ELSE 0 END AS optimal FROM log l JOIN best b USING (context)",
    "p8_instant_regret": f"WITH {LOG}{PROBS} SELECT l.step, round(b.best_prob - p.prob, 6) + 0.0 AS regret FROM log l JOIN probs p USING (context, arm) JOIN best b USING (context)",
    "b1_epsilon_greedy": f"WITH {LOG}{ARMS}, greedy AS (SELECT context, arm FROM stats QUALIFY row_number() OVER (PARTITION BY context ORDER BY q DESC, arm) = 1), arms AS (SELECT context, list(arm ORDER BY arm) AS arms FROM stats GROUP BY context), r AS (SELECT event_id AS request_id, user_id % 2 AS context, {_unit('event_id', 5)} AS u, {_unit('event_id', 12)} AS v FROM events) SELECT request_id, r.context, CASE WHEN u < 0.1 THEN arms[CAST(floor(v * len(arms)) AS INTEGER) + 1] ELSE g.arm END AS arm, CASE WHEN u < 0.1 THEN 1 ELSE 0 END AS explored FROM r JOIN greedy g USING (context) JOIN arms USING (context)",
    "b4_thompson_assign": _thompson_sql(5),
    "b2_ucb_scores": f"WITH {LOG}{ARMS} SELECT context, arm, n, round(q, 6) + 0.0 AS q, round(CASE WHEN n = 0 THEN CAST('inf' AS DOUBLE) ELSE q + 2.0 * sqrt(ln(sum(n) OVER (PARTITION BY context) + 1) / n) END, 6) + 0.0 AS score FROM stats",
    "b3_ucb_scores_blind": f"WITH {LOG}, s AS (SELECT arm, count(*) AS n, avg(reward) AS q FROM log GROUP BY arm) SELECT arm, n, round(q, 6) + 0.0 AS q, round(q + 2.0 * sqrt(ln(sum(n) OVER () + 1) / n), 6) + 0.0 AS score FROM s",
    "b5_policy_audit": f"WITH {LOG}{_FRAME.format(key='context')}, p AS (SELECT step, context, chosen, first(arm ORDER BY round(q, 9) DESC, arm) AS greedy, first(arm ORDER BY score DESC, arm) AS ucb FROM scored GROUP BY step, context, chosen) SELECT *, CASE WHEN chosen = greedy THEN 1 ELSE 0 END AS agrees_greedy, CASE WHEN chosen = ucb THEN 1 ELSE 0 END AS agrees_ucb FROM p",
    "u2_custom_audit": f"WITH {LOG}{_FRAME.format(key='context')}, p AS (SELECT step, context, chosen, first(arm ORDER BY round((q * n + 1) / (n + 2) + sqrt(ln(t + 1.0::DOUBLE)) / (n + 1), 9) DESC, arm) AS custom FROM running GROUP BY step, context, chosen) SELECT *, CASE WHEN chosen = custom THEN 1 ELSE 0 END AS agrees_custom FROM p",
    "b5_blind_audit": f"WITH {LOG}{_FRAME.format(key='run')}, p AS (SELECT step, run, chosen, first(arm ORDER BY score DESC, arm) AS blind FROM scored GROUP BY step, run, chosen) SELECT *, CASE WHEN chosen = blind THEN 1 ELSE 0 END AS agrees_blind FROM p",
    "b6_regret_report": f"WITH {LOG}{PROBS}{RUNS} SELECT alg, step, n_runs, {_SUMMARY_SQL} FROM summary QUALIFY row_number() OVER (PARTITION BY alg ORDER BY step DESC) = 1",
    "b7_uncertainty_band": f"WITH {LOG}{PROBS}{RUNS} SELECT alg, step, round(mean_cum_regret - std_cum_regret, 6) + 0.0 AS low, round(mean_cum_regret + std_cum_regret, 6) + 0.0 AS high FROM summary",
    "w1_cumulative_metrics": f"WITH {LOG}{PROBS}{RUNS} SELECT run, step, round(cum_regret, 6) + 0.0 AS cum_regret, CAST(cum_reward AS BIGINT) AS cum_reward FROM metrics",
    "w2_forward_smooth": f"WITH {LOG}{PROBS}{RUNS}, s AS (SELECT alg, step, avg(mean_regret) OVER w AS smooth, count(*) OVER w AS n FROM summary WINDOW w AS (PARTITION BY alg ORDER BY step ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) SELECT alg, step, round(smooth, 6) + 0.0 AS smooth FROM s WHERE n = 50",
    "w3_trailing_smooth": f"WITH {LOG}{PROBS}{RUNS}, s AS (SELECT alg, step, mean_regret, row_number() OVER (PARTITION BY alg ORDER BY step) AS i, greatest(1, least(1000, count(*) OVER (PARTITION BY alg) // 10)) AS w FROM summary) SELECT a.alg, a.step, round(avg(b.mean_regret), 6) + 0.0 AS smooth FROM s a JOIN s b ON a.alg = b.alg AND b.i BETWEEN a.i - a.w + 1 AND a.i GROUP BY a.alg, a.step",
    "w4_recent_mean": f"WITH {LOG}{PROBS}{RUNS}, s AS (SELECT run, step, avg(reward) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS recent, row_number() OVER (PARTITION BY run ORDER BY step) AS i, count(*) OVER (PARTITION BY run) AS n FROM metrics) SELECT run, step, round(recent, 6) + 0.0 AS recent FROM s WHERE i % greatest(1, n // 5) = 0",
    "w5_running_arm_stats": f"WITH {LOG}{_FRAME.format(key='context')} SELECT step, context, arm, chosen, CAST(n AS BIGINT) AS n, round(q, 6) + 0.0 AS q, t, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta FROM running",
    "a5_run_summary": f"WITH {LOG}{PROBS}{RUNS} SELECT alg, step, n_runs, {_SUMMARY_SQL} FROM summary",
    "t2_final_step": f"WITH {LOG}{PROBS}{RUNS} SELECT alg, step, n_runs, {_SUMMARY_SQL} FROM summary QUALIFY row_number() OVER (PARTITION BY alg ORDER BY step DESC) = 1",
    "u2_custom_score": f"WITH {LOG}{ARMS} SELECT context, arm, n, round(q, 6) + 0.0 AS q, round(q + 1 / sqrt(n + 1), 6) + 0.0 AS score FROM stats",
}
