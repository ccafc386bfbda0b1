"""The logical inputs of the queries, from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grids import state_grid
from ..sources.tables import decision_log, demand_history, demand_pmf
from ..storage import table


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums differ in their last digits with the order of rows; no negative zeros."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions from events: context and arm from user and props; a click is a reward. Each user is a run of one of three algorithms."""
    e = table(spark, sf, "events")
    keys = {"alg": F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")), "run": F.col("user_id")}
    return decision_log(e, step=F.col("event_id"), ts=F.col("ts"), context=F.col("user_id") % 2, arm=_k() % 3, reward=(F.col("event_type") == "click").cast("int"), keys=keys)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with steps numbered from 1 inside each run."""
    rows = log(spark, sf)
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("run").orderBy("step")).cast("long"))


def arm_probs(spark: SparkSession, sf: str) -> DataFrame:
    """Observed mean reward of each context and arm, in place of unknown probabilities."""
    return log(spark, sf).groupBy("context", "arm").agg(F.avg("reward").alias("prob"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return demand_history(li, F.col("l_partkey"), F.ceil(F.col("l_quantity") / 10), F.col("l_shipdate"), [F.col("l_orderkey"), F.col("l_linenumber")])


def pmf(spark: SparkSession, sf: str) -> DataFrame:
    return demand_pmf(table(spark, sf, "lineitem"), F.col("l_partkey"), F.ceil(F.col("l_quantity") / 10))


def params(spark: SparkSession, sf: str) -> DataFrame:
    """Cost parameters that vary by part."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("item"), F.lit(1.071313739).alias("h"), (4.371773331 + F.col("p_size") % 6).alias("b"), ((F.col("p_size") % 4) * 0.231171713).alias("c"),
        F.lit(0.4712393331).alias("gamma"), F.lit(0.01).alias("theta"), F.lit(-2).alias("x_min"), F.lit(8).alias("x_max"),
    )


def reference_params(spark: SparkSession, sf: str) -> DataFrame:
    """The parameters with the reference's discount and threshold, under which loops run to convergence."""
    return params(spark, sf).withColumns({"gamma": F.lit(0.95), "theta": F.lit(1e-4)})


def states(spark: SparkSession, sf: str) -> DataFrame:
    return state_grid(params(spark, sf))


def episodes(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """One episode for each user and day: states are event types, actions x + k % 3, rewards the values; ``more`` of ts and event_id."""
    e = table(spark, sf, "events")
    kinds = F.create_map(*(y for i, k in enumerate(("click", "error", "purchase", "signup", "view")) for y in (F.lit(k), F.lit(i))))
    rows = e.select(F.col("user_id").alias("item"), F.date_format("ts", "yyyy-MM-dd").alias("episode_id"), "ts", "event_id", kinds[F.col("event_type")].alias("x"), _k().alias("k"), F.col("value").alias("reward"))
    t = F.row_number().over(Window.partitionBy("item", "episode_id").orderBy("ts", "event_id"))
    return rows.select("item", "episode_id", t.alias("t"), "x", (F.col("x") + F.col("k") % 3).alias("y"), "reward", *more)


def episode_states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("item")).distinct().select("item", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"))


def transitions(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    e = episodes(spark, sf, *more)
    return e.withColumn("x_next", F.lead("x").over(Window.partitionBy("item", "episode_id").orderBy("t"))).filter("x_next is not null")


LOG = """
log AS (SELECT event_id AS step, ts, user_id % 2 AS context, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 3 AS arm,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS reward, 'p' || CAST(user_id % 3 AS VARCHAR) AS alg, user_id AS run FROM events)"""
ARMS = """, grid AS (SELECT c.context, a.arm FROM (SELECT DISTINCT context FROM log) c CROSS JOIN (SELECT DISTINCT arm FROM log) a),
stats AS (SELECT g.context, g.arm, count(l.reward) AS n, coalesce(avg(l.reward), 0.0) AS q FROM grid g LEFT JOIN log l USING (context, arm) GROUP BY g.context, g.arm)"""
PROBS = """, probs AS (SELECT context, arm, avg(reward) AS prob FROM log GROUP BY context, arm),
best AS (SELECT context, arm AS best, prob AS best_prob FROM probs QUALIFY row_number() OVER (PARTITION BY context ORDER BY prob DESC, arm) = 1)"""
RUNS = """, runs AS (SELECT * REPLACE (row_number() OVER (PARTITION BY run ORDER BY step) AS step) FROM log),
truth AS (SELECT r.*, p.prob, b.best, b.best_prob, b.best_prob - p.prob AS regret, CASE WHEN r.arm = b.best THEN 1 ELSE 0 END AS optimal
  FROM runs r JOIN probs p USING (context, arm) JOIN best b USING (context)),
metrics AS (SELECT *, sum(regret) OVER w AS cum_regret, sum(reward) OVER w AS cum_reward FROM truth WINDOW w AS (PARTITION BY alg, run ORDER BY step ROWS UNBOUNDED PRECEDING)),
summary AS (SELECT alg, step, count(*) AS n_runs, avg(cum_regret) AS mean_cum_regret, stddev_pop(cum_regret) AS std_cum_regret, avg(regret) AS mean_regret,
  avg(cum_reward) AS mean_cum_reward, 100 * avg(optimal) AS pct_optimal FROM metrics GROUP BY alg, step)"""
PARAMS = """
params AS (SELECT p_partkey AS item, 1.071313739::DOUBLE AS h, 4.371773331::DOUBLE + p_size % 6 AS b, (p_size % 4) * 0.231171713::DOUBLE AS c, 0.4712393331::DOUBLE AS gamma, 0.01::DOUBLE AS theta, -2 AS x_min, 8 AS x_max FROM part),
states AS (SELECT item, CAST(unnest(range(x_min, x_max + 1)) AS INTEGER) AS x FROM params),
counts AS (SELECT l_partkey AS item, CAST(ceil(l_quantity / 10) AS INTEGER) AS d, count(*) AS n FROM lineitem GROUP BY ALL),
pmf AS (SELECT item, d, n / sum(n) OVER (PARTITION BY item) AS p FROM counts)"""
HISTORY = """, history AS (SELECT l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS INTEGER) AS seq, l_shipdate AS ts,
  CAST(ceil(l_quantity / 10) AS INTEGER) AS d FROM lineitem)"""
MODEL = """, acts AS (SELECT DISTINCT item, CAST(x + s.s AS INTEGER) AS y FROM states, range(0, 11) s(s)),
cost AS MATERIALIZED (SELECT a.item, a.y, sum(p * (h * greatest(0, a.y - d) + b * greatest(0, d - a.y))) AS cost FROM acts a JOIN pmf USING (item) JOIN params USING (item) GROUP BY a.item, a.y),
moves AS MATERIALIZED (SELECT a.item, a.y, greatest(x_min, least(x_max, a.y - d)) AS x_next, sum(p) AS p FROM acts a JOIN pmf USING (item) JOIN params USING (item) GROUP BY ALL),
v0 AS (SELECT s.item, s.x, 0.0::DOUBLE AS value FROM states s JOIN (SELECT DISTINCT item FROM pmf) USING (item))"""
EPISODES = """
eps AS (SELECT user_id AS item, strftime(ts, '%Y-%m-%d') AS episode_id, CAST(row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS INTEGER) AS t,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS x, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 3 AS k, value AS reward FROM events),
episodes AS (SELECT item, episode_id, t, x, x + k AS y, reward FROM eps),
transitions AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY item, episode_id ORDER BY t) AS x_next FROM episodes) WHERE x_next IS NOT NULL),
estates AS (SELECT DISTINCT user_id AS item, CAST(s.s AS INTEGER) AS x FROM events, range(0, 5) s(s))"""


def sweep(k: int) -> str:
    """CTEs g{k}, v{k}: one optimality sweep from v{k-1}, with its greedy action."""
    return f""", g{k} AS MATERIALIZED (SELECT c.item, c.y, -pr.c * c.y - c.cost + pr.gamma * e.ev AS g, pr.c FROM cost c JOIN params pr USING (item)
  JOIN (SELECT m.item, m.y, sum(m.p * v.value) AS ev FROM moves m JOIN v{k - 1} v ON v.item = m.item AND v.x = m.x_next GROUP BY m.item, m.y) e ON e.item = c.item AND e.y = c.y),
v{k} AS MATERIALIZED (SELECT s.item, s.x, g.c * s.x + g.g + 0.0 AS value, g.y FROM states s JOIN g{k} g ON g.item = s.item AND g.y BETWEEN s.x AND s.x + 10
  QUALIFY row_number() OVER (PARTITION BY s.item, s.x ORDER BY round(g.g, 9) DESC, g.y) = 1)"""
