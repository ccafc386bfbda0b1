"""Queries that run the streaming operators over the events table until it is used up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandit as B
from ..operators.grids import arm_grid
from ..sources.tables import write_results
from ..storage import materialize, new_path
from ..streaming import bandit as S
from ..streaming.versions import Versions, file_system
from . import bandit as Q
from . import inputs as I
from . import learning as L
from .inputs import LOG, PROBS, RUNS, rounded


def _stream(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """Rows as a stream of their files, one file a micro-batch."""
    path = new_path(spark, "stream")
    rows.repartitionByRange(files, rows.columns[0]).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_in_order(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """As _stream, with the files written one after the other, as a stream takes them by their age."""
    path = new_path(spark, "stream")
    cut = materialize(rows.repartitionByRange(files, rows.columns[0]).withColumn("_file", F.spark_partition_id()), "ordered")
    for k in range(files):
        cut.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _last(spark: SparkSession, out: DataFrame) -> DataFrame:
    """The table that a complete-mode aggregation has when its source is used up."""
    sink = Versions(spark, new_path(spark, "state"), out.schema)
    w = S.to_versions(out, sink).option("checkpointLocation", new_path(spark, "offsets"))
    w.trigger(availableNow=True).start().awaitTermination()
    newest = sink.newest()
    return spark.createDataFrame([], out.schema) if newest is None else sink.at(newest)


#: Parts that the log and the requests arrive in.
PARTS = 4


def _part(rows: DataFrame, id_col: str) -> DataFrame:
    """rows with _part, by equal ranges of ids."""
    ends = rows.agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    part = F.floor((F.col(id_col) - F.col("_lo")) * PARTS / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("_lo", "_hi")


def _arrive(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> None:
    """Add rows to a folder that a stream watches: written aside, and moved there in one step."""
    aside = new_path(spark, "aside")
    rows.write.parquet(aside)
    fs, at = file_system(spark, aside)
    to = file_system(spark, f"{folder}/{name}")[1]
    fs.mkdirs(to.getParent())
    fs.rename(at, to)


def _assigned(s, d):
    """Arms for a stream of requests while the stream of decisions goes on.

    Both streams run all the time. A part of the log arrives, then a part of the requests, and so on: each
    request is served by the statistics of all decisions that have arrived.
    """
    log, requests = _part(I.log(s, d), "step"), _part(Q._requests(s, d), "request_id")
    watched = [new_path(s, name) for name in ("log", "requests")]
    for folder in watched:
        fs, at = file_system(s, folder)
        fs.mkdirs(at)
    live_log, live_requests = (s.readStream.schema(x.drop("_part").schema).option("recursiveFileLookup", "true").parquet(folder) for x, folder in zip((log, requests), watched, strict=True))
    stats = S.stream_arm_stats(live_log)
    sink, start = Versions(s, new_path(s, "statistics"), stats.schema), materialize(arm_grid(I.log(s, d)), "arms")

    def assign(r: DataFrame, known: DataFrame) -> DataFrame:
        return B.epsilon_greedy_assign(r, known, 0.1, 5)

    out = Versions(s, new_path(s, "assigned"), assign(requests, start).withColumn("version", F.lit(0).cast("long")).schema)
    running = []
    try:
        running.append(S.to_versions(stats, sink).option("checkpointLocation", new_path(s, "offsets")).start())
        running.append(S.stream_assign(live_requests, sink, assign, out, start).option("checkpointLocation", new_path(s, "offsets")).start())
        for k in range(PARTS):
            for rows, folder, stream in zip((log, requests), watched, running, strict=True):
                _arrive(s, rows.filter(F.col("_part") == k).drop("_part"), folder, str(k))
                stream.processAllAvailable()
    finally:
        for stream in running:
            stream.stop()
    return out.all()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that custom state needs, for as long as a stream starts and runs."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _learned(s, changes: DataFrame) -> DataFrame:
    """Pairs, q and counts after a stream of changed pairs: those with the highest count."""
    sink = Versions(s, new_path(s, "q"), changes.schema)
    with _state_store(s):
        w = changes.writeStream.outputMode("update").foreachBatch(sink.put).option("checkpointLocation", new_path(s, "offsets"))
        w.trigger(availableNow=True).start().awaitTermination()
    last = sink.all().groupBy("item", "x", "y").agg(F.max(F.struct("n", "q")).alias("last"))
    return last.select("item", "x", "y", F.col("last.q").alias("q"), F.col("last.n").alias("n"))


def _q_learning(s, d):
    """After the stream, which takes the episodes in order."""
    rows = _stream_in_order(s, I.transitions(s, d).select("episode_id", "item", "t", "x", "y", "reward", "x_next"))
    return _learned(s, S.stream_q_learning(rows, 6, gamma=L.GAMMA))


def _late_q_learning(s, d):
    """The same for transitions that arrive up to two days late, by a hash of their event; a last row of no item moves the watermark past all."""
    late = F.pmod(F.col("event_id") * 7919, F.lit(48)) * 3600
    rows = I.transitions(s, d, "ts", "event_id").select((F.unix_timestamp("ts") + late).alias("arrived"), "episode_id", "item", "t", "x", "y", "reward", "x_next", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.max("arrived").alias("arrived"), F.max("ts").alias("ts")).select(F.col("arrived") + 9 * 86400, F.lit(""), F.lit(-1).cast("long"), *(F.lit(0),) * 3, F.lit(0.0), F.lit(0), F.col("ts") + F.expr("interval 9 days"))
    stream = _stream_in_order(s, rows.unionAll(end.toDF(*rows.columns)))
    return _learned(s, S.stream_late_q_learning(stream.drop("arrived"), 6, "2 days", gamma=L.GAMMA))


def _written(s, d):
    path = new_path(s, f"results-{uuid.uuid4().hex[:6]}")
    write_results(rounded(B.arm_stats(I.log(s, d), ["run"]), "q"), path, ["arm"])
    return s.read.parquet(path).select("run", "arm", "n", "q")


QUERIES = {
    "r1_stream_arm_stats": lambda s, d: rounded(_last(s, S.stream_arm_stats(_stream(s, I.log(s, d)))), "q"),
    "r2_stream_beta_posterior": lambda s, d: _last(s, S.stream_beta_posterior(_stream(s, I.log(s, d)))),
    "r3_stream_assign": _assigned,
    "r4_stream_q_learning": lambda s, d: rounded(_q_learning(s, d), "q"),
    "r4_late_rows": lambda s, d: rounded(_late_q_learning(s, d), "q"),
    "r4_stream_visit_counts": lambda s, d: _q_learning(s, d).drop("q"),
    "r5_stream_regret": lambda s, d: rounded(_last(s, S.stream_regret(_stream(s, I.log(s, d)), I.arm_probs(s, d))), "regret", "pct_optimal"),
    "s9_write_results": _written,
}

_CUT = f"least({PARTS - 1}, (event_id - min(event_id) OVER ()) * {PARTS} // (max(event_id) OVER () - min(event_id) OVER () + 1))"
#: Requests of a part by all decisions up to that part.
ASSIGNED_SQL = f"""WITH {LOG}, grid AS (SELECT c.context, a.arm FROM (SELECT DISTINCT context FROM log) c CROSS JOIN (SELECT DISTINCT arm FROM log) a),
parts AS (SELECT event_id, user_id % 2 AS context, {_CUT} AS part FROM events),
so_far AS (SELECT v.v AS part, g.context, g.arm, coalesce(avg(l.reward), 0.0) AS q FROM range(0, {PARTS}) v(v) CROSS JOIN grid g
  LEFT JOIN (SELECT log.*, part FROM log JOIN parts ON event_id = step) l ON l.context = g.context AND l.arm = g.arm AND l.part <= v.v GROUP BY ALL),
greedy AS (SELECT part, context, arm FROM so_far QUALIFY row_number() OVER (PARTITION BY part, context ORDER BY q DESC, arm) = 1),
arms AS (SELECT context, list(arm ORDER BY arm) AS arms FROM grid GROUP BY context),
r AS (SELECT event_id AS request_id, context, part, {Q._unit("event_id", 5)} AS u, {Q._unit("event_id", 12)} AS v FROM parts)
SELECT request_id, r.context, CASE WHEN u < 0.1 THEN arms[CAST(floor(v * len(arms)) AS INTEGER) + 1] ELSE g.arm END AS arm, CASE WHEN u < 0.1 THEN 1 ELSE 0 END AS explored, CAST(part AS BIGINT) AS version
FROM r JOIN greedy g USING (part, context) JOIN arms USING (context)"""

ORACLES = {
    "r1_stream_arm_stats": f"WITH {LOG} SELECT context, arm, count(*) AS n, round(avg(reward), 6) + 0.0 AS q FROM log GROUP BY context, arm",
    "r2_stream_beta_posterior": f"WITH {LOG} SELECT context, arm, 1.0::DOUBLE + sum(reward) AS alpha, 1.0::DOUBLE + sum(1 - reward) AS beta FROM log GROUP BY context, arm",
    "r3_stream_assign": ASSIGNED_SQL,
    "r4_stream_q_learning": L.Q_SQL,
    "r4_late_rows": L.Q_SQL,
    "r4_stream_visit_counts": f"WITH {I.EPISODES} SELECT item, x, y, count(*) AS n FROM transitions GROUP BY ALL",
    "r5_stream_regret": f"WITH {LOG}{PROBS}{RUNS} SELECT alg, count(*) AS steps, round(sum(regret), 6) + 0.0 AS regret, CAST(sum(reward) AS BIGINT) AS reward, round(100 * avg(optimal), 6) + 0.0 AS pct_optimal FROM truth GROUP BY alg",
    "s9_write_results": f"WITH {LOG}, g AS (SELECT c.run, a.arm FROM (SELECT DISTINCT run FROM log) c CROSS JOIN (SELECT DISTINCT arm FROM log) a) SELECT g.run, g.arm, count(l.reward) AS n, round(coalesce(avg(l.reward), 0.0), 6) + 0.0 AS q FROM g LEFT JOIN log l ON l.run = g.run AND l.arm = g.arm GROUP BY g.run, g.arm",
}

