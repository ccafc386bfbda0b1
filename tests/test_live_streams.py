"""Streams that read what other streams still write, and batches that are run again."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from sparkdecide.operators import bandit as B
from sparkdecide.operators.grids import arm_grid
from sparkdecide.streaming import bandit as S
from sparkdecide.streaming.versions import Versions

LOG = "step long, context long, arm int, reward int"


def assign(requests, known):
    return B.epsilon_greedy_assign(requests, known, 0.2, 3)


@pytest.fixture
def folders(spark, tmp_path):
    log = spark.range(600).select(F.col("id").alias("step"), (F.col("id") % 2).alias("context"), (F.col("id") % 3).cast("int").alias("arm"), (F.pmod(F.col("id") * F.col("id"), F.lit(7)) < 3 + F.col("id") / 200).cast("int").alias("reward"))
    requests = spark.range(400).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("context"))
    for name, rows, files in (("log", log, 6), ("requests", requests, 5)):
        rows.repartitionByRange(files, rows.columns[0]).write.parquet(f"{tmp_path}/{name}")
    return log, requests, str(tmp_path)


def streams(spark, log, requests, path):
    live_log, live_requests = (spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}") for name, x in (("log", log), ("requests", requests)))
    table = S.stream_arm_stats(live_log)
    start = arm_grid(log)
    stats = Versions(spark, f"{path}/stats", table.schema)
    out = Versions(spark, f"{path}/out", assign(requests, start).withColumn("version", F.lit(0).cast("long")).schema)
    writers = S.to_versions(table, stats).option("checkpointLocation", f"{path}/c1"), S.stream_assign(live_requests, stats, assign, out, start).option("checkpointLocation", f"{path}/c2")
    return stats, out, start, writers


def test_assignments_equal_the_version_they_name(spark, folders):
    log, requests, path = folders
    stats, out, start, writers = streams(spark, log, requests, path)
    live = [w.trigger(availableNow=True).start() for w in writers]  # both run at once
    for q in live:
        q.awaitTermination()
    rows = out.all("batch").collect()
    assert sorted(r.request_id for r in rows) == list(range(400)) and len({r.batch for r in rows}) == 5
    for batch in {r.batch for r in rows}:
        mine = [r for r in rows if r.batch == batch]
        (version,) = {r.version for r in mine}
        known = start
        if version >= 0:
            seen = {(r.context, r.arm): (r.n, r.q) for r in stats.at(version).collect()}
            known = spark.createDataFrame([(r.context, r.arm, *seen.get((r.context, r.arm), (0, 0.0))) for r in start.collect()], start.schema)
        want = assign(spark.createDataFrame([(r.request_id, r.context) for r in mine], requests.schema), known).collect()
        assert {tuple(r) for r in want} == {(r.request_id, r.context, r.arm, r.explored) for r in mine}
    assert stats.at(stats.newest()).agg(F.sum("n")).first()[0] == 600


def test_a_batch_run_again_gives_the_same_rows(spark, folders):
    log, requests, path = folders
    stats, out, start, writers = streams(spark, log, requests, path)
    writers[1].trigger(availableNow=True).start().awaitTermination()  # no statistics yet
    before = sorted(map(tuple, out.all("batch").collect()))
    assert {r[-2] for r in before} == {-1}
    writers[0].trigger(availableNow=True).start().awaitTermination()
    # the last batch's commit is lost: once after its rows were named, once before
    for name in sorted(os.listdir(f"{path}/c2/commits")):
        if name.strip(".").startswith("4"):
            os.remove(f"{path}/c2/commits/{name}")
    again = S.stream_assign(spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/requests"), stats, assign, out, start)
    again.option("checkpointLocation", f"{path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, out.all("batch").collect())) == before
    for folder in ("versions", "c2/commits"):
        at = f"{path}/out/{folder}" if folder == "versions" else f"{path}/{folder}"
        for name in os.listdir(at):
            if name.strip(".").startswith(("000000000004", "4")):
                os.remove(f"{at}/{name}")
    again.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, out.all("batch").collect())) == before


def test_versions_are_whole_for_readers(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), spark.range(1).schema)
    assert v.newest() is None and v.all().count() == 0
    v.put(spark.range(5), 0)
    v.put(spark.range(9), 0)  # a version that is there stays
    assert v.at(0).count() == 5
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append((n := v.newest(), v.at(n).count()))

    t = threading.Thread(target=read)
    t.start()
    for k in range(1, 5):
        v.put(spark.range(5 + k), k)
    stop.set()
    t.join()
    assert all(count == 5 + n for n, count in seen)
    assert v.pin(9, "a") == "a" and v.pin(9, "b") == "a"
    v.expire(2)
    assert sorted(v.known()) == [3, 4] and v.all("k").count() == 17
