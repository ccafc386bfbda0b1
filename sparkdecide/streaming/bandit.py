"""Running statistics and learning over streams of decisions.

Counts and sums do not depend on order, so late rows are harmless and the state is
bounded by contexts x arms: no watermark is needed. Q-learning depends on order: either rows
are sorted inside a micro-batch and the order across batches is that of arrival, or rows with an event
time wait for a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.regret import attach_truth
from ..plans.qlearning import Q_SCHEMA, update
from .versions import Versions


def stream_arm_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, arm, n, q so far; run it in complete or update mode."""
    by = ["context"] if by is None else by
    return log.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.avg("reward").alias("q"))


def stream_beta_posterior(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, arm, alpha, beta so far."""
    by = ["context"] if by is None else by
    return log.groupBy(*by, "arm").agg((1 + F.sum("reward")).cast("double").alias("alpha"), (1 + F.sum(1 - F.col("reward"))).cast("double").alias("beta"))


def stream_regret(log: DataFrame, arm_probs: DataFrame) -> DataFrame:
    """alg, steps, regret, reward, pct_optimal so far: a stream-static join and one aggregation."""
    joined = attach_truth(log, arm_probs)
    return joined.groupBy("alg").agg(F.count("*").alias("steps"), F.sum("regret").alias("regret"), F.sum("reward").alias("reward"), (100 * F.avg("optimal")).alias("pct_optimal"))


def to_versions(table: DataFrame, sink: Versions) -> DataStreamWriter:
    """A writer of a complete-mode aggregation that makes each micro-batch's whole table a version."""
    return table.writeStream.outputMode("complete").foreachBatch(sink.put)


def stream_assign(requests: DataFrame, stats: Versions, assign: Callable[[DataFrame, DataFrame], DataFrame], out: Versions, start: DataFrame, by: list[str] | None = None) -> DataStreamWriter:
    """A writer that gives each micro-batch of requests arms by the newest statistics there are when it begins.

    ``stats`` is read afresh in each batch, while the stream that writes it still runs; what it
    doesn't have is taken from ``start`` (by, arm, n, q: every arm of every context), so that no
    request is without arms. Rows say in ``version`` which statistics they are by, -1 before the first.
    A batch names its version before it writes: run again after a failure, it takes the same one.
    """
    keys = [*(["context"] if by is None else by), "arm"]

    def each(batch: DataFrame, number: int) -> None:
        newest = stats.newest()
        version = int(out.pin(number, str(-1 if newest is None else newest)))
        known = start
        if version >= 0:
            seen = stats.at(version).select(*keys, F.col("n").alias("_n"), F.col("q").alias("_q"))
            known = start.join(seen, keys, "left").select(*keys, F.coalesce("_n", "n").alias("n"), F.coalesce("_q", "q").alias("q"))
        out.put(assign(batch, known).withColumn("version", F.lit(version).cast("long")), number)

    return requests.writeStream.foreachBatch(each)


#: Groups that items are dealt over: a group's items share each call of the processor, its rows of a micro-batch fit a task.
GROUPS = 1024

_PAIRS = "x array<int>, y array<int>, q array<double>, n array<bigint>"


class QState(StatefulProcessor):
    """State of a group of items: item -> its pairs (x, y) with q and n, read and written once in a micro-batch."""

    def __init__(self, y_max: int, alpha0: float, gamma: float, decay: float):
        self.settings = (y_max, alpha0, gamma, decay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("q", "item bigint", _PAIRS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        columns = (pdf[c].tolist() for c in ("item", "episode_id", "t", "x", "y", "reward", "x_next"))
        yield from self.learned(sorted(zip(*columns, strict=True), key=lambda r: r[:3]))

    def learned(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Changed pairs after rows that end in x, y, reward, x_next, sorted by item first."""
        out = []
        for item, own in groupby(rows, key=lambda r: r[0]):
            known = self.table.getValue((item,)) or ((), (), (), ())
            pairs = list(zip(known[0], known[1], strict=True))
            q, n = dict(zip(pairs, known[2], strict=True)), dict(zip(pairs, known[3], strict=True))
            changed = set()
            for *_, x, y, reward, x_next in own:
                update(q, n, int(x), int(y), float(reward), int(x_next), *self.settings)
                changed.add((int(x), int(y)))
            self.table.updateValue((item,), ([k[0] for k in q], [k[1] for k in q], list(q.values()), [n[k] for k in q]))
            out += [(item, *k, q[k], n[k]) for k in sorted(changed)]
        if out:
            yield pd.DataFrame(out, columns=["item", "x", "y", "q", "n"])

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame) -> GroupedData:
    """Rows with an item, state, action and reward, by their items' group."""
    group = F.pmod(F.xxhash64("item"), F.lit(GROUPS)).cast("int")
    return rows.withColumn("item", F.col("item").cast("long")).dropna(subset=["item", "x", "y", "reward", "x_next"]).withColumn("_group", group).groupBy("_group")


def stream_q_learning(transitions: DataFrame, y_max: int, alpha0: float = 0.1, gamma: float = 0.95, decay: float = 0.001) -> DataFrame:
    """Changed pairs (item, x, y, q, n) of each micro-batch; needs the RocksDB state store."""
    return _grouped(transitions).transformWithStateInPandas(QState(y_max, alpha0, gamma, decay), Q_SCHEMA, "Update", "None")


class LateQState(QState):
    """QState that holds rows back until the watermark has passed them, and learns each item's in the order of their event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.until = handle.getMapState("until", "item bigint", "ms bigint")
        self.last = handle.getValueState("last", "ms bigint")
        self.waiting = handle.getListState("waiting", "item bigint, ts bigint, episode_id string, t int, x int, y int, reward double, x_next int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        last = self.last.get()
        early = new["ts_ms"] <= last[0] if last else None
        if early is not None and early.any():  # what an item has learned stays: an earlier row is too late, even if Spark still lets it pass
            until = {i: self.until.getValue((i,)) for i in set(new["item"][early].tolist())}
            new = new[[not (until.get(i) and ms <= until[i][0]) for i, ms in zip(new["item"].tolist(), new["ts_ms"].tolist(), strict=True)]]
        if new.empty:
            return
        columns = (new[c].tolist() for c in ("item", "ts_ms", "episode_id", "t", "x", "y", "reward", "x_next"))
        self.waiting.appendList([(int(i), int(a), str(e), int(t), int(x), int(y), float(r), int(z)) for i, a, e, t, x, y, r, z in zip(*columns, strict=True)])
        self.handle.registerTimer(int(new["ts_ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[1] <= now), key=lambda r: r[:4])
        if not due:
            return
        for item in {r[0] for r in due}:
            self.until.updateValue((item,), (now,))
        self.last.update((now,))
        rest = [r for r in rows if r[1] > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[1] for r in rest))
        else:
            self.waiting.clear()
        yield from self.learned(due)


def stream_late_q_learning(transitions: DataFrame, y_max: int, delay: str, alpha0: float = 0.1, gamma: float = 0.95, decay: float = 0.001) -> DataFrame:
    """The same for rows with an event time ``ts`` that arrive in any order, up to ``delay`` late.

    Rows wait in the state until the watermark is past them, so each item learns in the order of (ts, episode_id, t)
    whatever the order of arrival. Rows that come after their item has learned up to a watermark past them are left out. What
    the watermark hasn't reached at the end of a source waits for later rows.
    """
    # milliseconds, rounded up, so that no row is learned before the watermark is past it
    rows = transitions.withColumn("ts_ms", F.ceil(F.unix_micros("ts") / 1000)).withWatermark("ts", delay)
    return _grouped(rows).transformWithStateInPandas(LateQState(y_max, alpha0, gamma, decay), Q_SCHEMA, "Update", "EventTime")
