"""Q-learning from logged transitions.

Transitions: item, episode_id, t, x, y, reward, x_next. Items learn in parallel; one
item's updates are in the order of (episode_id, t) and stay in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import merged
from .batches import STATES_DDL


def td_target(transitions: DataFrame, q_table: DataFrame, gamma: float = 0.95) -> DataFrame:
    """transitions with target: reward + gamma * the best known q from the next state on, 0 where none is known."""
    best = q_table.filter("y >= x").groupBy("item", "x").agg(F.max("q").alias("best")).withColumnRenamed("x", "x_next")
    best = best.select("item", "x_next", F.greatest("best", F.lit(float("-inf"))).alias("best"))
    return merged(transitions, best, ["item", "x_next"], "left").withColumn("target", F.col("reward") + F.lit(gamma) * F.coalesce("best", F.lit(0.0))).drop("best")


def update(q: dict, n: dict, x: int, y: int, reward: float, x_next: int, y_max: int, alpha0: float, gamma: float, decay: float) -> None:
    """One update in place. Pairs never seen count as 0, and actions below the state are no actions."""
    k = (x, y)
    n[k] = n.get(k, 0) + 1
    rate = alpha0 / (1 + decay * n[k])
    ahead = [q.get((x_next, a), 0.0) for a in range(x_next, y_max + 1)]
    q[k] = q.get(k, 0.0) + rate * (reward + gamma * (max(ahead) if ahead else 0.0) - q.get(k, 0.0))


Q_SCHEMA = "item bigint, x int, y int, q double, n bigint"
TABLES = "item bigint, pairs array<struct<x:int,y:int,q:double,n:bigint>>"
Q_FIELDS = pa.schema([("item", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("q", pa.float64()), ("n", pa.int64())])
PAIR = pa.struct(list(Q_FIELDS)[1:])

#: Rows that are stepped through together, cells of their tables, and items below which rows go one by one.
ROWS, CELLS, FEW = 1 << 16, 1 << 22, 8


class Learner:
    """Updates of sorted rows (item, x, y, reward, x_next), many items together; the last item is carried on to the next rows."""

    def __init__(self, y_max: int, alpha0: float, gamma: float, decay: float):
        self.y_max, self.alpha0, self.gamma, self.decay = y_max, alpha0, gamma, decay
        self.open: tuple[int, dict, dict] | None = None
        self.done: tuple[np.ndarray, ...] = ()

    def take(self, item: np.ndarray, x: np.ndarray, y: np.ndarray, reward: np.ndarray, x_next: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Tables of the items that are complete: all before the last one."""
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        ends = np.append(starts[1:], len(item))
        if self.open and self.open[0] != item[0]:
            yield self._told([self.open])
            self.open = None
        low_x, low_y = int(min(x.min(), x_next.min())), int(min(y.min(), x_next.min(), self.y_max))
        wide, deep = int(max(x.max(), x_next.max())) - low_x + 1, int(max(y.max(), self.y_max)) - low_y + 1
        rows = (x, y, reward, x_next)
        many = max(1, CELLS // (wide * deep))
        for at in range(0, len(starts), many):
            some = slice(at, at + many)
            first = self.open if at == 0 else None
            if wide * deep > CELLS:
                done = [self._alone(int(item[starts[at]]), [r[starts[at] : ends[at]] for r in rows], first)]
            else:
                done = self._together(item[starts[some]], starts[some], ends[some], rows, (low_x, low_y, wide, deep), first)
                if len(self.done[0]):
                    yield _rows(*self.done)
            if at + many >= len(starts):
                *done, self.open = done
            if done:
                yield self._told(done)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._told([self.open])

    def _alone(self, item: int, rows: list[np.ndarray], known: tuple[int, dict, dict] | None) -> tuple[int, dict, dict]:
        q, n = (known[1], known[2]) if known else ({}, {})
        for r in zip(*(c.tolist() for c in rows), strict=True):
            update(q, n, *r, self.y_max, self.alpha0, self.gamma, self.decay)
        return item, q, n

    def _together(self, items: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: tuple[np.ndarray, ...], frame: tuple[int, int, int, int], known: tuple[int, dict, dict] | None) -> list[tuple[int, dict, dict]]:
        """Step k takes row k of every item that has one; what few long items have left goes row by row."""
        low_x, low_y, wide, deep = frame
        q, n = np.zeros((len(items), wide, deep)), np.zeros((len(items), wide, deep), np.int64)
        outside: dict[tuple[int, int], tuple[float, int]] = {}
        for (a, b), value in known[1].items() if known else ():
            if 0 <= a - low_x < wide and 0 <= b - low_y < deep:
                q[0, a - low_x, b - low_y], n[0, a - low_x, b - low_y] = value, known[2][a, b]
            else:  # a pair that these rows don't meet
                outside[a, b] = value, known[2][a, b]
        levels, states = low_y + np.arange(deep), low_x + np.arange(wide)
        barred = (levels < states[:, None]) | (levels > self.y_max)
        none = barred.all(axis=1)
        x, y, reward, x_next = rows
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        falling = sizes[order]
        steps = int(falling[FEW]) if len(order) > FEW else 0
        for k in range(steps):
            of = order[: np.searchsorted(-falling, -k, side="left")]
            at = starts[of] + k
            i, j, to = x[at] - low_x, y[at] - low_y, x_next[at] - low_x
            n[of, i, j] += 1
            ahead = np.where(none[to], 0.0, np.where(barred[to], -np.inf, q[of, to]).max(axis=1))
            q[of, i, j] += self.alpha0 / (1 + self.decay * n[of, i, j]) * (reward[at] + self.gamma * ahead - q[of, i, j])
        # tables of items that are complete leave as arrays; the last item and what is stepped alone need theirs by pair
        by_pair = np.flatnonzero((sizes > steps) | (np.arange(len(items)) == len(items) - 1) | (np.arange(len(items)) == 0))
        plain = np.setdiff1d(np.arange(len(items)), by_pair)
        of, i, j = np.nonzero(n[plain])
        self.done = (items[plain][of], i + low_x, j + low_y, q[plain][of, i, j], n[plain][of, i, j])
        out = []
        for k, item in zip(by_pair.tolist(), items[by_pair].tolist(), strict=True):
            i, j = np.nonzero(n[k])
            pairs = list(zip((i + low_x).tolist(), (j + low_y).tolist(), strict=True))
            one = (item, dict(zip(pairs, q[k, i, j].tolist(), strict=True)), dict(zip(pairs, n[k, i, j].tolist(), strict=True)))
            if k == 0:
                one[1].update({p: v for p, (v, _) in outside.items()})
                one[2].update({p: c for p, (_, c) in outside.items()})
            out.append(self._alone(item, [r[starts[k] + steps : ends[k]] for r in rows], one) if sizes[k] > steps else one)
        return out

    @staticmethod
    def _told(done: list[tuple[int, dict, dict]]) -> pa.RecordBatch:
        return _rows(*zip(*((item, *p, q[p], n[p]) for item, q, n in done for p in sorted(q)), strict=True))


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, Q_FIELDS, strict=True)], schema=Q_FIELDS)


def _by_item(b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of whole items as a row for each item."""
    item = b["item"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    flat = pa.StructArray.from_arrays([b[f.name] for f in PAIR], fields=list(PAIR))
    return pa.RecordBatch.from_arrays([pa.array(item[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(item)), pa.int32()), flat)], names=["item", "pairs"])


def q_tables(transitions: DataFrame, y_max: int, alpha0: float = 0.1, gamma: float = 0.95, decay: float = 0.001) -> DataFrame:
    """item, pairs (x, y, q, n in order of x and y): what each item has learned, in one row. Rows without an item, state,
    action or reward are left out.

    A task reads its items' rows in order, ROWS at a time, and holds no more of a log than that: what an item has
    learned is carried over when its log goes on.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, held, size = Learner(y_max, alpha0, gamma, decay), [], 0

        def columns() -> list[np.ndarray]:
            return [np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("item", "x", "y", "reward", "x_next")]

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= ROWS:
                yield from map(_by_item, learner.take(*columns()))
                held, size = [], 0
        if held:
            yield from map(_by_item, learner.take(*columns()))
        yield from map(_by_item, learner.rest())

    rows = transitions.select(F.col("item").cast("long").alias("item"), "episode_id", "t", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "x_next")), F.col("reward").cast("double").alias("reward"))
    rows = rows.dropna(subset=["item", "x", "y", "reward", "x_next"])
    sorted_rows = rows.repartition("item").sortWithinPartitions("item", "episode_id", "t")
    return sorted_rows.select("item", "x", "y", "reward", "x_next").mapInArrow(fold, TABLES)


def q_learning(transitions: DataFrame, y_max: int, alpha0: float = 0.1, gamma: float = 0.95, decay: float = 0.001) -> DataFrame:
    """item, x, y, q, n of every pair in the log."""
    return q_tables(transitions, y_max, alpha0, gamma, decay).select("item", F.explode("pairs").alias("p")).select("item", "p.*")


CHOSEN = pa.list_(pa.struct([("x", pa.int32()), ("value", pa.float64()), ("y", pa.int32())]))


def _greedy(y_max: int):
    """Rows of item, xs, pairs: the states xs up to y_max with their best action; only pairs that are known are looked at."""

    def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(lists)), sizes), lists.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, pairs = flat(b["pairs"])
            x, y = (pairs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
            q = pairs.field("q").to_numpy(zero_copy_only=False).astype(np.float64)
            use = (y >= x) & (y <= y_max)
            item, x, y, q = item[use], x[use], y[use], np.where(np.isnan(q), 0.0, q)[use]
            by = np.lexsort((-q, y, x, item))
            item, x, y, q = item[by], x[by], y[by], q[by]
            new = np.ones(len(item), bool)  # a pair that stands twice counts with its best value
            new[1:] = (item[1:] != item[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            item, x, y, q = item[new], x[new], y[new], q[new]
            of, states = flat(b["xs"])
            states = states.to_numpy(zero_copy_only=False).astype(np.int64)
            of, states = of[states <= y_max], states[states <= y_max]
            value, best = np.zeros(len(states)), states.copy()
            if len(item) and len(states):
                low, wide = int(min(x.min(), states.min())), int(max(x.max(), states.max())) + 1
                key, wanted = item * (wide - low) + x - low, of * (wide - low) + states - low
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sizes = np.diff(np.append(starts, len(key)))
                owner = np.repeat(np.arange(len(starts)), sizes)
                top = np.maximum.reduceat(q, starts)
                at_top = np.minimum.reduceat(np.where(q == top[owner], y, y_max + 1), starts)
                # the lowest action that isn't known is worth 0
                rank = np.arange(len(y)) - starts[owner]
                missing = x[starts] + np.minimum.reduceat(np.where(y == x + rank, sizes[owner], rank), starts)
                zero = (missing <= y_max) & ((top < 0) | ((top == 0) & (missing < at_top)))
                at = np.minimum(np.searchsorted(key[starts], wanted), len(starts) - 1)
                known = key[starts][at] == wanted
                value = np.where(known, np.where(zero, 0.0, top)[at], 0.0)
                best = np.where(known, np.where(zero, missing, at_top)[at], states)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))]), pa.int32())
            chosen = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((states, value, best), CHOSEN.value_type, strict=True)], fields=list(CHOSEN.value_type))
            yield pa.RecordBatch.from_arrays([b["item"].cast(pa.int64()), pa.ListArray.from_arrays(ends, chosen)], names=["item", "states"])

    return run


def greedy_of_tables(tables: DataFrame, states: DataFrame, y_max: int) -> DataFrame:
    """item, states (x, value, y in order of x): the best action of each state under y >= x, an item in one row.

    tables: item, pairs. A pair that isn't there is worth 0, ties go to the smallest y. No row is made for a pair.
    """
    xs = states.groupBy("item").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    rows = merged(xs, tables.select("item", F.transform("pairs", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"), p["q"].cast("double").alias("q"))).alias("pairs")), "item", "left")
    return rows.select(F.col("item").cast("long").alias("item"), F.col("xs").cast("array<int>").alias("xs"), "pairs").mapInArrow(_greedy(y_max), f"item bigint, states {STATES_DDL}")


def greedy_from_q(q_table: DataFrame, states: DataFrame, y_max: int) -> DataFrame:
    """item, x, y, value: best action of each state under y >= x; missing q counts as 0, ties go to the smallest y."""
    tables = q_table.filter("x is not null and y is not null").groupBy("item").agg(F.collect_list(F.struct("x", "y", "q")).alias("pairs"))
    return greedy_of_tables(tables, states, y_max).select("item", F.explode("states").alias("s")).select("item", "s.x", "s.y", "s.value")
