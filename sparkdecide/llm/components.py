"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, remove, replaced

#: Edges that a task holds while it reduces them to a forest.
HELD = 1 << 20


def _lowest(pairs: DataFrame) -> DataFrame:
    """node, low: the smaller of the node and its lowest neighbour."""
    return pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges a, b: each node with the lowest it is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:  # hook both ends to the lower label, then follow labels to their ends
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    some = low != np.arange(len(nodes))
    return nodes[some], nodes[low[some]]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges a, b of a task a spanning forest; one for each HELD of its edges if it has more."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def held() -> tuple[np.ndarray, np.ndarray]:
        return spanning(np.concatenate([a, *(x for x, _ in waiting)]), np.concatenate([b, *(y for _, y in waiting)]))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for some in batches:
        waiting.append((some["a"].to_numpy(), some["b"].to_numpy()))
        size += some.num_rows
        if size >= HELD:
            a, b = held()
            waiting, size = [], 0
            if len(a) >= HELD:
                yield batch()
                a, b = a[:0], b[:0]
    a, b = held()
    yield batch()


def reduced(edges: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``edges``, which makes edges a, b of a task's batches, with a forest in their place; in the same worker."""
    return lambda batches: forest(edges(batches))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is under one lower node that is under none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
    return ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over")).filter("under + over > 1").isEmpty()


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """node, component (the lowest node it is connected with) of every node on an edge.

    edges: a, b (long). Each task reduces its edges to a forest before they are shuffled, unless what made
    them did so (``forests``).
    A round is two aggregations and two joins, and the number of rounds grows with the
    logarithm of the longest chain. A node with very many edges is one key of the joins,
    whose partitions adaptive execution splits. Edges of nulls are ignored.
    """
    now = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize((now if forests else now.mapInArrow(forest, "a bigint, b bigint")).distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = both.join(_lowest(both), "node").filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()  # most of a dense group's edges say the same
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        low = _lowest(down)
        small = down.join(low, "node").select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
        now = replaced(now, small.filter("a <> b").distinct(), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    remove(now)
    return out
