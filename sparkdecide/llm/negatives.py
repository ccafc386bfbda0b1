"""Hard negatives for anchors, by lists that the anchors of a cluster share.

An anchor's positives are the rows of its label with the highest inner products, and
the negatives of a positive are the highest rows of other labels whose scores lie
between two shares of the positive's. Scores are inner products of integer vectors, so
they are exact; ties go to the smaller id.

Anchors are clustered by direction. For a cluster with centre c, whose members lie
within the angle b of it, a row i at the angle t of c can score |u| |i| cos(max(0, t - b))
at most with any member u. Each cluster's rows are sorted by that bound once, and every
member walks the one list until what it still lacks lies above all that is left: its
fifth positive, or for each positive the tenth negative or the window's lower end. A
list is cut into blocks of BLOCK rows: a cell is a block of the table and a block of
anchors, so no task holds a whole list and no key grows with the data. The search for
negatives takes two passes: what about the square root of the blocks give is a floor
for the walk over all others, which certifies most of them early. The bound has some
slack for rounding, so no pass changes a result.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part. Vectors of unlike lengths are compared as if the shorter one
ended in zeros. Every row is a row of its own: repeated rows are listed as often as they
are there, anchors that are equal in all columns are one anchor, and an anchor's other
rows are those with another id. Scores beyond 64 bits are cut to the largest ones. An
empty table, a table without anchors or with one label only gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, remove

#: Rows of a block of the table, and anchors of a block.
BLOCK, ANCHORS = 1 << 10, 1 << 12
#: Anchors of a cluster, about.
MEMBERS = 32
#: Rows of a list that are scored at once.
STEP = 128
_LEAST, _MOST = -(1 << 63) + 1, (1 << 63) - 1

Top = tuple[np.ndarray, np.ndarray]


def integer_vectors(df: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """id, label, v: floor(scale * x) of each component x, of the rows that take part."""
    rows = df.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v")).dropna()
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~odd).select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``, with zeros after the shorter ones."""
    values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.array(vectors.value_lengths().to_pylist(), np.int64))
    sizes = np.diff(np.concatenate([[0], ends]))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


def widest(*vectors: pa.Array) -> int:
    return max((n for v in vectors for n in v.value_lengths().to_pylist()), default=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, cut to 64 bits."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:  # then doubles are exact in any order of sums
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LEAST, _MOST).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


def directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (zeros stay) and norms."""
    x = m.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def clusters(unit: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A cluster for each row: spherical k-means from evenly spaced rows."""
    k = max(1, len(unit) // MEMBERS)
    centre = unit[np.arange(k) * len(unit) // k]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        centre = directions(total)[0]
    return (unit @ centre.T).argmax(axis=1)


def shared_list(members: np.ndarray, unit: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling bound, and the bounds for members of norm 1; members: unit rows of one cluster."""
    centre = directions(members.sum(axis=0, keepdims=True))[0][0]
    wide = np.arccos(np.clip(members @ centre, -1, 1)).max()
    bound = norm * np.cos(np.maximum(0, np.arccos(np.clip(unit @ centre, -1, 1)) - wide))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def best_of(old: Top, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> Top:
    """The highest of the old rows and of the new allowed ones; ties by id. An empty place has the score _LEAST - 1."""
    s = np.concatenate([old[0], np.where(allowed, scores, _LEAST - 1)], axis=1)
    i = np.concatenate([old[1], np.broadcast_to(ids, scores.shape)], axis=1)
    keep = np.lexsort((i, ~s), axis=1)[:, : old[0].shape[1]]  # ~s falls as s grows, and never overflows
    return np.take_along_axis(s, keep, axis=1), np.take_along_axis(i, keep, axis=1)


def walked(members: np.ndarray, rows: np.ndarray, step: Callable[[np.ndarray, np.ndarray, np.ndarray], None], lacks: Callable[[], np.ndarray]) -> None:
    """Walks the list of one cluster over ``rows``: ``step`` takes open members, places and scores, until each member is certified.

    ``lacks`` gives for each member the lowest score that could still change its result.
    """
    mine, size = directions(members)
    unit, norm = directions(rows)
    order, bound = shared_list(mine, unit, norm)
    slack = 1 + 1e-6 * size * norm.max(initial=0)
    for at in range(0, len(order), STEP):
        open_ = np.flatnonzero(size * bound[at] + slack >= lacks())
        if not len(open_):
            break
        some = order[at : at + STEP]
        step(open_, some, products(members[open_], rows[some]))


def empty(n: int, k: int) -> Top:
    return np.full((n, k), _LEAST - 1), np.zeros((n, k), np.int64)


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """id, key, other, score: for each anchor of a cell the k best rows of its label."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = anchors.combine_chunks(), rows.combine_chunks()
        av, rv = _chunk(a["v"]), _chunk(r["v"])
        width = widest(av, rv)
        m, table = matrix(av, width), matrix(rv, width)
        ids, own = r["id"].to_numpy(), a["id"].to_numpy()
        labels, theirs = a["label"].to_numpy(), r["label"].to_numpy()
        groups = a["cluster"].to_numpy()
        top = empty(len(m), k)
        for c, label in sorted(set(zip(groups.tolist(), labels.tolist(), strict=True))):
            of, among = np.flatnonzero((groups == c) & (labels == label)), np.flatnonzero(theirs == label)
            if not len(among):
                continue
            best = [top[0][of], top[1][of]]

            def step(open_: np.ndarray, some: np.ndarray, scores: np.ndarray) -> None:
                there = ids[among[some]]  # noqa: B023
                best[0][open_], best[1][open_] = best_of((best[0][open_], best[1][open_]), scores, there, there != own[of[open_]][:, None])  # noqa: B023

            walked(m[of], table[among], step, lambda: best[0][:, -1].astype(np.float64))  # noqa: B023
            top[0][of], top[1][of] = best
        at, place = np.nonzero(top[0] >= _LEAST)
        return pa.table({"id": own[at], "key": a["key"].to_numpy()[at], "other": top[1][at, place], "score": top[0][at, place]})

    return find


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """id, key, slot, other, score: for each anchor of a cell and each of its positives the k best rows of the window."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = anchors.combine_chunks(), rows.combine_chunks()
        av, rv = _chunk(a["v"]), _chunk(r["v"])
        width = widest(av, rv)
        m, table = matrix(av, width), matrix(rv, width)
        ids, own = r["id"].to_numpy(), a["id"].to_numpy()
        labels, theirs = a["label"].to_numpy(), r["label"].to_numpy()
        groups = a["cluster"].to_numpy()
        positives, floors = a["positives"].to_pylist(), a["floors"].to_pylist()
        slots = max(map(len, positives))
        # an empty window where there is no positive; a floor is the score of a tenth row elsewhere
        bottom, top = np.full((len(m), slots), _MOST), np.full((len(m), slots), _LEAST)
        for i, scores in enumerate(positives):
            for j, s in enumerate(scores):
                bottom[i, j], top[i, j] = min(_MOST, max(_LEAST, -(-low * s // 100), dict(floors[i] or ()).get(j, _LEAST))), max(_LEAST, min(_MOST, high * s // 100))
        bottom = np.where(bottom > top, _MOST, bottom)
        out = []
        for c in sorted(set(groups.tolist())):
            of = np.flatnonzero(groups == c)
            lo, hi = bottom[of], top[of]
            best = [empty(len(of), k) for _ in range(slots)]

            def step(open_: np.ndarray, some: np.ndarray, scores: np.ndarray) -> None:
                unlike = theirs[some] != labels[of[open_]][:, None]  # noqa: B023
                for j, (s, i) in enumerate(best):  # noqa: B023
                    inside = unlike & (scores >= np.maximum(lo[open_, j], s[open_, -1])[:, None]) & (scores <= hi[open_, j][:, None])  # noqa: B023
                    hit = np.flatnonzero(inside.any(axis=1))
                    if len(hit):
                        s[open_[hit]], i[open_[hit]] = best_of((s[open_[hit]], i[open_[hit]]), scores[hit], ids[some], inside[hit])

            walked(m[of], table, step, lambda: np.min([np.maximum(lo[:, j], s[:, -1]) for j, (s, _) in enumerate(best)], axis=0).astype(np.float64))  # noqa: B023
            for j, (s, i) in enumerate(best):
                at, place = np.nonzero(s >= _LEAST)
                out.append((of[at], np.full(len(at), j), i[at, place], s[at, place]))
        at, slot, other, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"id": own[at], "key": a["key"].to_numpy()[at], "slot": slot.astype(np.int32), "other": other, "score": score})

    return find


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _clustered(block: pa.Table) -> pa.Table:
    """Anchors of a block with their cluster; in the order of ids, so that it doesn't depend on how they arrive."""
    block = block.sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()
    v = _chunk(block["v"])
    return block.append_column("cluster", pa.array(clusters(directions(matrix(v, widest(v)))[0]).astype(np.int32)))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each key, and their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, anchor_blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``find`` over every block of anchors with every block of rows. The fewer anchors are copied to the blocks of rows."""
    a = anchors.withColumn("_row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = rows.withColumn("_anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    both = ["_row_block", "_anchor_block"]

    def of_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return find(left, right) if left.num_rows and right.num_rows else pa.table({f.name: [] for f in fields}, schema=fields)

    fields = pa.schema([(x.split()[0], pa.int32() if x.split()[1] == "int" else pa.int64()) for x in schema.split(", ")])
    return a.groupBy(*both).cogroup(r.groupBy(*both)).applyInArrow(of_cell, schema)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which ``anchor`` holds.

    rows: id, label, v, as ``integer_vectors`` gives them. A negative's score times 100 lies from low to high times the
    positive's; rank counts from 1 among those returned.
    """
    rows = materialize(rows.select("id", "label", "v", F.xxhash64("label", "v").alias("key"), F.monotonically_increasing_id().alias("_row")), "vectors")
    n, n_anchors = rows.agg(F.count("*"), F.count_if(anchor)).first()
    blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-n_anchors // ANCHORS))
    kept = rows.filter(anchor).drop("_row").distinct().withColumn("_anchor_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks)).cast("int"))
    schema = "id bigint, label bigint, v array<bigint>, key bigint, _anchor_block int, cluster int"
    anchors = materialize(kept.groupBy("_anchor_block").applyInArrow(_clustered, schema), "anchors")
    cut = rows.withColumn("_row_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).drop("key", "_row")

    found = _cells(anchors, cut, blocks, anchor_blocks, _positives(positives), "id bigint, key bigint, other bigint, score bigint")
    best = materialize(_ranked(found, ["id", "key"], positives).select("id", "key", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = best.groupBy("id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    asked = materialize(anchors.join(scores, ["id", "key"]), "asked")
    no_floor = F.lit(None).cast("map<int,bigint>")

    schema = "id bigint, key bigint, slot int, other bigint, score bigint"
    first = min(blocks, int(np.ceil(np.sqrt(blocks))))
    pilot = _cells(asked.withColumn("floors", no_floor), cut.filter(F.col("_row_block") < first), first, anchor_blocks, _negatives(negatives, low, high), schema)
    pilot = materialize(_ranked(pilot, ["id", "key", "slot"], negatives).drop("rank"), "pilot")
    full = pilot.groupBy("id", "key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= negatives)
    floors = full.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))
    rest = asked.join(floors, ["id", "key"], "left")
    found = pilot
    if first < blocks:
        others = cut.filter(F.col("_row_block") >= first).withColumn("_row_block", F.col("_row_block") - first)
        found = pilot.unionByName(_cells(rest, others, blocks - first, anchor_blocks, _negatives(negatives, low, high), schema))
    ranked = _ranked(found, ["id", "key", "slot"], negatives).withColumnsRenamed({"other": "negative_id", "score": "negative_score"})
    out = best.join(ranked, ["id", "key", "slot"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = materialize(out, "negatives")
    remove(rows, anchors, best, asked, pilot)
    return out
