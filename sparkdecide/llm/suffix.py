"""Suffix-array dedup: repeated strings of at least ``length`` bytes, and their removal.

A byte is removed if it lies in a string of ``length`` bytes that starts anywhere
else too, in another document or the same one.

The corpus is cut into stretches first. Each window of ``length`` bytes is named by
the lowest hash of its grams (shorter strings inside it), so equal windows have equal
names, and consecutive windows named by one place are a stretch. Windows of one
stretch differ, so a name that only one stretch has can't repeat. Equal stretches are counted, not copied, and names whose
stretches are all equal are decided by the count.

For the other names the distinct stretches meet in a task, as many as a batch holds. A
suffix array gives their Burrows-Wheeler transform, and breadth-first backward
extension of intervals over it sets common-prefix values in increasing order, from 0
to length - 1. What is still unset then is a common prefix of ``length`` bytes or more:
the suffixes between two set values begin with one repeated string. Names whose
stretches are too many for one task are named again by longer grams, up to the
whole window, where equal names mean equal windows.

Defined results: a null text is an empty text; texts under ``length`` bytes lose
nothing. Each row is a document of its own, so a repeated row repeats its text.
An empty table gives an empty table. Rows are numbered once, in a table that is written
before anything else; its number avoids names that ``documents`` has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, remove
from .texts import bounded_batches, chunks, encoded, joined, mixed, powers, unused

_BYTE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of stretches whose suffixes are sorted together, and those of one name that go to one task.
BATCH, HOT = 1 << 19, 1 << 19
#: Stretches that are sorted together, but for those of the last name.
MANY = 1 << 13


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, start, windows, name and digest of each stretch of the texts of ``length`` bytes or more."""
    b, starts = joined(texts)
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b), _BASE), out=total[1:])
    back = powers(len(b) + 1, _INVERSE)
    grams = mixed((total[gram:] - total[:-gram]) * back[: len(b) - gram + 1])
    low = sliding_min(grams, length - gram + 1)  # of the window at each place
    size = np.diff(starts)
    first = starts[:-1]
    valid = np.zeros(len(low) + 1, np.int32)
    has = size >= length
    np.add.at(valid, first[has], 1)
    np.add.at(valid, (first + size - length + 1)[has], -1)
    inside = np.cumsum(valid[:-1]) > 0
    change = np.ones(len(low), bool)
    # another lowest gram, or the same one from its next place on: a gram stands once in a stretch
    change[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])
    change[first[has]] = True
    change &= inside
    change_or_out = change | ~inside
    at = np.flatnonzero(change)
    edges = np.flatnonzero(np.append(change_or_out, True))
    end = edges[np.searchsorted(edges, at, side="right")]
    text = np.searchsorted(starts, at, side="right") - 1
    digest = mixed((total[end + length - 1] - total[at]) * back[at] + (end - at).astype(np.uint64))
    return text, at - starts[text], end - at, low[at], digest


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of ``symbols`` (under 65536, ending in a unique one), by doubling from four symbols on."""
    n = len(symbols)
    if n and int(symbols.max()) >= 1 << 16:
        raise ValueError("symbols have to be under 65536: too many strings at once")
    s = np.concatenate([symbols, np.zeros(4, np.int64)]).astype(np.uint64)
    key = s[:n] << np.uint64(48) | s[1 : n + 1] << np.uint64(32) | s[2 : n + 2] << np.uint64(16) | s[3 : n + 3]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = place
    h = 4
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)  # places in the order that aren't decided yet
    while len(open_):
        i = order[open_]
        a, b = rank[i], rank[np.minimum(i + h, n)]
        by = np.argsort(a * np.int64(n + 2) + b + 1, kind="stable")
        i, a, b = i[by], a[by], b[by]
        order[open_] = i
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        place = open_[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        rank[i] = place
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefix_bounds(symbols: np.ndarray, order: np.ndarray, separators: int, length: int) -> np.ndarray:
    """Where, in suffix order, the common prefix with the suffix before is shorter than ``length``.

    symbols below ``separators`` are unique and end a string each. Intervals of the
    Burrows-Wheeler transform are extended backward, breadth first: at level k every
    interval of a string of k + 1 symbols ends at a place whose common prefix is k at
    most, and the places not set before have exactly k.
    """
    n = len(symbols)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = order - 1  # of the first suffix: the last symbol, a separator
    char = symbols[before]
    back = inverse[before]
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    sorted_char = char[forward]
    following, previous = np.full(n, n), np.full(n, -1)
    same = np.flatnonzero(sorted_char[1:] == sorted_char[:-1])
    following[forward[same]] = forward[same + 1]
    previous[forward[same + 1]] = forward[same]
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(length):
        size = high - low + 1
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(low - (ends - size), size)
        lows, highs = np.repeat(low, size), np.repeat(high, size)
        extends = char[at] >= separators if level else np.ones(len(at), bool)
        is_last, is_first = extends & (following[at] > highs), extends & (previous[at] < lows)
        owner = np.repeat(np.arange(len(low)), size)
        last, first = at[is_last], at[is_first]
        by_last = np.argsort(owner[is_last] * (1 << 20) + char[last], kind="stable")
        by_first = np.argsort(owner[is_first] * (1 << 20) + char[first], kind="stable")
        high, low = back[last[by_last]], back[first[by_first]]
        fresh = ~bound[high + 1]
        bound[high + 1] = True
        if level == 0:
            fresh[:] = True  # the last interval ends at n, which is set from the start
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return bound[:n]


def repeated_windows(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes occur more than once; a string of weight w stands w times."""
    k = len(strings)
    ends = np.cumsum([len(s) + 1 for s in strings])
    symbols = np.empty(int(ends[-1]), np.int64)
    starts = ends - [len(s) + 1 for s in strings]
    for i, (s, at) in enumerate(zip(strings, starts.tolist(), strict=True)):
        symbols[at : at + len(s)] = np.frombuffer(s, np.uint8)
        symbols[at + len(s)] = i - k
    symbols += k
    order = suffix_order(symbols)
    bound = common_prefix_bounds(symbols, order, k, length)
    group = np.cumsum(bound) - 1
    owner = np.repeat(np.arange(k), ends - starts)
    count = np.bincount(group, np.array(weights)[owner[order]])
    twice = np.zeros(len(symbols), bool)
    twice[order] = count[group] > 1
    return [twice[at : at + len(s) - length + 1] for s, at in zip(strings, starts.tolist(), strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


SPANS = pa.list_(pa.int32())
STRETCH_DDL = "row bigint, start int, windows int, name bigint, digest bigint"


def _stretch_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].cast(pa.binary()).to_pylist()
            row = b["row"].to_numpy()
            for i, j in chunks(texts):
                text, start, windows, name, digest = stretches(texts[i:j], length, gram)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[i:j][text]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(digest.view(np.int64))],
                        names=["row", "start", "windows", "name", "digest"],
                    )

    return run


def _decide(length: int):
    """Spans (pairs of window numbers) of repeated windows of rows name, digest, weight, piece, in batches."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[3] for r in rows], [r[2] for r in rows], length)
        spans = [np.stack(runs(f), 1).ravel().astype(np.int32) for f in flags]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, SPANS)], names=["name", "digest", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("name", "digest", "weight", "piece")), strict=True):
                if (size > BATCH or len(held) > MANY) and r[0] != last:
                    yield batch(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
                last = r[0]
        if held:
            yield batch(held)

    return run


def _again(length: int, gram: int):
    """Stretches of pieces by longer grams: the piece they come from, and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b["piece"].to_pylist()
            for i, j in chunks(pieces):
                text, start, windows, name, digest = stretches(pieces[i:j], length, gram)
                cut = [pieces[i + t][s : s + w + length - 1] for t, s, w in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True)]
                take = pa.array(text)
                arrays = [b[c].slice(i, j - i).take(take) for c in ("name", "digest", "weight")]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(cut, pa.binary())],
                    names=["of_name", "of_digest", "weight", "start", "windows", "name", "digest", "piece"],
                )

    return run


def _decided(pieces: DataFrame, length: int, grams: tuple[int, ...], parts: int, made: list[DataFrame]) -> DataFrame:
    """name, digest, spans of distinct stretches (name, digest, weight, piece) of names that have several; adds to
    ``made`` the tables it writes."""
    sizes = pieces.groupBy("name").agg(F.sum(F.octet_length("piece")).alias("bytes"))
    hot = materialize(sizes.filter(F.col("bytes") > HOT).select("name"), "hot")
    made.append(hot)
    some = not hot.isEmpty()
    usual = pieces.join(hot, "name", "left_anti") if some else pieces
    out = usual.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_decide(length), "name bigint, digest bigint, spans array<int>")
    if not some:
        return out
    ddl = "of_name bigint, of_digest bigint, weight bigint, start int, windows int, name bigint, digest bigint, piece binary"
    finer = materialize(pieces.join(hot, "name", "left_semi").mapInArrow(_again(length, grams[0]), ddl), "finer")
    made.append(finer)
    distinct = finer.groupBy("name", "digest").agg(F.sum("weight").alias("weight"), F.min("piece").alias("piece"))
    by_name = distinct.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("weight").alias("n"))
    distinct = distinct.join(by_name.filter("n > 1"), "name")
    whole = F.array(F.lit(0), F.lit(1 << 30)).alias("spans")
    verdict = distinct.filter("kinds = 1").select("name", "digest", whole)
    if grams[1:]:
        made.append(materialize(distinct.filter("kinds > 1").select("name", "digest", "weight", "piece"), "pieces"))
        verdict = verdict.unionByName(_decided(made[-1], length, grams[1:], parts, made))
    moved = F.transform("spans", lambda x: F.col("start") + F.least(x, F.col("windows")))
    back = finer.join(verdict, ["name", "digest"]).select(F.col("of_name").alias("name"), F.col("of_digest").alias("digest"), moved.alias("spans"))
    return out.unionByName(back.groupBy("name", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated(rows: DataFrame, length: int) -> DataFrame:
    """row and windows (numbers of the first and the last-but-one window of each span of repeated windows, in pairs)
    of the rows (row, text; a stored table) that have any; written."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gram = max(1, length * 2 // 5)
    long = rows.filter(F.octet_length("text") >= length)
    stretch = materialize(long.mapInArrow(_stretch_rows(length, gram), STRETCH_DDL), "stretches")
    names = stretch.groupBy("name").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("n > 1")
    # written first: a join with an aggregate on its side isn't split at a hot name
    names = materialize(names.select("name", (F.col("lo") != F.col("hi")).alias("differ")), "names")
    met = materialize(stretch.join(names, "name"), "repeated")
    remove(stretch, names)
    several = met.filter("differ").groupBy("name", "digest").agg(F.count("*").alias("weight"), F.min(F.struct("row", "start", "windows")).alias("first"))
    by_row = several.select("name", "digest", "weight", "first.*").groupBy("row").agg(F.collect_list(F.struct("name", "digest", "weight", "start", "windows")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"name": [], "digest": [], "weight": [], "piece": []}
            for text, cuts in zip(b["text"].cast(pa.binary()).to_pylist(), b["cuts"].to_pylist(), strict=True):
                for c in cuts:
                    out["piece"].append(text[c["start"] : c["start"] + c["windows"] + length - 1])
                    for k in ("name", "digest", "weight"):
                        out[k].append(c[k])
            yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("name", "digest", "weight")), pa.array(out["piece"], pa.binary())], names=list(out))

    pieces = long.join(by_row, "row").select("text", "cuts").mapInArrow(cut, "name bigint, digest bigint, weight bigint, piece binary")
    pieces = materialize(pieces, "pieces")
    finer = tuple(g for g in (length * 3 // 4, length) if g > gram)
    made = [met, pieces]
    verdict = _decided(pieces, length, finer, parts, made).filter(F.size("spans") > 0)
    places = F.transform("spans", lambda x: F.col("start") + F.least(x, F.col("windows")))
    found = met.filter("differ").join(verdict, ["name", "digest"]).select("row", places.alias("spans"))
    found = found.unionByName(met.filter("not differ").select("row", F.array(F.col("start"), F.col("start") + F.col("windows")).alias("spans")))
    found = materialize(found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("windows")), "found")
    remove(*made)
    return found


def merged(windows: np.ndarray, length: int) -> np.ndarray:
    """Byte spans (begin, end) that the window spans (from, to) cover, in order and apart."""
    w = windows.reshape(-1, 2).astype(np.int64)
    w = w[np.argsort(w[:, 0], kind="stable")]
    end = np.maximum.accumulate(w[:, 1] - 1 + length)
    new = np.concatenate([[True], w[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([w[at, 0], np.append(end[at[1:] - 1], end[-1])], 1)


REMOVED_DDL = "struct<spans:array<bigint>,kept:binary,text:string>"
REMOVED = pa.struct([("spans", pa.list_(pa.int64())), ("kept", pa.binary()), ("text", pa.string())])


def remove_repeated(documents: DataFrame, length: int = 400, text_col: str = "text", out_col: str = "removed") -> DataFrame:
    """``documents`` with ``out_col``: spans (begin and end of each removed run, in bytes), kept (the other bytes) and
    text (kept without characters that are cut) of each row that loses something, null for others."""
    bounded_batches(documents.sparkSession)
    row = unused(documents, "row")
    windows = unused(documents, "windows")
    numbered = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = repeated(numbered.select(F.col(row).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length)

    def keep(texts: pa.Array, found_windows: pa.Array) -> pa.Array:
        spans, kept, left = [], [], []
        for text, w in zip(encoded(texts), found_windows.to_pylist(), strict=True):
            if w is None:
                for c in (spans, kept, left):
                    c.append(None)
                continue
            s = merged(np.array(w), length)
            parts = [text[i:j] for i, j in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(text)], strict=True)]
            spans.append(s.ravel().tolist())
            kept.append(b"".join(parts))
            left.append("".join([p.decode("utf-8", "ignore") for p in parts]))
        columns = [pa.array(c, f.type) for c, f in zip((spans, kept, left), REMOVED, strict=True)]
        return pa.StructArray.from_arrays(columns, fields=list(REMOVED), mask=pa.array([k is None for k in kept], pa.bool_()))

    rows = numbered.join(found.select(F.col("row").alias(row), F.col("windows").alias(windows)), row, "left")
    touched = F.when(F.col(windows).isNotNull(), F.col(text_col))
    return rows.select(*documents.columns, F.arrow_udf(keep, REMOVED_DDL)(touched, F.col(windows)).alias(out_col))


def digests(documents: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and remaining text of every document."""
    found = remove_repeated(documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length)
    some, n_bytes = F.col("removed").isNotNull(), F.octet_length("text").cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"),
        F.when(some, n_bytes - F.octet_length("removed.kept")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.size("removed.spans") / 2).otherwise(0).cast("long").alias("n_spans"),
        F.when(some, F.sha2("removed.kept", 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        F.coalesce("removed.text", "text").alias("text"),
    )
