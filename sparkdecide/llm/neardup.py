"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

A document's set is the distinct hashes of its word shingles. Documents with equal
sets are one class from the start. Each class has HASHES minimum hashes, read in ORDERS
sorted orders, each beginning at another place. Rows of an order whose common prefix has
DEPTH values or more are a region. The rows of a region are candidates of each other if
there are at most NEAR; a crowded region goes on to longer prefixes, each part as deep as
it has to be to hold NEAR rows, and neighbours in the sorted order, which have the
longest common prefixes, are candidates across the parts. Signatures of candidates are
compared, and those that agree in AGREE values tie their classes.

What crowded regions leave open is settled without a cap. Once all orders are through,
only rows outside the largest tied group of their region are open; they are compared with
all rows of the region, block by block. A crowded region with more than MANY open rows is
keyed again by the first DEPTH values of every other order, so that its parts are DEPTH
values deeper, and treated like the first regions, DEEPER times at most.

Each tied group is then confirmed exactly: texts of a group meet once, and all pairs
are decided on the full sets. A group above BLOCK documents or BLOCK_BYTES bytes is first
confirmed in sorted blocks, and then whatever is outside its largest component is compared
with all of the group, block by block. No group, region or candidate is capped.

Two documents with similarity 0.8 share a region with probability
1 - (1 - 0.8**DEPTH)**ORDERS, above 0.9999999, and pass the signature threshold with
a probability above 0.999999.

Defined results: null texts and texts without words have no shingles, are linked
with nothing and kept. Rows with one id are one document. A null id is kept and linked
with nothing. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, remove
from .components import components, reduced
from .texts import bounded_batches, chunks, encoded, joined, mixed, powers

ORDERS, DEPTH = 32, 4
HASHES = ORDERS * DEPTH
#: Agreeing values, of HASHES, from which two signatures are candidates: five standard deviations below similarity 0.8.
AGREE = 80
#: Rows of a region that are all compared; rows of a crowded one that a task holds, and how many two such chunks share.
NEAR, CHUNK, SHARED = 256, 2048, 64
#: Documents, and bytes of their texts, whose sets meet in one task.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Open rows of a crowded region that are compared with all its rows; how often a region with more is keyed again.
MANY, DEEPER = 16384, 2
#: Orders that are gone through first.
FIRST = 4
_RNG = np.random.default_rng(2024)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` words, A-Z lower-cased.

    A text with fewer words has their whole sequence as its one shingle.
    """
    b, starts = joined([t.lower() for t in texts], b"", b" ")
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b), _BASE), out=total[1:])
    word = mixed((total[end] - total[begin]) * powers(len(b) + 1, _INVERSE)[begin])
    first = np.searchsorted(begin, starts)
    grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        grams += mixed(word[k : k + len(grams)] + np.uint64(k * 0x51ED2705 + 1)) if len(grams) else grams
    grams = mixed(grams)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            s = np.sort(grams[i : j - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif j > i:
            h = np.uint64(j - i)
            with np.errstate(over="ignore"):
                for w in word[i:j]:
                    h = mixed(np.array([h ^ w], np.uint64))[0] + np.uint64(0x9E37)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes of a set that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        h = np.bitwise_xor.outer(s[i : i + 2048], _XOR)
        h *= _TIMES
        np.minimum(low, h.min(axis=0), out=low)
    return mixed(low)


def region_keys(sig: np.ndarray) -> np.ndarray:
    """One key an order: its number and the first DEPTH values."""
    parts = sig.reshape(ORDERS, DEPTH)
    key = np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(_BASE)
    for k in range(DEPTH):
        key = mixed(key ^ parts[:, k])
    return key.view(np.int64)


def forest_rows(documents: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, n_bytes, set_key, keys, sig of each row; written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = encoded(b["text"])
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j], words)
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([len(t) for t in texts[i:j]], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if g is None else region_keys(g) for g in sigs], pa.list_(pa.int64())),
                        pa.array([None if g is None else g.astype(np.uint8).tobytes() for g in sigs], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "n_bytes", "set_key", "keys", "sig"],
                )

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(docs.mapInArrow(rows, "doc_id bigint, n_shingles bigint, n_bytes bigint, set_key binary, keys array<bigint>, sig binary"), "signatures")


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None, overlap: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``key``; runs above ``most`` rows, or with a column ``n_bytes`` BLOCK_BYTES bytes, in
    blocks that share ``overlap`` rows, or a quarter of a block that is bounded by its bytes."""
    held: pa.Table | None = None

    def blocks(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        out = []
        while t.num_rows:
            n, share = min(most, t.num_rows), overlap
            if "n_bytes" in t.column_names:
                fit = int(np.searchsorted(np.cumsum(t["n_bytes"].slice(0, n).to_numpy()), BLOCK_BYTES, side="right"))
                if fit < n:
                    n = max(2, fit)
                    share = min(overlap, n // 4)
            if n >= t.num_rows:
                break
            out.append(t.slice(0, n))
            t = t.slice(n - max(1, share))
        return ([*out, t], t.slice(t.num_rows)) if last else (out, t)

    def parts(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
        ids = t[key].to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), t.num_rows]
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            ends = last or j < t.num_rows
            done, rest = blocks(t.slice(i, j - i), ends) if most else ([t.slice(i, j - i)] if ends else [], t.slice(i, j - i))
            out += done
            if not ends:
                return out, rest
        return out, None

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None and held.num_rows else t
        out, held = parts(t, False)
        yield from out
    if held is not None and held.num_rows:
        yield from parts(held, True)[0]


def prefix_parts(places: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of sorted rows (a value a column) with at most ``most`` rows and a common prefix, each as short as that allows.

    Rows with equal values stay in ranges of ``most``.
    """
    differs = places[1:] != places[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), places.shape[1])  # with the row before
    out, todo = [], [(0, len(places), 0)]
    while todo:
        i, j, depth = todo.pop()
        if j - i <= most:
            out.append((i, j))
        elif depth == places.shape[1]:
            out += [(k, min(k + most, j)) for k in range(i, j, most)]
        else:
            edges = [i, *(np.flatnonzero(common[i : j - 1] <= depth) + i + 1).tolist(), j]
            todo += [(x, y, depth + 1) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


EDGES = "a bigint, b bigint"


def edge_batch(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> pa.RecordBatch:
    """Distinct ties between different names."""
    both = np.unique(np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)], 1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def agreeing(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the rows that agree in AGREE values."""
    left, a, b = np.arange(len(sig)), [], []
    while len(left) > 1:  # grow one tree, then the next from what it didn't reach
        tree, rest = left[:1], left[1:]
        while len(tree) and len(rest):
            met, by = np.zeros(len(rest), bool), np.zeros(len(rest), np.int64)
            for t in tree:
                new = ((sig[rest] == sig[t]).sum(axis=1) >= AGREE) & ~met
                by[new] = t
                met |= new
            a.append(rest[met])
            b.append(by[met])
            tree, rest = rest[met], rest[~met]
        left = rest
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _signatures(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    names = g["name"].to_numpy()
    return names, np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint8).reshape(len(names), HASHES)


def region_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows of region, place, name, sig: names tied in each region."""
    for g in groups(batches, "region", CHUNK, SHARED):
        names, sig = _signatures(g)
        if len(names) <= NEAR:
            ends = [agreeing(sig)]
        else:
            places = np.frombuffer(b"".join(g["place"].to_pylist()), np.uint8).reshape(len(names), -1)
            ends = [(x + i, y + i) for i, j in prefix_parts(places, NEAR) for x, y in [agreeing(sig[i:j])]]
            next_to = np.flatnonzero((sig[1:] == sig[:-1]).sum(axis=1) >= AGREE)
            ends.append((next_to, next_to + 1))
        yield edge_batch(names[np.concatenate([x for x, _ in ends])], names[np.concatenate([y for _, y in ends])])


def open_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of run, query, name, sig by run: names that a query row of the run is tied to."""
    for g in groups(batches, "run"):
        names, sig = _signatures(g)
        a, b = [], []
        for q in np.flatnonzero(g["query"].to_numpy()):
            met = np.unique(names[(sig == sig[q]).sum(axis=1) >= AGREE])
            a.append(np.full(len(met), names[q]))
            b.append(met)
        if a:
            yield edge_batch(np.concatenate(a), np.concatenate(b))


def linked(sets: list[np.ndarray], rows: np.ndarray | None = None, share: int = 80) -> np.ndarray:
    """Which pairs (of ``rows`` with all, or of all) have 100 * intersection >= share * union."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    keep = n[place] > 1
    column = (np.cumsum(n > 1) - 1)[place[keep]]
    owner = owner[keep]
    rows = np.arange(len(sets)) if rows is None else rows
    both = np.zeros((len(rows), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, wide):
        i, j = np.searchsorted(column, [at, at + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[i:j], column[i:j] - at] = 1
        both += m[rows] @ m.T
    union = size[rows][:, None] + size[None, :] - both
    return (100 * both >= share * union) & (both > 0)


def stars(link: np.ndarray, names: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a table of all links: each name with the lowest it is connected with."""
    a, b = [], []
    left = np.ones(len(names), bool)
    while left.any():
        start = int(np.argmax(left))
        seen = np.zeros(len(names), bool)
        seen[start] = True
        fresh = np.array([start])
        while len(fresh):
            reach = link[fresh].any(axis=0) & ~seen
            fresh = np.flatnonzero(reach)
            seen |= reach
        left &= ~seen
        a += names[seen].tolist()
        b += [int(names[seen].min())] * int(seen.sum())
    return a, b


def _confirm(words: int, key: str, most: int | None = None, overlap: int = 0):
    """Ties between names of sorted rows with equal ``key`` by their full sets; with a column ``query`` of its rows with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, key, most, overlap):
            rows = np.flatnonzero(g["query"].to_numpy()) if "query" in g.column_names else None
            if g.num_rows < 2 or (rows is not None and not len(rows)):
                continue
            names, texts = g["name"].to_numpy(), encoded(g["text"])
            sets = [s for i, j in chunks(texts) for s in shingle_sets(texts[i:j], words)]
            link = linked(sets, rows)
            if rows is None:
                a, b = stars(link, names)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            else:
                x, y = np.nonzero(link)
                yield edge_batch(names[rows[x]], names[y])

    return run


def _salt(n: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")


def _cells(rows: DataFrame, key: str, *kept: str) -> DataFrame:
    """run, query, doc_id and ``kept``: rows of a key in ``blocks`` parts, query rows in ``queries`` parts, each part with each."""
    as_row = rows.select(key, "doc_id", *kept, _salt("blocks", 1).alias("b"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("q"), F.lit(False).alias("query"))
    as_query = rows.filter("query").select(key, "doc_id", *kept, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), _salt("queries", 2).alias("q"), F.lit(True).alias("query"))
    return as_row.unionByName(as_query).select(F.xxhash64(key, "b", "q").alias("run"), "query", "doc_id", *kept)


def _parts(of: Column, size: int) -> Column:
    return F.ceil(of / size).cast("int")


def near_duplicates(documents: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (lowest doc_id reachable over links), kept (doc_id is component_id)."""
    bounded_batches(documents.sparkSession)
    all_rows = forest_rows(documents, words, id_col, text_col)
    first = all_rows.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_bytes", "keys", "sig")).alias("r"))
    classes = materialize(first.select("set_key", "r.*"), "classes")
    group = materialize(_tied(classes), "groups")
    found = _confirmed(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), group, classes, words)
    out = materialize(
        all_rows.select("doc_id", "n_shingles", "set_key")
        .join(classes.select("set_key", F.col("doc_id").alias("first")).hint("merge"), "set_key", "left")
        .join(found.select(F.col("node").alias("first"), "component").hint("merge"), "first", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "first", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))),
        "near",
    )
    remove(all_rows, classes, group, found)
    return out


def _tied(classes: DataFrame) -> DataFrame:
    """doc_id, group of the classes that are tied to others."""
    keyed = classes.select("doc_id", F.posexplode("keys").alias("o", "region"))
    several = keyed.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(keyed.join(several.hint("merge"), "region").select("region", "o", "n", "doc_id"), "regions")
    # some orders tie most of what belongs together; of the others only regions matter that hold several groups by then
    tied = components(_ties(met.filter(F.col("o") < FIRST).withColumn("name", F.col("doc_id")), classes), True)
    group = tied.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    later = _named(met.filter(F.col("o") >= FIRST), group)
    group = _joined(group, _ties(_mixed_regions(later), classes))
    crowded = met.filter(F.col("n") > NEAR)
    if not crowded.isEmpty():
        more = _open(_named(crowded, group).select("region", F.array("o").alias("orders"), "doc_id", "name"), classes, DEEPER)
        if more is not None:
            group = _joined(group, more)
    remove(met)
    return group


def _named(rows: DataFrame, group: DataFrame) -> DataFrame:
    """``rows`` with ``name``: the group of their doc_id, or itself."""
    return rows.join(group.hint("merge"), "doc_id", "left").withColumn("name", F.coalesce("group", "doc_id")).drop("group")


def _mixed_regions(rows: DataFrame) -> DataFrame:
    """Rows of the regions that hold several names."""
    mixed_ = rows.groupBy("region").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select("region")
    return rows.join(mixed_.hint("merge"), "region")


def _joined(group: DataFrame, ties: DataFrame) -> DataFrame:
    """doc_id, group once groups are tied to each other and to documents that had none."""
    more = components(ties, True)
    renamed = group.join(more.select(F.col("node").alias("group"), "component").hint("merge"), "group", "left").select("doc_id", F.coalesce("component", "group").alias("group"))
    new = more.join(group.select(F.col("group").alias("node")).distinct().hint("merge"), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    out = materialize(renamed.unionByName(new), "groups")
    remove(group, more)
    return out


def _ties(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Ties a, b between names that the sorted orders bring together, a forest of each task; regions: region, o, doc_id, name."""
    place = F.substring(F.concat(F.expr(f"substring(sig, int(o * {DEPTH}) + {DEPTH + 1}, {HASHES})"), F.expr(f"substring(sig, 1, int(o * {DEPTH}))")), 1, 24)
    rows = regions.join(classes.select("doc_id", "sig").hint("merge"), "doc_id").select("region", place.alias("place"), "name", "sig")
    return rows.repartitionByRange("region", "place").sortWithinPartitions("region", "place").mapInArrow(reduced(region_ties), EDGES)


def _open(rows: DataFrame, classes: DataFrame, deeper: int) -> DataFrame | None:
    """Ties between names of crowded regions: all that rows outside a region's most frequent name have in their region.

    rows: region, orders (that made the region), doc_id, name.
    """
    sizes = rows.groupBy("region", "name").agg(F.count("*").alias("c"))
    main = sizes.groupBy("region").agg(F.sum("c").alias("n"), F.max(F.struct("c", "name")).alias("main")).filter("n > main.c")
    still = rows.join(main, "region").select("region", "orders", "doc_id", "name", "n", (F.col("n") - F.col("main.c")).alias("open"), (F.col("name") != F.col("main.name")).alias("query"))
    still = materialize(still, "open")
    if still.isEmpty():
        return None
    many = F.col("open") > MANY if deeper else F.lit(False)
    cut = still.filter(~many).withColumns({"blocks": _parts(F.col("n"), BLOCK), "queries": _parts(F.col("open"), BLOCK)})
    met = _cells(cut, "region", "name").join(classes.select("doc_id", "sig").hint("merge"), "doc_id").select("run", "query", "name", "sig")
    out = met.repartition("run").sortWithinPartitions("run").mapInArrow(reduced(open_ties), EDGES)
    again = still.filter(many)
    if not deeper or again.isEmpty():
        return out
    keyed = again.join(classes.select("doc_id", F.posexplode("keys").alias("o", "key")).hint("merge"), "doc_id").filter("not array_contains(orders, o)")
    keyed = keyed.select(F.xxhash64("region", "key").alias("region"), F.array_append("orders", F.col("o")).alias("orders"), "o", "doc_id", "name")
    finer = materialize(_mixed_regions(keyed), "regions")
    ties = materialize(_ties(finer, classes), "ties")
    merged = components(ties, True).select(F.col("node").alias("name"), "component")
    left = finer.join(merged.hint("merge"), "name", "left").withColumn("name", F.coalesce("component", "name")).select("region", "orders", "doc_id", "name")
    crowded = left.join(left.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > NEAR).select("region"), "region")
    out = out.unionByName(ties)
    rest = _open(crowded, classes, deeper - 1)
    return out if rest is None else out.unionByName(rest)


def _confirmed(texts: DataFrame, group: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """node, component of documents that are linked with others, decided on full sets within each group."""
    sized = group.join(classes.select("doc_id", "n_bytes").hint("merge"), "doc_id")
    sized = sized.join(sized.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).filter("n > 1"), "group")
    sized = sized.withColumn("blocks", F.greatest(_parts(F.col("n"), BLOCK), _parts(F.col("bytes"), BLOCK_BYTES)))
    texts = materialize(texts.join(sized.hint("merge"), "doc_id"), "texts")
    small = texts.filter("blocks = 1").select("group", F.col("doc_id").alias("name"), "text").repartition("group").sortWithinPartitions("group")
    # all of a small group met in one task, so its answer is final
    found = small.mapInArrow(_confirm(words, "group"), EDGES).select(F.col("a").alias("node"), F.col("b").alias("component"))
    large = texts.filter("blocks > 1").drop("bytes")
    if not large.isEmpty():
        found = found.unionByName(_confirmed_large(large, classes, words))
    out = materialize(found.groupBy("node").agg(F.min("component").alias("component")), "linked")
    remove(texts)
    return out


def _confirmed_large(large: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """node, component of groups of several blocks: in sorted blocks of three orders, then all that is outside the
    largest component of a group with all of the group, block by block."""
    sig = classes.select("doc_id", F.expr("transform(array(0, 40, 80), k -> concat(substring(sig, k + 1, 40), substring(sig, 1, k)))").alias("places"))
    rows = large.join(sig, "doc_id").select("group", "doc_id", "n_bytes", "text", F.posexplode("places").alias("o", "place"))
    rows = rows.select(F.xxhash64("group", "o").alias("run"), F.substring("place", 1, 24).alias("place"), F.col("doc_id").alias("name"), "n_bytes", "text")
    ordered = rows.repartitionByRange("run", "place").sortWithinPartitions("run", "place")
    known = components(ordered.mapInArrow(reduced(_confirm(words, "run", BLOCK // 2, BLOCK // 16)), EDGES), True)
    known = known.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    named = materialize(_named(large.select(F.col("group").alias("of"), "n", "n_bytes", "blocks", "doc_id"), known), "named")
    sizes = named.groupBy("of", "name").agg(F.count("*").alias("c"), F.sum("n_bytes").alias("bytes"))
    main = sizes.groupBy("of").agg(F.max(F.struct("c", "name", "bytes")).alias("main"), F.sum("bytes").alias("all_bytes"))
    rest = named.join(main, "of").filter("n > main.c")
    queries = F.greatest(_parts(F.col("n") - F.col("main.c"), BLOCK), _parts(F.col("all_bytes") - F.col("main.bytes"), BLOCK_BYTES), F.lit(1))
    cells = _cells(rest.select("of", "doc_id", "name", "blocks", queries.alias("queries"), (F.col("name") != F.col("main.name")).alias("query")), "of", "name")
    met = large.select("doc_id", "text").join(cells, "doc_id").select("run", "query", "name", "text").repartition("run").sortWithinPartitions("run")
    return _joined(known, met.mapInArrow(reduced(_confirm(words, "run")), EDGES)).select(F.col("doc_id").alias("node"), F.col("group").alias("component"))
