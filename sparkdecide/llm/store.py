"""Content-addressed store of token ids.

Each document's ids (with an end id) are cut into chunks where a rolling hash over
the last ids has a fixed form, so equal passages give equal chunks wherever they
stand. A chunk's address is a digest of its bytes. The store is one table, written
in ascending order of doc_id:

* ``doc`` rows: a document's recipe (addresses and lengths of its chunks), the Merkle
  root over the addresses, and the bytes of the chunks that occur nowhere else;
* ``chunk`` rows: a chunk that occurs more than once, stored once, beside the
  document that has it first;
* ``pack`` rows: the manifest of a file: the Merkle root over its documents' roots;
* a ``store`` row: the number of files and a digest over their manifests, in order.

Reading puts documents together again and checks every chunk against its address,
every recipe against its root, the roots of a file against its manifest, and the files
against the store's. A missing chunk, document, file or manifest raises ValueError like a changed one.

Defined results: a null text is an empty text, and its ids are the end id alone.
Repeated doc_ids are stored one after the other, by row number. Null doc_ids come
first. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from . import bpe
from .texts import bounded_batches, mixed, powers

#: Units that an encoding worker remembers here, where encoding is most of the work.
REMEMBERED = 600_000
WINDOW, AVERAGE, LEAST, MOST = 16, 256, 64, 1024
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_MIXED = mixed(np.arange(1, (1 << 17) + 1, dtype=np.uint64))


def places(ids: np.ndarray) -> np.ndarray:
    """Positions where the rolling hash of the WINDOW ids before has its form.

    The hash doesn't depend on the position, so streams can be put one after the other;
    a chunk is longer than the window, so what a window has from the stream before never counts.
    """
    n = len(ids)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    values = _MIXED[ids] if int(ids.max()) < len(_MIXED) else mixed(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n, _BASE), out=total[1:])
    window = (total[WINDOW:] - total[:-WINDOW]) * powers(n - WINDOW + 1, _INVERSE)
    window *= np.uint64(0xFF51AFD7ED558CCD)
    return np.flatnonzero(window < np.uint64((1 << 64) // AVERAGE)) + WINDOW


def ends_of(places_: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids: LEAST to MOST ids long (the last may be shorter)."""
    ends, at = [], 0
    for place in [*places_, n]:
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST and place < n:
            ends.append(place)
            at = place
    return [*ends, n] if n > at else ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    return ends_of(places(ids).tolist(), len(ids))


def address(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


class Merkle:
    """Root over a stream of digests; holds one digest for each level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, digest: bytes) -> None:
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = digest
                return
            digest, self.levels[k] = hashlib.sha256(b"\1" + held + digest).digest(), None
        self.levels.append(digest)

    def root(self) -> bytes:
        out = None
        for held in self.levels:
            if held is not None:
                out = held if out is None else hashlib.sha256(b"\1" + held + out).digest()
        return out or hashlib.sha256(b"").digest()


def merkle_root(digests: list[bytes]) -> bytes:
    tree = Merkle()
    for d in digests:
        tree.add(d)
    return tree.root()


ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("addresses", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
ENCODED_DDL = "row bigint, doc_id bigint, addresses array<binary>, lengths array<int>, ids binary"
STORE_DDL = "kind string, doc_id bigint, row bigint, n_tokens bigint, addresses array<binary>, lengths array<int>, inline array<boolean>, root binary, address binary, ids binary"
STORE = pa.schema(
    [
        ("kind", pa.string()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("addresses", pa.list_(pa.binary())),
        ("lengths", pa.list_(pa.int32())), ("inline", pa.list_(pa.bool_())), ("root", pa.binary()), ("address", pa.binary()), ("ids", pa.binary()),
    ]
)


def _width(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def encode_documents(documents: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """row, doc_id, addresses, lengths and ids (bytes) of each document, written once."""
    bounded_batches(documents.sparkSession)
    width = _width(bpe.encoder(path).tokenizer.get_vocab_size(with_added_tokens=True))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, size = bpe.encoder(path, REMEMBERED), np.uint32(end_id).tobytes(), np.dtype(width).itemsize
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            for i, j in bpe._some(texts):
                coded = [raw + end for raw in e.encode(texts[i:j])]
                ids = np.frombuffer(b"".join(coded), np.uint32)
                data = ids.astype(width).tobytes()
                starts = np.zeros(len(coded) + 1, np.int64)
                np.cumsum([len(c) // 4 for c in coded], out=starts[1:])
                found = places(ids)
                first = np.searchsorted(found, starts).tolist()
                found, starts = found.tolist(), starts.tolist()
                out = {"addresses": [], "lengths": [], "ids": []}
                for k, at in enumerate(starts[:-1]):
                    n = starts[k + 1] - at
                    ends = ends_of([p - at for p in found[first[k] : first[k + 1]]], n)
                    raw = data[at * size : (at + n) * size]
                    begins = [0, *ends[:-1]]
                    out["addresses"].append([address(raw[x * size : y * size]) for x, y in zip(begins, ends, strict=True)])
                    out["lengths"].append([y - x for x, y in zip(begins, ends, strict=True)])
                    out["ids"].append(raw)
                yield pa.RecordBatch.from_arrays([b["row"].slice(i, j - i), b["doc_id"].slice(i, j - i), *(pa.array(out[k], ENCODED.field(k).type) for k in ("addresses", "lengths", "ids"))], schema=ENCODED)

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(encode, ENCODED_DDL), "ids")


def write_store(encoded: DataFrame, width: type = np.uint16) -> DataFrame:
    """The store of encoded documents, in ascending order of doc_id; returns a scan of it with the file's number as ``pack``."""
    places = encoded.select("doc_id", "row", F.posexplode("addresses").alias("at", "address"))
    shared = places.groupBy("address").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first")).filter("n > 1").select("address", "first")
    shared = materialize(shared, "shared")
    # 1: elsewhere in the store; 2: shared, and stored beside this document
    marks = places.join(shared, "address").select("doc_id", "row", "at", (F.struct("doc_id", "row", "at").eqNullSafe(F.col("first"))).alias("owner"))
    marks = marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "owner")).alias("marks"))
    nothing = {"addresses": "array<binary>", "lengths": "array<int>", "ids": "binary"}
    both = marks.select("doc_id", "row", "marks", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).unionByName(
        encoded.select("doc_id", "row", F.lit(None).cast("array<struct<at:int,owner:boolean>>").alias("marks"), *nothing)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size, held = Merkle(), np.dtype(width).itemsize, (None, {})
        for b in batches:
            docs: dict[str, list] = {k: [] for k in ("doc_id", "row", "n_tokens", "addresses", "lengths", "inline", "root", "ids")}
            chunks: dict[str, list] = {k: [] for k in ("doc_id", "row", "address", "ids")}
            for row, doc_id, marked, addresses, lengths, ids in zip(*(b[c].to_pylist() for c in ("row", "doc_id", "marks", "addresses", "lengths", "ids")), strict=True):
                if addresses is None:
                    held = (row, {m["at"]: m["owner"] for m in marked})
                    continue
                marks = held[1] if held[0] == row else {}
                n = len(ids) // size
                if marks:
                    own, at = [], 0
                    for k, length in enumerate(lengths):
                        piece = ids[at * size : (at + length) * size]
                        at += length
                        if k not in marks:
                            own.append(piece)
                        elif marks[k]:
                            for c, v in zip(chunks.values(), (doc_id, row, addresses[k], piece), strict=True):
                                c.append(v)
                    ids = b"".join(own)
                root = merkle_root(addresses)
                tree.add(root)
                for c, v in zip(docs.values(), (doc_id, row, n, addresses, lengths, [k not in marks for k in range(len(lengths))], root, ids), strict=True):
                    c.append(v)
            for kind, part in (("chunk", chunks), ("doc", docs)):
                if n := len(part["row"]):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n) if f.name == "kind" else pa.array(part[f.name], f.type) if f.name in part else pa.nulls(n, f.type) for f in STORE], schema=STORE)
        if tree.levels:
            yield pa.RecordBatch.from_pylist([{"kind": "pack", "root": tree.root()}], schema=STORE)

    parts = max(8, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "row", F.col("addresses").isNotNull())
    packed = materialize(ordered.mapInArrow(pack, STORE_DDL).withColumn("pack", F.spark_partition_id()), "store")
    digest, n = _files(packed)
    top = packed.sparkSession.createDataFrame([("store", n, bytes.fromhex(digest), b"")], "kind string, n_tokens bigint, root binary, ids binary")
    rows = (F.lit(None).cast(f.dataType).alias(f.name) if f.name not in top.columns else F.col(f.name) for f in packed.schema)
    return packed.unionByName(materialize(top.select(*rows), "store-manifest"))


def _files(store: DataFrame) -> tuple[str, int]:
    """A digest over the numbers and roots of all files, in order, and how many they are. One row a file."""
    roots = store.filter("kind = 'pack'").select("pack", F.concat_ws(":", "pack", F.hex("root")).alias("told"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pack", "told"))), lambda x: x["told"]), ",")
    return roots.agg(F.sha2(told, 256), F.count("*")).first()


def verify_files(store: DataFrame) -> None:
    """Raises ValueError if the store's files are not those that its manifest names."""
    top = store.filter("kind = 'store'").select("n_tokens", "root").first()
    if top is None:
        raise ValueError("the manifest of the store is missing")
    digest, n = _files(store)
    if n != top.n_tokens:
        raise ValueError(f"the manifest of files names {top.n_tokens}, the store has {n}")
    if bytes.fromhex(digest) != bytes(top.root):
        raise ValueError("the files of the store differ from its manifest")


def starts(store: DataFrame) -> DataFrame:
    """row, start: ids of all documents before, from sums by pack and then within each pack.

    Each pack's documents are counted in order and their roots checked against its manifest.
    """
    verify_files(store)
    rows = store.select("pack", "doc_id", "row", "n_tokens", "kind", "root").filter("kind in ('doc', 'pack')")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, at, done = None, Merkle(), 0, True
        for b in batches:
            out: dict[str, list] = {"pack": [], "row": [], "inside": []}
            for pack, row, n, kind, root in zip(*(b[c].to_pylist() for c in ("pack", "row", "n_tokens", "kind", "root")), strict=True):
                if pack != now:
                    if not done:
                        raise ValueError(f"the manifest of file {now} is missing")
                    now, tree, at, done = pack, Merkle(), 0, False
                if kind == "pack":
                    if tree.root() != root:
                        raise ValueError(f"the documents of file {pack} differ from its manifest")
                    done = True
                    continue
                tree.add(root)
                for c, v in zip(out.values(), (pack, row, at), strict=True):
                    c.append(v)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(out["pack"], pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["inside"], pa.int64())], names=list(out))
        if not done:
            raise ValueError(f"the manifest of file {now} is missing")

    ordered = rows.repartition("pack").sortWithinPartitions("pack", F.col("kind") == "pack", "doc_id", "row")
    inside = ordered.mapInArrow(check, "pack int, row bigint, inside bigint")
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)  # one row a pack
    packs = rows.groupBy("pack").agg(F.sum("n_tokens").alias("n")).select("pack", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return inside.join(F.broadcast(packs), "pack").select("row", (F.col("offset") + F.col("inside")).alias("start"))


def read_store(store: DataFrame, width: type = np.uint16) -> DataFrame:
    """doc_id, row, n_tokens, ids (bytes of unsigned 32-bit little-endian integers) of all documents; raises ValueError if a digest differs."""
    verify_files(store)
    docs = store.filter("kind = 'doc'").select("doc_id", "row", "n_tokens", "addresses", "lengths", "inline", "root", "ids")
    alone = F.forall("inline", lambda x: x)
    chunks = store.filter("kind = 'chunk'").select("address", F.col("ids").alias("piece"))
    wanted = docs.filter(~alone).select("row", F.posexplode(F.arrays_zip("addresses", "inline")).alias("at", "c")).filter("not c.inline").select("row", "at", F.col("c.addresses").alias("address"))
    found = wanted.join(chunks, "address", "left").groupBy("row").agg(F.collect_list(F.struct("at", "piece")).alias("found"))
    none = F.lit(None).cast("array<struct<at:int,piece:binary>>").alias("found")
    whole = docs.filter(alone).withColumn("found", none).unionByName(docs.filter(~alone).join(found, "row"))
    size = np.dtype(width).itemsize

    def build(doc_id: int, addresses: list, lengths: list, inline: list, root: bytes, ids: bytes, found: list | None) -> bytes:
        at, pieces = 0, []
        more = {m["at"]: m["piece"] for m in found or ()}
        for k, (digest, n, own) in enumerate(zip(addresses, lengths, inline, strict=True)):
            if own:
                piece = ids[at : at + n * size]
                at += n * size
            else:
                piece = more.get(k)
            if piece is None:
                raise ValueError(f"chunk {k} of document {doc_id} is missing")
            if address(piece) != digest:
                raise ValueError(f"chunk {k} of document {doc_id} differs from its address")
            pieces.append(piece)
        if merkle_root(addresses) != root:
            raise ValueError(f"the recipe of document {doc_id} differs from its root")
        return np.frombuffer(b"".join(pieces), width).astype("<u4").tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                columns = (some[c].to_pylist() for c in ("doc_id", "addresses", "lengths", "inline", "root", "ids", "found"))
                whole_ids = [build(*r) for r in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["row"], some["n_tokens"], pa.array(whole_ids, pa.binary())], names=["doc_id", "row", "n_tokens", "ids"])

    return whole.mapInArrow(read, "doc_id bigint, row bigint, n_tokens bigint, ids binary")
