"""Helpers for functions over columns of texts that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised step holds at once; its arrays take some tens of times that.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch; Spark's default of 10,000 texts with what is made of them would fill a worker.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Let texts go to Python workers BATCH_ROWS at a time, unless the session sets fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def encoded(texts: pa.Array, null: bytes | None = b"") -> list[bytes | None]:
    """UTF-8 bytes of each text; ``null`` for nulls."""
    values = pa.array(texts).cast(pa.large_binary()).to_pylist()
    return [null if v is None else v for v in values]


def chunks(values: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of ``values`` with at most ``limit`` bytes, or one longer value."""
    i, total = 0, 0
    for j, v in enumerate(values):
        if j > i and total + len(v) > limit:
            yield i, j
            i, total = j, 0
        total += len(v)
    if i < len(values):
        yield i, len(values)


def joined(values: list[bytes], before: bytes = b"", after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All values in one byte array, and the places where each begins and the last ends."""
    extra = len(before) + len(after)
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) + extra for v in values], out=starts[1:])
    return np.frombuffer(b"".join(before + v + after for v in values) if extra else b"".join(values), np.uint8), starts


def struct_array(schema: pa.StructType, columns: dict[str, list | np.ndarray]) -> pa.StructArray:
    fields = list(schema)
    return pa.StructArray.from_arrays([pa.array(columns[f.name], type=f.type) for f in fields], fields=fields)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a uint64 array."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, np.ndarray] = {}
#: Powers up to this many stay in memory.
_KEPT = 1 << 22


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; base is odd and so has an inverse. Not to be written to."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _powers(max(n, 1 << 12), base)
        if n <= _KEPT:
            _POWERS[base] = have
    return have[:n]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    step = np.array([base], np.uint64)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        step = step * step
        done += take
    return out
