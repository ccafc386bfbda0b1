"""Bounded samples of labelled rows for fitting, and the rows' folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKETS = 1 << 20


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def sampled(ids: DataFrame, label: str, per_label: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id.

    One count by label is all that reaches the driver; the share kept of each label
    is per_label / count, or all where there are fewer.
    """
    counts = {r[0]: r[1] for r in ids.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_BUCKETS)) / F.lit(float(_BUCKETS))
    return ids.filter(place < share)
