"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes what the one before kept, as a table that is written and read again.
All but the last return the columns of documents. Null and empty texts pass all stages
but the first, which rejects them as being in no language; an empty table stays empty.
Columns that the stages add inside avoid the names that documents have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdecide.llm import bpe, decontaminate, langid, neardup, suffix
from sparkdecide.llm.catalog import tokenizer_path
from sparkdecide.llm.texts import bounded_batches, unused
from sparkdecide.storage import replaced, table

#: Shortest repeated string that is removed, in bytes: less than 50 words of the shortest usual length.
REPEATED_BYTES = 250


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; others go. Raises ValueError if there are documents but no labelled one."""
    labelled = docs.filter("lang is not null and text is not null")
    if labelled.isEmpty():
        if docs.isEmpty():
            return docs
        raise ValueError("no labelled texts to learn languages from")
    bounded_batches(spark)
    model = langid.fit(labelled)
    p = unused(docs, "predicted")
    return docs.withColumn(p, langid.prediction(F.col("text"), model)).filter(~F.col(f"{p}.rejected")).drop(p)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the lowest doc_id, of each group of near-duplicates on five-word shingles.

    Of rows with one doc_id that with the lowest hash of its columns stays; rows without doc_id all stay.
    """
    own, rank = unused(docs, "own_id"), unused(docs, "rank")
    gone = neardup.near_duplicates(docs, words=5).filter("not kept").select(F.col("doc_id").alias(own)).distinct()
    rest = docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
    rest = rest.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))))
    return rest.filter(F.col("doc_id").isNull() | (F.col(rank) == 1)).drop(rank)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of REPEATED_BYTES or more that stand anywhere else out of the texts; a cut character goes whole."""
    r = unused(docs, "removed")
    some = F.col(r).isNotNull()
    changed = {"text": F.when(some, F.col(f"{r}.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length(f"{r}.text").cast("long")).otherwise(F.col("n_chars"))
    return suffix.remove_repeated(docs, REPEATED_BYTES, out_col=r).withColumns(changed).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the benchmark, verbatim or re-parameterised."""
    own = unused(docs, "own_id")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, how many they are, and the digest of what they decode to."""
    d = unused(docs, "decoded")
    ids = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), decoded_col=d)
    return ids.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(d, 256)}).drop(d)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", decontaminate_benchmark),
    ("BPE encoding and decoding", encode),
]

#: Fitted models and suffix intervals have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        docs = kept if k == len(STAGES) - 1 else replaced(docs, kept, f"stage{k + 1}")
    return docs
