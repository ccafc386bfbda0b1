"""A passage that many documents share: its rows are joined by several tasks; and how long a passage has to be."""

import random

import pytest

from sparkdecide.llm import suffix

from .test_operators import DOCS, pool, removed_by_hand, words

SPLIT = {
    "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture
def small_parts(spark):
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_join_of_a_hot_name_is_split(small_parts, monkeypatch):
    spark, plans = small_parts, {}
    write = suffix.materialize

    def planned(df, name):
        if name == "repeated":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(suffix, "materialize", planned)
    r = random.Random(11)
    p = pool(r, 3000)
    hot = words(r, 30, p)[:64]  # few names
    texts = [f"{words(r, 4, p)} {hot} {words(r, 4, p)}" for _ in range(400)] + [words(r, 60, p) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(8)
    got = {x.doc_id: x for x in suffix.digests(docs, 60).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == removed_by_hand(texts, 60)
    assert "skew=true" in plans["repeated"]


@pytest.mark.parametrize("length", [250, 400])
def test_planted_passages_are_caught_from_the_length_on(spark, length):
    r = random.Random(12)
    p = pool(r, 3000)
    texts, planted = [words(r, 200, p) for _ in range(240)], {}
    for i in range(0, 200, 2):
        passage = words(r, r.randint(51, 80), p)
        for k in (i, i + 1):
            # unlike bytes at both ends, so that the passage alone is shared
            texts[k] = f"{texts[k]} {k % 2} {passage} {k % 2} {words(r, 20, p)}"
            planted[k] = len(passage) + 2
    got = {x.doc_id: x.n_removed for x in suffix.digests(spark.createDataFrame(list(enumerate(texts)), DOCS), length).collect()}
    assert got == {i: planted[i] if planted.get(i, 0) >= length else 0 for i in range(len(texts))}
    assert min(planted.values()) < 400 < max(planted.values())
