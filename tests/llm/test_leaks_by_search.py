"""Decontamination of whole test tables against a plain search of every item in every document."""

import os
import re

import pandas as pd
import pytest

from sparkdecide.llm import catalog
from tests import oracle


def tokens(text):
    return re.findall(r"[a-z\u0080-\U0010ffff]+|[0-9]+", (text or "").lower())


def holds(doc, item):
    """Does the list ``doc`` hold ``item`` as a run?"""
    n = len(item)
    return any(doc[i : i + n] == item for i, x in enumerate(doc) if x == item[0]) if n else False


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
def test_op7_decontaminate_equals_a_plain_search(spark):
    docs = pd.read_parquet(f"{oracle.SF}/documents.parquet", columns=["doc_id", "text"])
    items = pd.read_parquet(f"{oracle.SF}/benchmark.parquet")
    found = catalog.op7_decontaminate(spark, oracle.SF).collect()
    reported = {(x.doc_id, x.item_id) for x in found}
    said = {d: tokens(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    asked = {i: tokens(t) for i, t in zip(items.item_id, items.text, strict=True)}
    verbatim = {(d, i) for d, text in said.items() for i, item in asked.items() if holds(text, item)}
    assert verbatim and verbatim <= reported
    # nothing is reported that doesn't share much with the item: half of its runs of four words, numbers aside
    for x in found:
        words = [["0" if w.isdigit() else w for w in side] for side in (said[x.doc_id], asked[x.item_id])]
        doc, item = (grams(w, min(4, len(words[1]))) for w in words)
        assert len(doc & item) >= 0.5 * len(item), x
