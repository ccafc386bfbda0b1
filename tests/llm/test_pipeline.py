"""The pipeline's first stage where nothing can be learned."""

import pytest

import corpus_pipeline


def test_pipeline_needs_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labelled"):
        corpus_pipeline.identify_language(spark, docs, "")
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0
