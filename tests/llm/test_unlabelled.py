"""Nothing to learn from is no reason to reject."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.frames import odd_docs, odd_rows


def test_an_unlabelled_corpus_keeps_its_lettered_texts(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    want = [r[0] for r in odd_rows() if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(repr, want)) == sorted(repr(r["doc_id"]) for r in kept.collect())
    assert kept.filter("lang is not null").count() == 0
