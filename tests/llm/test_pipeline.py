import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marginlake.llm import bpe, mixing
from marginlake.llm.common import store, table
from tests.llm.frames import SCHEMA, odd_docs, odd_rows
from tests.llm.test_neardup import brute as groups
from tests.llm.test_substrings import brute as passages


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage."""
    docs, out = table(spark, sf, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = store(f(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language", "near_duplicates", "substrings", "mixing", "tokens"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_rejects_what_has_no_letters(stages):
    _, before, after = stages[0]
    letters = {i for i, t in pairs(before) if any(c.isalpha() for c in t or "")}
    assert {i for i, _ in pairs(after)} == letters
    assert after.filter("lang is null").count() == 0


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    want = {i for i, _, c in groups(pairs(before), corpus_pipeline.NEAR_PERCENT) if i == c}
    assert {i for i, _ in pairs(after)} == want < {i for i, _ in pairs(before)}


def test_passages_are_cut(stages):
    _, before, after = stages[2]
    want = {(i, k.decode()) for i, n, g, k in passages(pairs(before)) if n > g or not g}
    assert {(i, " ".join(t.split())) for i, t in pairs(after)} == want
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_mixture_has_the_words_that_take_says(stages):
    _, before, after = stages[3]
    want = {(r["doc_id"], r["taken"]) for r in mixing.take(before).collect() if r["taken"]}
    words = after.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {(r["doc_id"], r["n"]) for r in words.collect()} == want


def test_tokens_are_those_of_the_texts(stages):
    _, before, after = stages[4]
    judge = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    want = sorted((i, judge.encode_ordinary(t)) for i, t in pairs(before))
    assert sorted((r["doc_id"], r["ids"]) for r in after.collect()) == want
    assert after.filter("not exact").count() == 0


def test_run_equals_the_stages(spark, sf, stages):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(stages[-1][2])


def test_odd_documents_pass_all_stages(spark, tmp_path):
    for name, docs in (("odd", odd_docs(spark)), ("none", spark.createDataFrame([], SCHEMA))):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r["exact"] for r in rows)
        assert {r["doc_id"] for r in rows} <= {r[0] for r in odd_rows()}
        assert bool(rows) == (name == "odd")
