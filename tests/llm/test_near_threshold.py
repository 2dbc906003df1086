"""The pipeline's near-duplicate stage against brute force at its own threshold."""

import random

import corpus_pipeline
from marginlake.llm import neardup
from tests.llm.frames import SCHEMA, row
from tests.llm.test_neardup import family, shingle_set


def kept(rows, percent):
    """Ids that stay, and how many pairs of different sets are linked; ids are distinct and not null."""
    sets = sorted((len(s), i, s) for i, s in ((i, shingle_set(t)) for i, t in rows) if s)
    up, close = {i: i for i, _ in rows}, 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (n, i, a) in enumerate(sets):
        for m, j, b in sets[k + 1 :]:
            if 100 * n < percent * m:
                break
            if 100 * len(a & b) >= percent * len(a | b):
                close += a != b
                i_, j_ = sorted((root(i), root(j)))
                up[j_] = i_
    return {i for i in up if root(i) == i}, close


def test_stage_joins_pairs_from_80_percent(spark):
    rnd = random.Random(12)
    rows = family(rnd, 1, 40, 2, 100) + family(rnd, 100, 30, 3, 150) + family(rnd, 200, 30, 1, 48)
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(4)
    want, close = kept(rows, 80)
    assert close > kept(rows, 85)[1] and want != kept(rows, 85)[0]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == sorted(want)
    assert sorted(r["doc_id"] for r in neardup.near_duplicates(docs).filter("kept").collect()) == sorted(kept(rows, 85)[0])


def test_stage_equals_brute_force_on_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, close = kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 80)
    assert close >= 5
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == sorted(want)


def test_bands_rarely_miss_a_pair_at_the_threshold():
    assert neardup.banding(85) == (32, 6)
    for percent in (50, 70, 80, 85, 95, 100):
        count, bins = neardup.banding(percent)
        assert (1 - (min(percent, 99) / 100) ** bins) ** count <= neardup.MISS and count * bins < 256
