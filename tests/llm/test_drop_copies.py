"""Rows, not ids: what stays of repeated rows and of ids that several texts have."""

import random
from collections import Counter

import pytest

from marginlake.llm import neardup
from tests.llm.frames import SCHEMA, no_docs, odd_docs, row, sentence


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(21)
    a, b, c, d, e, f = (sentence(rnd, 40) for _ in range(6))
    rows = [
        row(1, a), row(1, a), row(1, a, "de"), row(2, a), row(2, a.upper()),
        row(1, b),  # another text of a kept id, a group of its own
        row(2, c), row(3, c), row(3, d),
        row(5, e), row(4, f), row(5, f),  # the second text of id 5 is a copy of 4
        row(None, sentence(random.Random(5), 9)), row(None, sentence(random.Random(5), 9)),
        row(6, ""), row(6, ""), row(7, ""), row(8, None), row(8, None), row(6, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = neardup.drop_copies(docs)
    assert kept.dtypes == docs.dtypes
    want = [(1, a), (1, b), (2, c), (3, d), (4, f), (5, e), (None, sentence(random.Random(5), 9)), (6, ""), (7, ""), (8, None), (6, None)]
    assert pairs(kept) == Counter(want)
    assert [r["lang"] for r in kept.collect() if r["text"] == a] == ["de"]


def test_one_id_with_two_texts_of_one_group_gives_one_row(spark):
    text = sentence(random.Random(3), 30)
    docs = spark.createDataFrame([row(1, text), row(1, text.upper()), row(1, text.upper()), row(2, text)], SCHEMA)
    assert neardup.drop_copies(docs).count() == 1


@pytest.mark.parametrize("percent", [80, 85])
def test_repeated_rows_of_the_odd_documents_go(spark, percent):
    got = pairs(neardup.drop_copies(odd_docs(spark), percent))
    assert set(got.values()) == {1}
    assert [i for i, _ in got].count(10) == 1
    assert neardup.drop_copies(no_docs(spark), percent).count() == 0
