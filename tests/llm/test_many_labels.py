"""Every label is learned, however many there are."""

from collections import Counter

import numpy as np

from marginlake.llm import language
from tests.llm.frames import SCHEMA, row


def corpus(labels, each):
    """Each label has letters of its own; later ones are rarer."""
    rows = []
    for k in range(labels):
        word = "".join(chr(0x4E00 + 9 * k + j) for j in range(9))
        rows += [row(1000 * k + i, f"{word} {i} {word}", f"l{k:03}") for i in range(each + (k < 40) * 5)]
    return rows


def test_labels_beyond_the_most_frequent_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "PASSES", 1)
    docs = spark.createDataFrame(corpus(90, 24), SCHEMA)
    model = language.fit(docs)
    assert model.labels == [f"l{k:03}" for k in range(90)]


def test_many_labels_have_fewer_documents_each(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 200)
    docs = spark.createDataFrame(corpus(90, 24), SCHEMA)
    each = Counter(r["lang"] for r in language.sample(docs).collect())
    assert len(each) == 90 and set(each.values()) == {2}
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 10)
    assert Counter(r["lang"] for r in language.sample(docs).collect()) == dict.fromkeys(each, 1)


def test_pieces_at_once_do_not_change_the_result(monkeypatch):
    model = language.ByteTagger(["a", "b", "c"], units=4)
    texts = [b"some text " * k for k in range(1, 40)]
    whole = language.pooled(model, texts)
    monkeypatch.setattr(language, "PIECE_LABELS", 21)
    assert np.allclose(language.pooled(model, texts), whole)
