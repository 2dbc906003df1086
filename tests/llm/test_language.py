import random

import numpy as np
from pyspark.sql import functions as F

from marginlake.llm import language, queries
from marginlake.llm.recurrent import ByteTagger
from tests.llm.frames import SCHEMA, no_docs, odd_docs, odd_rows, row


def words_of(rnd, parts, n):
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=120):
    rnd = random.Random(3)
    parts = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ción", "os", "ar", "que", "ll"], "cc": ["sch", "ein", "ung", "ß", "ü"]}
    return [row(i, words_of(rnd, parts[k], rnd.randint(1, 200)), k) for i, k in enumerate(random.Random(1).choices(list(parts), k=n))]


def test_gradients_equal_finite_differences():
    model = ByteTagger(["a", "b", "c"], units=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = model.gradients(x, y)
    for name, p in model.params.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name[0] == "E":
                at = (at[0], int(x[0, 0]))
            keep, step = p[at], 1e-4
            p[at] = keep + step
            up = model.gradients(x, y)[0]
            p[at] = keep - step
            down = model.gradients(x, y)[0]
            p[at] = keep
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3


def test_reading_equals_plain_steps():
    model = ByteTagger(["a", "b"], units=4)
    x = np.random.default_rng(1).integers(0, 256, (7, 3)).astype(np.uint8)
    for d in "fb":
        assert np.allclose(model._read(x, d), model._forward(x, d)[0], atol=1e-5)


def test_every_byte_is_read_once():
    pieces, filled, owner = language.cut_pieces([b"abcde", b"", b"xy", b"12345678"], 4)
    assert [bytes(p[:f]) for p, f in zip(pieces, filled)] == [b"abcd", b"e", b"xy", b"1234", b"5678"]
    assert owner.tolist() == [0, 0, 2, 3, 3]


def test_pooled_is_the_mean_over_positions():
    model = ByteTagger(["a", "b"], units=4)
    texts = [b"some text that is longer than one piece of the network, which reads ninety-six bytes at a time, or so", b"x", b""]
    pooled = language.pooled(model, texts)
    pieces, filled, owner = language.cut_pieces(texts, language.PIECE_BYTES)
    prob = model.probabilities(np.ascontiguousarray(pieces.T))
    for k, t in enumerate(texts[:2]):
        own = np.concatenate([prob[: filled[i], :, i] for i in np.flatnonzero(owner == k)])
        assert len(own) == len(t) and np.allclose(own.mean(axis=0), pooled[k], atol=1e-5)
    assert not pooled[2].any()


def test_held_out_documents_are_recognised_and_not_learned_from(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    learned = {r["text"] for r in language.sample(docs).collect()}
    out = docs.filter(language.held_out(F.col("doc_id")))
    assert out.count() > 15
    assert not any(r["text"][:50] in t for r in out.collect() for t in learned if len(r["text"]) > 100)
    model = language.fit(docs)
    rows = language.identify(out, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    # Labels, sources and ids are no inputs of a prediction.
    other = out.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("?"))
    assert sorted((r["text"], r["lang_pred"], r["score"]) for r in rows) == sorted(
        (r["text"], r["lang_pred"], r["score"]) for r in language.identify(other, model).collect()
    )


def test_spans_find_the_place_where_the_language_changes(spark):
    model = language.train([(r[1].encode(), r[2]) for r in corpus(200)])
    rnd = random.Random(8)
    first, second = words_of(rnd, ["th", "er", "on", "an", "re"], 30), words_of(rnd, ["sch", "ein", "ung", "ß"], 30)
    text = (first + " " + second).encode()
    runs = language.spans(model, text)
    assert runs[0][0] == 0 and runs[-1][1] == len(text)
    label = np.concatenate([[name] * (b - a) for a, b, name in runs])
    cut = len(first.encode())
    assert np.mean(label[:cut] == "aa") > 0.9 and np.mean(label[cut:] == "cc") > 0.9


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = language.identify(docs, language.fit(docs)).collect()
    assert len(rows) == len(odd_rows())
    labels = {r[2] for r in odd_rows()} - {None}
    for r in rows:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0.0) == blank
        assert blank or r["lang_pred"] in labels
        assert 0 <= r["score"] <= 1 and r["key"] == "k"


def test_nothing_to_learn_from(spark):
    assert language.fit(no_docs(spark)) is None
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language.fit(unlabelled)
    assert model is None
    assert {(r["lang_pred"], r["score"]) for r in language.identify(unlabelled, model).collect()} == {("und", 0.0)}
    assert language.identify(no_docs(spark), None).count() == 0


def test_accuracy_on_held_out_documents(spark):
    rows = queries.op1_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(out) > 0.98


def test_labels_of_short_texts_are_learned(spark):
    """A language whose texts are all shorter than a training piece, beside one with long texts."""
    rows = [row(i, "кот дом лес", "ru") for i in range(100)] + [row(1000 + i, "the cat sat on the mat and " * 9, "en") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    assert {(r["doc_id"] < 1000, r["lang_pred"]) for r in found.collect()} == {(True, "ru"), (False, "en")}


def test_padding_has_no_part_in_training():
    model = ByteTagger(["a", "b"], units=3)
    rng = np.random.default_rng(2)
    x, y, filled = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([0, 1, 0, 1]), np.array([6, 3, 1, 6])
    loss, grads = model.gradients(x, y, filled)
    own = [model.gradients(x[:, [k]], y[[k]], filled[[k]])[0] * filled[k] for k in range(4)]
    assert abs(loss - sum(own) / filled.sum()) < 1e-5
    assert set(grads) == set(model.params)
