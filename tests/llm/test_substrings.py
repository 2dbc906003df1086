import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginlake.llm import queries, substrings
from tests.llm.frames import no_docs, odd_docs, odd_rows, sentence

W = substrings.WINDOW


def brute(rows):
    """(doc_id, kept words, removed) of (doc_id, text); null ids are the least."""
    at = lambda i: -1 if i is None else i
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - W + 1):
            s = tuple(w[k : k + W])
            first[s] = min(first.get(s, at(i)), at(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - W + 1):
            if first[tuple(w[k : k + W])] < at(i):
                gone[k : k + W] = [True] * W
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], b" ".join((r["text"] or "").encode().split())) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [substrings.CHUNK_WORDS, 100])
def test_odd_documents(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    docs = odd_docs(spark).repartition(5)
    out = substrings.remove_repeats(docs)
    assert got(out) == brute([(r[0], r[1]) for r in odd_rows()])
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert out.filter("text is null").count() == 1
    assert {r["key"] for r in out.collect()} == {"k"}


def test_untouched_texts_stay_as_they_are(spark):
    out = {(r["doc_id"], r["text"]) for r in substrings.remove_repeats(odd_docs(spark)).filter("n_removed = 0").collect()}
    assert out <= {(r[0], r[1]) for r in odd_rows()}


def test_empty_table(spark):
    assert substrings.remove_repeats(no_docs(spark)).count() == 0


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """Two cells to a window at most: nearly all windows pass the prefilter, results stay."""
    monkeypatch.setattr(substrings, "LEAST_BITS", 10)
    monkeypatch.setattr(substrings, "MOST_BITS", 10)
    assert got(substrings.remove_repeats(odd_docs(spark))) == brute([(r[0], r[1]) for r in odd_rows()])


def test_sketch_never_counts_too_few(spark):
    docs = odd_docs(spark).repartition(6)
    bits = 14
    rows = [np.frombuffer(r, np.uint8) for r in substrings.sketch(docs, bits)]
    parts = docs.rdd.glom().map(lambda p: [r["text"] for r in p]).collect()
    seen = {}
    for k, part in enumerate(parts):
        for t in part:
            for w in substrings.windows(substrings.hashes(substrings.words(t)), W):
                seen.setdefault(int(w), set()).add(k)
    twice = np.array([w for w, s in seen.items() if len(s) > 1], np.uint64)
    assert len(twice) > 20 and substrings.maybe_repeated(twice, rows, bits).all()


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 10), (500, 1000), (500, 1 << 28), (3, 1 << 31)):
        x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        assert substrings.unpack(substrings.pack(x)).tolist() == x.tolist()


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_squeezed_numbers_come_back(n):
    rng = np.random.default_rng(1)
    for top in (1, 200, 1 << 20, 1 << 63):
        x = rng.integers(0, top, n).astype(np.uint64)
        assert substrings.unsqueeze(substrings.squeeze(x)).tolist() == x.tolist()
    x = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert substrings.unpack(substrings.pack(x)).tolist() == x.tolist()


def test_runs_have_the_positions():
    for x in ([0], [7], [0, 1, 2], [3, 3, 4, 9, 11, 12, 12], [0, 2, 4]):
        first, last = substrings.run_ends([substrings.runs(np.array(x, np.int32))] * 2)
        assert {p for a, b in zip(first, last) for p in range(a, b + 1)} == set(x)
    assert len(substrings.runs(np.arange(10_000, dtype=np.int32))) == 8


def test_texts_come_back():
    texts = ["", "a", "été 漢字 " * 500, None, "x"]
    assert [substrings.lengthen(x) for x in substrings.shorten(pa.array(texts)).to_pylist()] == texts


BIG = 1 << 62


def many_rows():
    """A text for each id, and most of them again far apart; ids wide apart and below zero."""
    rnd = random.Random(9)
    texts = [sentence(rnd, 300) for _ in range(150)]
    return [(i * 7 - 500 if i % 50 else i - BIG, t) for i, t in enumerate(texts + texts[:120])]


def bytes_of(df, *columns):
    return df.select(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]


def test_what_crosses_the_network_is_small(spark, monkeypatch):
    """A window that is grouped took 24 bytes before compression, one to be removed 4 and its share of a row."""
    monkeypatch.setattr(substrings, "LEAST_RANGES", 4)
    rows = many_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    everything = spark.sparkContext.broadcast([b"\xff" * 128] * substrings.ROWS)  # a full sketch, as of a large corpus
    keyed = substrings._keyed(docs, False)
    questions = substrings.asked(keyed, everything, 10, 4)
    n = len({w for _, t in rows for w in zip(*(t.split()[k:] for k in range(W)))})
    assert bytes_of(questions.filter("range >= 0"), "hash", "keys", "tags", "positions") < 13 * n
    # Copies of whole texts that a chunk settles are a run each.
    settled = questions.filter("range < 0")
    assert settled.count() == 120 and bytes_of(settled, "positions") == 8 * 120


@pytest.mark.parametrize("chunk", [substrings.CHUNK_WORDS, 2000])
def test_wide_ids_and_many_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    rows = many_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.remove_repeats(docs)
    got_rows = sorted((r["doc_id"], r["n_words"], r["n_removed"], b" ".join((r["text"] or "").encode().split())) for r in out.collect())
    order = {i: k for k, i in enumerate(sorted(i for i, _ in rows))}
    want = {k: x for k, *x in brute([(order[i], t) for i, t in rows])}
    assert got_rows == sorted((i, *want[order[i]]) for i, _ in rows)
    assert sum(r[2] for r in got_rows) == 120 * 300
    gone, tagged = substrings.repeated_windows(docs)
    assert not tagged and substrings.repeated_windows(docs.union(docs.limit(1)))[1]


def test_answers_are_a_row_for_a_document(spark, monkeypatch):
    """However many ranges its windows fall into."""
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 300)  # each text is a chunk: nothing is settled within
    docs = spark.createDataFrame(many_rows(), "doc_id long, text string")
    gone = substrings.repeated_windows(docs)[0].collect()
    assert len(gone) == len({r["key"] for r in gone}) == 120


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in brute(rows)}
    assert {tuple(r) for r in queries.op10_substrings(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want
    assert any(g for _, _, g, _ in want)
