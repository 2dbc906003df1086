import hashlib

import pytest

from marginlake.llm import fingerprints, minhash, queries
from tests.llm.frames import no_docs, odd_docs, odd_rows
from tests.llm.test_neardup import shingle_set


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs, within):
    """Result rows against brute force over (doc_id, text) in ring order; null ids first."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = sorted(
        (repr(i), len(t), hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest())
        for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1])
    )
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == want
    near = {}
    for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1]):
        near.setdefault(i, []).append((jaccard(t, fingerprints.edited(t, n)), jaccard(t, n)))
    for r in rows:
        assert min(abs(r["near_edited"] - e) + abs(r["near_next"] - x) for e, x in near[r["doc_id"]]) < within


def test_edit_takes_code_points():
    assert fingerprints.edited("abcdefgh", "XYZ") == "abcdefXY"
    assert fingerprints.edited("äöüßäöüß", "é") == "äöüßäöé"
    assert fingerprints.edited("abc", "XYZ") == "abc"
    assert fingerprints.edited("", "XYZ") == ""


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_odd_documents(spark, parts):
    docs = odd_docs(spark).repartition(parts)
    check(fingerprints.edit_report(docs).collect(), [(r[0], r[1]) for r in odd_rows()], 0.25)


def test_single_document_is_its_own_next(spark):
    rows = fingerprints.edit_report(odd_docs(spark).filter("doc_id = 1")).collect()
    assert len(rows) == 1 and rows[0]["near_next"] == 1.0


def test_empty_table(spark):
    assert fingerprints.edit_report(no_docs(spark)).count() == 0
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fingerprints.fingerprints(odd_docs(spark)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[2] == by_text[4]  # letter case does not count
    assert by_text[5] == by_text[6] == by_text[7] == {""}
    assert len(by_text[10]) == 1 and len(next(iter(by_text[10]))) == fingerprints.BINS * fingerprints.BITS // 4
    assert {r["key"] for r in rows} == {"k"}


def test_single_shingles_do_not_agree_by_chance():
    sets = [minhash.shingles(t) for t in ("one", "two", "three", "four", "five", "six")]
    packed = minhash.low_bits(minhash.signatures(sets, 512), 2)
    near = minhash.likeness(packed[:-1], packed[1:], 512, 2)
    assert near.max() < 0.15


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op8_fingerprints(spark, sf).collect(), docs, 0.25)
