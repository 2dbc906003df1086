import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marginlake.llm import bpe, queries
from tests.llm.frames import no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


def test_white_space_of_all_kinds_between_words(ranks, judge):
    rnd, encoder = random.Random(6), bpe.TextEncoder(ranks, PATTERN)
    gaps = [" "] * 6 + ["\n", "\n\n", "  ", " \n", "\n ", "\t", "\r\n", "\u00a0", " \u2003", "\x1c", "\x85"]
    texts = []
    for _ in range(400):
        words = [rnd.choice(["the", "cat,", "don't", "x1", "é.", "--", "'s", "42nd"]) for _ in range(rnd.randint(0, 9))]
        body = "".join(w + rnd.choice(gaps if rnd.random() < 0.5 else [" ", "\n"]) for w in words)
        texts.append(rnd.choice(["", " ", "\n"]) + (body if rnd.random() < 0.5 else body.strip(" ")))
    assert [x.tolist() for x in encoder.encode_all(texts)] == [judge.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters", ["ab", "aeiouthn ", "a", "\n \t.x=-", "0123456789abcdef", "éñü 漢字 ", "'stredvml A"])
def test_texts_encode_as_tiktoken_does(ranks, judge, letters):
    encoder, rnd = bpe.TextEncoder(ranks, PATTERN), random.Random(1)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [judge.encode_ordinary(t) for t in texts]


def test_every_kind_of_character_splits_as_tiktoken_does(ranks, judge):
    encoder = bpe.TextEncoder(ranks, PATTERN)
    for c in [*range(0x3100), *range(0x1F300, 0x1F700, 7)]:
        text = f"a{chr(c)}{chr(c)} b1{chr(c)}"
        assert encoder.encode(text).tolist() == judge.encode_ordinary(text), hex(c)


def test_long_run_of_one_letter(ranks, judge):
    assert bpe.TextEncoder(ranks, PATTERN).encode("a" * 5001).tolist() == judge.encode_ordinary("a" * 5001)


def test_appends_are_exact(vocabulary):
    rnd = random.Random(2)
    for _ in range(60):
        data = bytes(rnd.choice(b"abetrhingso") for _ in range(40))
        grown = bpe.PrefixTable(vocabulary)
        for i in range(0, 40, 7):
            grown.append(data[i : i + 7])
            assert grown.tokens() == vocabulary.merge(data[: i + 7])


def test_edits_are_exact_and_local(vocabulary):
    rnd = random.Random(3)
    for _ in range(40):
        data = bytes(rnd.choice(b"abetrhingso") for _ in range(60))
        a = rnd.randint(0, 50)
        b = rnd.randint(a, min(60, a + 5))
        new = bytes(rnd.choice(b"xyzing") for _ in range(rnd.randint(0, 6)))
        table = bpe.PrefixTable(vocabulary, data)
        table.edit(a, b, new)
        assert table.tokens() == vocabulary.merge(data[:a] + new + data[b:])
    long = b"".join(rnd.choice([b"ing", b"the", b"or"]) for _ in range(3000))
    table = bpe.PrefixTable(vocabulary, long)
    done = table.edit(100, 103, b"zz")
    assert done < 1000
    assert table.last == bpe.PrefixTable(vocabulary, long[:100] + b"zz" + long[103:]).last


def test_cache_generations_do_not_change_results(ranks, judge, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    encoder = bpe.TextEncoder(ranks, PATTERN)
    texts = ["the cat sat on the mat", "another cat, another mat", "the cat sat on the mat"] * 3
    for t in texts:
        assert encoder.encode(t).tolist() == judge.encode_ordinary(t)


def test_odd_documents_round_trip(spark, judge):
    coded = bpe.decode(bpe.encode(odd_docs(spark), PATH, PATTERN), PATH)
    rows = coded.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["ids"] == judge.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert (r["key"], r["size"]) == ("k", "big")
    at_once = bpe.encode(odd_docs(spark), PATH, PATTERN, decoded="decoded").select(coded.columns).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, rows))


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(no_docs(spark), PATH, PATTERN), PATH).count() == 0


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(None,), ([],), ([64],)], "ids array<int>")
    assert sorted(bytes(r["decoded"]) for r in bpe.decode(df, PATH).collect()) == [b"", b"", b"a"]


def test_unknown_id_fails(spark):
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), PATH).collect()


def test_query_equals_tiktoken(spark, sf, judge):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, sf).orderBy(F.col("doc_id")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = judge.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
