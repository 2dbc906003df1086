import random

import numpy as np
import pytest

from marginlake.llm import minhash, neardup, queries
from marginlake.llm.graph import components
from tests.llm.frames import SCHEMA, no_docs, odd_docs, odd_rows, row, sentence


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def test_odd_documents(spark):
    assert got(neardup.near_duplicates(odd_docs(spark).repartition(4))) == brute([(r[0], r[1]) for r in odd_rows()])


def test_empty_table(spark):
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def family(rnd, first, size, edits, words=80):
    """A base and copies with a few replaced words each: some linked only through others."""
    base = sentence(rnd, words).split()
    out = [(first, " ".join(base))]
    for k in range(1, size):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = sentence(rnd, 1)
        out.append((first + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_families_of_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STAR_MEMBERS", 7)
    rnd = random.Random(9)
    rows = family(rnd, 100, 60, 4) + family(rnd, 500, 30, 3, 30) + family(rnd, 700, 12, 2, 12)
    rnd.shuffle(rows)
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    want = brute(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows)
    assert got(neardup.near_duplicates(docs)) == want


def test_settle_finds_links_between_components_only():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 3, 6, 500, 504, 900)]
    data = [s.tobytes() for s in sets]
    nodes = [10, 11, 12, 13, 14, 15]
    assert neardup.settle(nodes, nodes, [0] * 6, data) == [(10, 11), (10, 12), (13, 14)]
    assert neardup.settle(nodes, [10, 10, 10, 13, 14, 15], [0] * 6, data) == [(13, 14)]
    assert neardup.settle(nodes, nodes, [0, 0, 1, 0, 1, 1], data) == [(10, 12), (11, 12), (13, 14)]


def test_linked_is_exact_at_the_threshold():
    a = np.arange(0, 100, dtype=np.uint64)
    assert neardup.linked(a, np.arange(0, 85, dtype=np.uint64))
    assert not neardup.linked(a, np.arange(0, 84, dtype=np.uint64))
    assert not neardup.linked(a, np.arange(9, 109, dtype=np.uint64))
    assert neardup.linked(a, np.arange(8, 108, dtype=np.uint64))


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 20, 400):
        near = []
        for _ in range(40):
            u = rng.integers(0, 1 << 62, n + n // 3).astype(np.uint64)
            s = minhash.signatures([u[:n], u[n // 3 :]], 192)
            assert not (s == minhash.EMPTY).any()
            near.append((s[0] == s[1]).mean())
        true = (n - n // 3) / (n + n // 3)
        assert abs(np.mean(near) - true) < 0.05
    assert (minhash.signatures([np.empty(0, np.uint64)], 8) == minhash.EMPTY).all()


def test_components_of_a_long_path(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(1000), 60)
    links = [(a, b) for a, b in zip(names[:40], names[1:40])] + [(a, a) for a in names[:3]] + list(zip(names[40:], names[41:]))
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    found = {(r["node"], r["component"]) for r in components(df).collect()}
    want = {(n, min(names[:40])) for n in names[:40]} | {(n, min(names[40:])) for n in names[40:]}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_copies_keeps_one_of_each_group(spark):
    docs = odd_docs(spark)
    kept = neardup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute([(r[0], r[1]) for r in odd_rows()]) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op4_near_duplicates(spark, sf)) == brute(rows)
