import math

import numpy as np
import pytest

from marginlake.llm import queries, vectors
from tests.oracle_check import compare, sql_connection

SCHEMA = "vec_id long, embedding array<float>, label int, node string, h1 string, keys string, size string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d", "e") for i, v in rows], SCHEMA)


def brute(rows):
    """(vec_id, n_links, component_id, kept) of every row, all pairs in memory."""
    ok = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    width = max([len(v) for (_, v), k in zip(rows, ok) if k], default=1)
    x = np.zeros((len(rows), width))
    for n, (_, v) in enumerate(rows):
        if ok[n]:
            x[n, : len(v)] = np.array(v, np.float32).astype(float)
            x[n] /= np.abs(x[n]).max()
            x[n] /= np.linalg.norm(x[n])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    component = list(range(len(rows)))
    for n in range(len(rows)):
        if component[n] == n:
            todo = [n]
            while todo:
                m = todo.pop()
                component[m] = n
                todo += [int(k) for k in np.flatnonzero(near[m]) if component[k] != n]
    least = {}
    for n, c in enumerate(component):
        if rows[n][0] is not None:
            least[c] = min(least.get(c, rows[n][0]), rows[n][0])
    return [
        (i, int(near[n].sum()), i if not ok[n] else least.get(component[n]), not ok[n] or i == least.get(component[n]))
        for n, (i, _) in enumerate(rows)
    ]


def check(df, rows):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(brute(rows), key=repr)


def beside(v, cosine, rnd):
    """A vector at this cosine to ``v``, in a direction of chance."""
    v = np.asarray(v, float) / np.linalg.norm(v)
    aside = rnd.normal(size=len(v))
    aside -= (aside @ v) * v
    return (cosine * v + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)).tolist()


def cloud(n, rnd, width=64):
    return rnd.normal(size=(n, width)).tolist()


def odd_vectors():
    rnd = np.random.default_rng(5)
    base = cloud(40, rnd)
    rows = list(enumerate(base))
    rows += [(100 + k, base[k]) for k in range(5)]  # equal vectors
    rows += [(200 + k, (np.array(base[k]) * 7.5).tolist()) for k in range(5)]  # the same direction
    rows += [(300 + k, beside(base[20], 0.99, rnd)) for k in range(15)]
    chain = [base[30]]
    for k in range(8):  # each near the one before only
        chain.append(beside(chain[-1], 0.96, rnd))
        rows.append((400 + k, chain[-1]))
    rows += [(500 + k, base[33]) for k in range(60)]  # a group of copies that holds a third of all rows
    rows += [(7, base[7]), (7, base[7]), (None, base[8]), (None, base[8]), (None, cloud(1, rnd)[0])]
    none = [0.0] * 64
    rows += [(600, None), (601, []), (602, none), (603, [None] * 64), (604, [float("nan")] * 64), (605, [float("inf")] * 64)]
    rows += [(606, [3e38] * 64), (607, [1e-38] * 64), (608, base[9][:20]), (609, base[9][:20] + [0.0] * 44), (610, [-0.0] * 64)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("parts", [1, 6])
def test_odd_vectors(spark, parts):
    rows = odd_vectors()
    check(vectors.near_duplicates(frame(spark, rows).repartition(parts)), rows)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """Near copies that fill a bucket: many blocks, every pair counted once."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rnd = np.random.default_rng(6)
    hub = cloud(1, rnd)[0]
    rows = list(enumerate([beside(hub, 0.985, rnd) for _ in range(300)] + cloud(150, rnd)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    found = vectors.near_duplicates(frame(spark, rows).repartition(4))
    got = {r["vec_id"]: r for r in found.collect()}
    for i, links, component, kept in brute(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links, component, kept)


def test_empty_table_and_nothing_valid(spark):
    assert vectors.near_duplicates(frame(spark, [])).collect() == []
    rows = [(1, None), (None, []), (3, [0.0, 0.0])]
    check(vectors.near_duplicates(frame(spark, rows)), rows)
    check(vectors.near_duplicates(frame(spark, [(5, [1.0, 2.0])])), [(5, [1.0, 2.0])])


def test_codes_are_balanced_and_near_pairs_share_a_table():
    """Pairs at the threshold, and pairs of vectors that all lie in one corner."""
    rnd = np.random.default_rng(8)
    for shift in (0.0, 0.5):
        sample = rnd.normal(size=(3000, 64)) + shift
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        hashing = vectors.fit(sample, 1_000_000)
        signs = hashing.signs(sample)
        assert abs(signs.mean(axis=0) - 0.5).max() < 0.1
        other = np.array([beside(v, 0.9501, rnd) for v in sample])
        theirs = hashing.signs(other)
        shared = (hashing.keys(signs) == hashing.keys(theirs)).any(axis=1)
        off = np.bitwise_count(hashing.first64(signs).view(np.uint64) ^ hashing.first64(theirs).view(np.uint64))
        assert (shared & (off <= hashing.near)).mean() > 0.99


def test_recall_against_brute_force(spark):
    """Rows of random pairs from the threshold upwards; no link below it."""
    rnd = np.random.default_rng(9)
    base = cloud(700, rnd)
    rows = list(enumerate(base)) + [(1000 + k, beside(v, 0.9501 + 0.00005 * k, rnd)) for k, v in enumerate(base)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    found = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    assert sum(want.values()) > 1300 and all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.99 * sum(want.values())


def test_query_against_sql(spark, sf):
    name = "op12_near_vectors"
    assert compare(spark, sql_connection(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf) is None
