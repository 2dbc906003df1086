import hashlib
import math

import numpy as np
import pytest

from marginlake.llm import codes, queries
from marginlake.llm.common import table
from tests.oracle_check import compare, sql_connection

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, position string, text string"


def rows_of(vectors):
    return [(i, v, label, "x", "y", "z", None) for i, v, label in vectors]


def brute(vectors):
    """code, error, label_error by row; sha256 of the codebooks. Plain loops over whole numbers."""
    kept = [(i, v, lab) for i, v, lab in vectors if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    part = width // 8
    x = [[[math.floor(4096 * np.float32(c).item()) for c in v[p * part : (p + 1) * part]] for p in range(8)] for _, v, _ in kept]
    books = [[x[n][p] for n in range(min(16, len(x)))] for p in range(8)]

    def best(own, book):
        return min((sum((a - b) ** 2 for a, b in zip(own, entry)), e) for e, entry in enumerate(book))

    for _ in range(6):
        for p in range(8):
            at = [best(v[p], books[p])[1] for v in x]
            for e in set(at):
                own = [v[p] for v, a in zip(x, at) if a == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for (i, _, label), v in zip(kept, x):
        found = [best(v[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), error))
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return [(i, c, e, by_label[lab]) for i, lab, c, e in out], hashlib.sha256(text.encode()).hexdigest()


def check(found, vectors):
    want, sha = brute(vectors)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["codebooks_sha256"] for r in found} == ({sha} if want else set())


def cloud(n, width=16, seed=3):
    rnd = np.random.default_rng(seed)
    return [(int(i), rnd.normal(0, 0.2, width).astype(np.float32).tolist(), int(i) % 3) for i in range(n)]


def odd_vectors():
    ok = cloud(70)
    same = ok[9][1]
    return [
        *ok,
        *[(100 + i, same, None) for i in range(60)],  # a group of copies that holds a third of all rows
        (3, same, 1),
        (3, same, 1),
        (None, ok[5][1], None),
        (None, ok[5][1], None),
        (-7, [0.0] * 16, 2),
        (200, None, 1),
        (201, [], 1),
        (202, [None] * 16, 1),
        (203, [float("nan")] * 16, 1),
        (204, [float("inf")] + [0.0] * 15, 1),
        (205, [1.0] * 8, 1),
        (206, [1.0] * 17, 1),
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_vectors(spark, parts):
    df = spark.createDataFrame(rows_of(odd_vectors()), SCHEMA).repartition(parts)
    check(codes.compress(df).collect(), odd_vectors())


def test_few_vectors_and_none(spark):
    check(codes.compress(spark.createDataFrame(rows_of(cloud(5)), SCHEMA)).collect(), cloud(5))
    for vectors in ([], [(1, None, 1)]):
        found = codes.compress(spark.createDataFrame(rows_of(vectors), SCHEMA))
        assert found.collect() == []
        assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_huge_components(spark):
    vectors = [(i, [(-1.0) ** i * 3e38] * 16, 1) for i in range(20)] + cloud(4)
    found = codes.compress(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()
    assert len(found) == 24 and all(r["error"] >= 0 for r in found)


def test_salted_owners_agree(spark):
    df = spark.createDataFrame(rows_of(cloud(300)), SCHEMA).repartition(5)
    one, many = codes.train(df), codes.train(df, members=20)
    assert one.sha256() == many.sha256() == brute(cloud(300))[1]


def test_only_parts_that_change_entry_move(spark, monkeypatch):
    stored = []
    keep = codes.store

    def watched(df, name, **how):
        out = keep(df, name, **how)
        if name.startswith("members"):
            stored.append(out.filter("part is not null").count())
        return out

    monkeypatch.setattr(codes, "store", watched)
    codes.train(spark.createDataFrame(rows_of(cloud(400)), SCHEMA))
    assert stored[0] == 400 * codes.PARTS
    assert len(stored) == codes.ROUNDS and all(later < stored[0] / 2 for later in stored[1:])


def test_query_against_sql_and_brute_force(spark, sf):
    assert compare(spark, sql_connection(sf), "op13", queries.op13_vector_codes, queries.ORACLE["op13_vector_codes"], sf) is None
    rows = table(spark, sf, "embeddings").collect()
    check(queries.op13_vector_codes(spark, sf).collect(), [(r["vec_id"], r["embedding"], r["label"]) for r in rows])
