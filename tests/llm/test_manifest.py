import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginlake.llm import manifest, queries
from tests.llm.frames import SCHEMA, no_docs, odd_docs, odd_rows, row
from tests.oracle_check import compare, sql_connection

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes, run=16):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + run]) for i in range(0, len(below), run)])
    return levels


def siblings(levels, at, run=16):
    out = []
    for level in levels[:-1]:
        first = at // run * run
        out.append([(d, i == at) for i, d in enumerate(level[first : first + run], first)])
        at //= run
    return out


def brute(rows):
    """Result columns of every row, from whole trees in memory."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for i, text, lang, source, n in rows:
        struck = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        other = text.translate(lower) if struck and text is not None else text
        found = leaf(i, source, lang, n, text)
        by_source.setdefault(source, []).append(((i is not None, i or 0, found), i, found, leaf(i, source, lang, n, other)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, i, found, claimed) in enumerate(sorted(by_source[s])):
            levels = siblings(trees[s], at) + siblings(top, k)
            proof = h(*[d for level in levels for d, own in level if not own])
            folded = claimed
            for level in levels:
                folded = h(*[folded if own else d for d, own in level])
            root = top[-1][0]
            out.append((i, found, trees[s][-1][0], root, proof, folded, folded == root))
    return out


def check(df, rows):
    got = sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def odd_tuples():
    return [r[:5] for r in odd_rows()]


@pytest.mark.parametrize("parts", [1, 6])
def test_odd_documents(spark, parts):
    check(manifest.manifest(odd_docs(spark).repartition(parts)), odd_tuples())


def test_empty_table_and_single_rows(spark):
    found = manifest.manifest(no_docs(spark))
    assert found.count() == 0 and set(COLUMNS) <= set(found.columns)
    one = [row(7, "Lone TEXT")]
    check(manifest.manifest(spark.createDataFrame(one, SCHEMA)), [one[0][:5]])


def sized(counts):
    rnd = random.Random(5)
    return [
        row(rnd.randrange(10**9), rnd.choice(["Some Text", None, "ÄÖ X", "low"]), "en", source)
        for source, n in counts.items()
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "counts",
    [
        {"a": 16, "b": 17, "c": 256, "d": 257, "e": 1, None: 272},
        # A hot source with three levels above its partitions' own, the last ones short; many small sources.
        {"hot": 256 * 16 * 2 + 256 * 3 + 5, **{f"s{k:02}": k % 3 + 1 for k in range(40)}},
    ],
)
def test_shapes_of_trees(spark, counts):
    rows = sized(counts)
    check(manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)), [r[:5] for r in rows])


@pytest.mark.parametrize("nodes", [1, 2, 3, 4, 5, 9, 10, 13, 26, 27, 28, 31, 82])
def test_butterfly_gives_every_node_its_whole_proof(spark, nodes):
    digests = [h(str(k)) for k in range(nodes)]
    df = spark.createDataFrame([(k % 2, k // 2 if k % 2 else k // 2, (nodes + 1 - k % 2) // 2, d) for k, d in enumerate(digests)], "tree long, index long, nodes long, digest string")
    for t in (0, 1):
        own = digests[t::2]
        if not own:
            continue
        levels = tree(own, 3)
        found = manifest.butterfly(df, (nodes + 1) // 2, run=3).filter(F.col("tree") == t).collect()
        assert sorted(r["index"] for r in found) == list(range(len(own)))
        for r in found:
            want = siblings(levels, r["index"], 3)
            got = [s["left"] + "|" + s["right"] for s in r["above"]]
            assert got == ["".join("|" if own_ else d for d, own_ in level) for level in want]
            assert r["root"] == levels[-1][0]


def test_only_tampered_rows_with_capitals_fail(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    found = {r["doc_id"]: r["verified"] for r in queries.op11_merkle_manifest(spark, sf).collect()}
    for r in rows:
        struck = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert found[r["doc_id"]] == (not struck or not any("A" <= c <= "Z" for c in r["text"] or ""))


def test_query_against_sql_and_brute_force(spark, sf):
    name = "op11_merkle_manifest"
    assert compare(spark, sql_connection(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf) is None
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    check(queries.QUERIES[name](spark, sf), [tuple(r) for r in rows])
