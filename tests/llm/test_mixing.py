import duckdb
from pyspark.sql import functions as F

from marginlake.llm import mixing, queries
from tests.llm.frames import no_docs, odd_docs, odd_rows
from tests.oracle_check import compare, sql_connection


def filled(sizes, weights=(5, 2, 1)):
    """Targets by pouring: brute force, in small steps of virtual time."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w[s] * mid, 3 * sizes[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    return {s: min(w[s] * high, 3 * sizes[s]) for s in sizes}


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = mixing.take(docs).collect()
    assert len(rows) == len(odd_rows())
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = filled(sizes)
    got = {}
    for r in rows:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * (1 + goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
    for s, n in got.items():
        assert abs(n - goal[s]) <= 0.5000001


def test_reruns_agree_whatever_the_partitions(spark):
    docs = odd_docs(spark)
    once = sorted(mixing.take(docs).collect(), key=repr)
    assert once == sorted(mixing.take(docs.repartition(7)).collect(), key=repr)


def test_mix_serves_what_take_says_in_order(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.take(docs).agg(F.sum("taken")).first()[0]
    assert mixed.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert {r["key"] for r in mixed.collect()} == {"k"}


def test_no_words_and_no_rows(spark):
    assert mixing.take(no_docs(spark)).count() == 0
    blank = odd_docs(spark).filter(F.coalesce(F.trim("text"), F.lit("")) == "")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.take(blank).collect()} == {(0, 0.0, 0)}
    assert mixing.mix(blank).count() == 0


def test_sql_on_odd_documents(spark):
    docs = odd_docs(spark).select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    got = mixing.take(odd_docs(spark)).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: tuple(-1 if v is None or v != v else round(float(v), 6) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, con.execute(mixing.SQL).fetchall()))


def test_query_equals_sql(spark, sf):
    assert compare(spark, sql_connection(sf), "op7", queries.op7_mixing, queries.ORACLE["op7_mixing"], sf) is None
