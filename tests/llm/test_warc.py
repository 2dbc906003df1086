import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from marginlake.llm import queries, warc
from tests.oracle_check import compare, sql_connection

BIG = "<p>" + "wörd " * 400 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, kept string")


def row(i, html, url="http://a.example/x y\r\nä"):
    return (i, url, html, "clash", "clash")


def written(spark, df, tmp_path, chunk=None):
    return {
        (r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])
        for r in warc.archive_pages(df, f"file://{tmp_path}/w").collect()
    }


def sha(html):
    return hashlib.sha1((html or "").encode()).hexdigest()


def test_odd_pages(spark, tmp_path):
    rows = [row(1, BIG), row(2, BIG), row(3, BIG, None), row(4, "small"), row(5, "small"), row(6, None), row(7, ""), row(8, "a\r\n\r\nb" * 300), row(9, "é" * 499), row(10, "é" * 500), row(11, "é" * 500)]
    got = written(spark, pages(spark, rows), tmp_path)
    size = lambda h: len((h or "").encode())
    want = set()
    for i, _, h, _, _ in rows:
        same = [j for j, _, g, _, _ in rows if g == h and size(h) >= 1000]
        top = max(same) if same else i
        want.add((i, "response" if top == i else "revisit", None if top == i else top, size(h), sha(h)))
    assert got == want


def test_repeated_rows_and_null_ids(spark, tmp_path):
    got = written(spark, pages(spark, [row(5, BIG), row(5, BIG), row(None, BIG), row(4, BIG)]), tmp_path)
    n = len(BIG.encode())
    assert got == {(5, "response", None, n, sha(BIG)), (None, "revisit", 5, n, sha(BIG)), (4, "revisit", 5, n, sha(BIG))}


def test_empty_table(spark, tmp_path):
    assert written(spark, pages(spark, []), tmp_path) == set()


def test_large_records_pass_in_chunks(spark, tmp_path):
    body = "0123456789abcdé" * 5000
    df = spark.createDataFrame([("r1", "u", body), ("r2", None, "x")], "id string, u string, body string")
    chunks = warc.chunk_table(df, "id", "u", "body", chunk_bytes=1000)
    assert chunks.count() > 75
    assert chunks.agg(F.max(F.length("data"))).first()[0] == 1000
    heads = warc.heads(chunks)
    planned = heads.withColumn("refers_to", F.lit(None).cast("string"))
    files = warc.write(chunks, planned, f"file://{tmp_path}/big", "2000-01-01T00:00:00Z", archive_bytes=10)
    back = warc.read(files, chunk_bytes=777).filter("record_id = 'r1'").orderBy("chunk_no").collect()
    assert [len(r["data"]) for r in back[:-1]] == [777] * (len(back) - 1)
    assert b"".join(bytes(r["data"]) for r in back) == body.encode()
    assert back[-1]["last"] and back[-1]["sha1"] == sha(body)
    # Prefix digests are right at every chunk.
    so_far = b""
    for r in back[:20]:
        so_far += bytes(r["data"])
        assert (r["end_byte"], r["sha1"]) == (len(so_far), hashlib.sha1(so_far).hexdigest())


def test_files_are_plain_warc(spark, tmp_path):
    written(spark, pages(spark, [row(1, BIG), row(2, BIG)]), tmp_path)
    text = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert text.count(b"WARC/1.1\r\n") == 2
    assert b"WARC-Type: revisit\r\n" in text and b"WARC-Refers-To: <urn:x-record:2>\r\n" in text
    assert text.count(BIG.encode()) == 1
    assert b"WARC-Target-URI: http://a.example/x%20y%0D%0A%C3%A4\r\n" in text


def test_uncompressed_archives_are_read(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    back = warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "archive string")).collect()
    assert [bytes(r["data"]) for r in back] == [b"hello"] * 2


def test_damaged_archives_fail(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes(record)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "archive string")).collect()


def test_query_equals_sql(spark, sf):
    con = sql_connection(sf)
    assert compare(spark, con, "op6", queries.op6_warc, queries.ORACLE["op6_warc"], sf) is None


def test_rows_of_one_id_are_records_of_their_own(spark, tmp_path):
    """Other payloads under one id, and a large payload that is there twice, with joins that sort."""
    big = "x" * 1_600_000
    rows = [(1, "http://a/1", "one"), (1, "http://a/2", "two" * 600), (2, "http://a/3", big), (2, "http://a/3", big), (3, "http://a/4", "two" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = warc.archive_pages(pages, f"file://{tmp_path}/warc").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in found)
    assert got == [
        (1, "http://a/1", "response", 0, 3),
        (1, "http://a/2", "revisit", 3, 1800),
        (2, "http://a/3", "response", 0, len(big)),
        (2, "http://a/3", "response", 0, len(big)),
        (3, "http://a/4", "response", 0, 1800),
    ]
