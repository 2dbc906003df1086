"""Registered queries over the sample tables, and SQL for them where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from marginlake.llm import bpe, codes, fingerprints, htmltext, language, licenses, manifest, mixing, neardup, quality, substrings, vectors, warc
from marginlake.llm.common import table


def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_html_text(spark, sf_dir):
    found = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), htmltext.train())
    return found.select("page_id", "url", "text", "n_chars")


def op4_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licenses(spark, sf_dir):
    """Documents as files: the source is the top folder, the language the one below."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")))
    return found.select("doc_id", "path", "license", "how", "score", "from_path")


def op6_warc(spark, sf_dir):
    found = warc.archive_pages(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark, sf_dir):
    found = mixing.take(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark, sf_dir):
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "n_capitals", "distance")


def op10_substrings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    found = substrings.remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op11_merkle_manifest(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("source")


def op12_near_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    found = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_language": op1_language,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_near_vectors": op12_near_vectors,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op6_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), k as (
  select payload_digest, payload_bytes, max(page_id) as kept from p where payload_bytes >= 1000 group by all
)
select page_id, payload_bytes, payload_digest,
  case when kept <> page_id then 'revisit' else 'response' end as record_type,
  case when kept <> page_id then kept end as refers_to
from p left join k using (payload_digest, payload_bytes)
""",
    "op7_mixing": mixing.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_near_vectors": vectors.SQL,
    "op13_vector_codes": codes.SQL,
    # Shingles joined with themselves: right on samples, not meant for whole corpora.
    "op4_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle
  from w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) where len(ws) > 0
), n as (
  select doc_id, count(*) as size from s group by 1
), linked as (
  select a.doc_id as a, b.doc_id as b
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
    join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.size) + any_value(y.size) - count(*))
), both_ways as (
  select a, b from linked union select b, a from linked
), reach(doc_id, seen) as (
  select doc_id, doc_id from w
  union
  select r.doc_id, l.b from reach r join both_ways l on l.a = r.seen
), c as (
  select doc_id, min(seen) as component_id from reach group by 1
)
select c.doc_id, coalesce(n.size, 0)::bigint as n_shingles, c.component_id, c.component_id = c.doc_id as kept
from c left join n on n.doc_id = c.doc_id
""",
    "op10_substrings": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as words from w, unnest(range(1, len(ws) - 11)) t(i)
), firsts as (
  select words, min(doc_id) as doc_id from windows group by 1
), gone as (
  select distinct x.doc_id, x.i + k as i from windows x join firsts f on f.words = x.words and f.doc_id < x.doc_id, range(13) r(k)
), marked as (
  select w.doc_id, t.i, w.ws[t.i] as word, g.i is not null as removed
  from w, unnest(range(1, len(ws) + 1)) t(i) left join gone g on g.doc_id = w.doc_id and g.i = t.i
), sums as (
  select doc_id, count(*) filter (removed) as n_removed, string_agg(word, ' ' order by i) filter (not removed) as kept from marked group by 1
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join sums on sums.doc_id = w.doc_id
""",
}
