import math
import random

import numpy as np

from marginlake.llm import quality, queries
from tests.llm.frames import SCHEMA, no_docs, odd_docs, odd_rows, row, sentence


def brute(text):
    text = text or ""
    w = text.encode().split()
    spots = {}
    for k in range(len(w) - 4):
        spots.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {j for s in spots.values() if len(s) > 1 for k in s for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(covered), sum("A" <= c <= "Z" for c in text))


def test_counts_equal_brute_force():
    rnd = random.Random(1)
    texts = [r[1] for r in odd_rows()]
    for _ in range(200):
        texts.append("".join(rnd.choice("ab c\n#$É\x0b ") for _ in range(rnd.randint(0, 120))))
    for t in texts:
        assert quality.count(t) == brute(t)


def test_odd_documents(spark):
    rows = quality.judge(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    want = sorted((repr(r[0]), *brute(r[1])) for r in odd_rows())
    assert sorted((repr(r["doc_id"]), *(r[c] for c in quality.COUNTS)) for r in rows) == want
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_empty_table_and_nothing_to_estimate_from(spark):
    assert quality.judge(no_docs(spark)).count() == 0
    rows = quality.judge(odd_docs(spark).filter("doc_id in (5, 6, 8)")).collect()
    assert len(rows) == 3 and not any(r["kept"] for r in rows)


def test_chi_square():
    # From printed tables.
    assert abs(quality.chi2_quantile(0.975, 5) - 12.833) < 1e-3
    assert abs(quality.chi2_quantile(0.95, 6) - 12.592) < 1e-3
    assert abs(quality.chi2_cdf(6.626, 5) - 0.75) < 1e-4


def test_junk_goes_and_clean_documents_stay(spark):
    rnd = random.Random(5)
    clean = [row(i, ". ".join(sentence(rnd, rnd.randint(5, 30)).capitalize() for _ in range(rnd.randint(2, 30)))) for i in range(400)]
    junk = [row(1000 + i, " ".join(w + "$$$" for w in sentence(rnd, 80).split())) for i in range(60)]
    shout = [row(2000 + i, sentence(rnd, 80).upper()) for i in range(30)]
    rows = quality.judge(spark.createDataFrame(clean + junk + shout, SCHEMA)).collect()
    assert all(r["kept"] for r in rows if r["doc_id"] < 1000)
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 1000)


def test_estimate_equals_concentration_in_numpy(spark):
    """The binned, distributed steps against exact steps on the same vectors, a fifth of them far away."""
    rng = np.random.default_rng(2)
    d = quality.DIMENSIONS
    x = np.concatenate([rng.normal(0, 1, (800, d)), rng.normal(9, 1, (200, d))])
    df = spark.createDataFrame([("a", *map(float, v)) for v in x], ["level", *quality.X])
    found = quality.estimate(df).collect()[0]
    floors = np.diag([f[2] ** 2 for f in quality.FEATURES])
    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(abs(x - mean), axis=0)) ** 2) + floors
    for k in range(quality.STEPS + 1):
        dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        last = k == quality.STEPS
        share = 0.975 if last else quality.SHARE
        inner = dist <= (quality.chi2_quantile(share, d) if last else np.quantile(dist, share))
        mean, cov = x[inner].mean(axis=0), np.cov(x[inner].T, bias=True) * quality.trim_scale(share) + floors
    assert np.allclose(found["centre"], mean, atol=0.1)
    assert abs(found["log_det"] - math.log(np.linalg.det(cov))) < 0.4
    assert np.abs(found["centre"]).max() < 0.3  # not drawn to the far fifth


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat, _ = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)


def test_labelled_clean_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    clean = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    junk = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_estimates_are_drawn_by_size():
    """The same rule for all sizes: a group of many documents keeps its own estimate, one of few has its language's."""
    flat = [float(i == j) for i, j in quality.PAIRS]
    level = lambda n, at: {"n": n, "centre": [at] * quality.DIMENSIONS, "scatter": flat}
    for n, least, most in ((1, 0.0, 0.02), (quality.DRAWN, 0.49, 0.51), (10**6, 0.99, 1.0)):
        centre, inverse = quality.drawn([level(n, 1.0), level(10**9, 0.0), level(10**9, 0.0)])
        assert least <= centre[0] <= most
        assert all(abs(a - b) < 1e-6 for a, b in zip(inverse, flat))
    assert quality.drawn([None, None, level(5, 2.0)])[0][0] == 2.0
