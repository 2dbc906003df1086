"""Quality rules: base limits, then robust multivariate outliers.

Documents are described by a few counts. Per language and source the centre
and the scatter of their transformed values are estimated by the minimum
covariance determinant, so that junk cannot hide itself by shifting the
estimate, and documents far from it by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import SPACES, by_batch, hashes, store, struct, temporary, windows, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Share of a group's documents that the estimate is taken from.
SHARE = 0.75
#: Concentration steps; the determinant falls at each and rarely after the fifth.
STEPS = 5
#: Chance that a document of a normal group is rejected.
REJECT = 1e-6
#: A group's estimate is drawn towards its language's, and that towards all's, as if these brought so many documents.
DRAWN = 200
#: Distances are sorted into bins, so many to each doubling.
BINS_PER_DOUBLING = 8

#: Name, transform of the counts, and the least standard deviation that is taken
#: for real: values that most documents share (no symbols, no repeated lines)
#: would otherwise have no scatter at all.
FEATURES = (
    ("words", lambda: F.log1p(F.col("n_words")), 0.5),
    ("word_length", lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.12),
    ("symbols", lambda: F.sqrt(F.col("n_symbols") / F.col("n_words")), 0.1),
    ("dup_lines", lambda: F.log1p(F.col("n_dup_lines")), 0.5),
    ("capitals", lambda: F.sqrt(F.col("n_capitals") / F.col("word_chars")), 0.12),
    ("repeats", lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.08),
)
DIMENSIONS = len(FEATURES)
X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def count(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, as ``COUNTS`` names them; capitals are A to Z."""
    text = text or ""
    tokens = words(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(np.count_nonzero((raw - np.uint8(65)) < 26))
    n = len(tokens)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > WINDOW:
        w = windows(hashes(tokens), WINDOW)
        ordered = np.sort(w)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            begins = np.flatnonzero(np.isin(w, twice))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, begins, 1)
            np.add.at(edge, begins + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, capitals


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document. Null texts count as empty."""

    def step(cols):
        found = [count(t.as_py()) for t in cols["text"]]
        return cols | dict(zip(COUNTS, zip(*found, strict=True), strict=True))

    kinds = {f.name: f.dataType for f in docs.schema.fields}
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    schema = [("doc_id", kinds["doc_id"]), ("lang", "string"), ("source", "string"), *[(c, "long") for c in COUNTS]]
    return by_batch(rows, lambda: step, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# ---- chi-square, for cutoffs and for the scale of trimmed scatters


def chi2_cdf(x: float, k: float) -> float:
    """By the power series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def trim_scale(share: float) -> float:
    """What the scatter of the inner ``share`` of a normal cloud must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, DIMENSIONS), DIMENSIONS + 2)


# ---- estimate


def _levels() -> Column:
    """A document counts for its language and source, its language, and all."""
    null = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c)))
    lang, source = null("lang"), null("source")
    return F.array(
        F.concat(F.lit("0"), F.length(lang).cast("string"), lang, source), F.concat(F.lit("1"), lang), F.lit("2")
    )


def _distance(params: Column) -> Column:
    """Squared Mahalanobis distance from the model in a struct of centre and inverse scatter."""
    d = [F.col(x) - params["centre"][i] for i, x in enumerate(X)]
    terms = [params["inverse"][k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


MODEL = struct("level string, n long, centre doubles, inverse doubles, scatter doubles, log_det double")


def fit(bins: list[dict], inner: float | None, within: float | None, scale: float) -> tuple:
    """From bins of distances (bin, n, sums, products) of a level to its n, centre, inverse scatter and log determinant.

    Bins from the centre outwards are taken until they hold the share ``inner``,
    or up to the distance ``within``.
    """
    n = np.array([b["n"] for b in bins], np.int64)
    if within is None:
        held = np.searchsorted(np.cumsum(n), inner * n.sum()) + 1
    else:
        held = max(1, sum(b["bin"] <= _bin_of(within) for b in bins))
    m = n[:held].sum()
    mean = np.sum([b["sums"] for b in bins[:held]], axis=0) / m
    products = np.sum([b["products"] for b in bins[:held]], axis=0) / m
    cov = np.zeros((DIMENSIONS, DIMENSIONS))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = products[k] - mean[i] * mean[j]
    cov = cov * scale + np.diag([f[2] ** 2 for f in FEATURES])
    inverse = np.linalg.inv(cov)
    packed = lambda m: [float(m[i, j]) for i, j in PAIRS]
    return int(n.sum()), mean.tolist(), packed(inverse), packed(cov), float(np.linalg.slogdet(cov)[1])


def drawn(models: list[dict | None]) -> tuple[list[float], list[float]]:
    """Centre and inverse scatter of a group, from the estimates of its levels, the finest first.

    From the coarsest on, each is the mean of the finer estimate and of what is
    known so far, weighed by the finer one's documents and DRAWN: one rule for groups of all sizes.
    """
    centre = scatter = None
    for m in reversed(models):
        if m is None:
            continue
        own = np.array(m["centre"]), np.array(m["scatter"])
        w = 1.0 if centre is None else m["n"] / (m["n"] + DRAWN)
        centre, scatter = (own if centre is None else (w * own[0] + (1 - w) * centre, w * own[1] + (1 - w) * scatter))
    cov = np.zeros((DIMENSIONS, DIMENSIONS))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = scatter[k]
    inverse = np.linalg.inv(cov)
    return centre.tolist(), [float(inverse[i, j]) for i, j in PAIRS]


def _fitted(bins: DataFrame, inner: float | None, within: float | None, scale: float) -> DataFrame:
    def step(cols):
        found = [fit(b, inner, within, scale) for b in cols["bins"].to_pylist()]
        return {"level": cols["level"]} | dict(zip(("n", "centre", "inverse", "scatter", "log_det"), zip(*found, strict=True), strict=True))

    return by_batch(bins, lambda: step, MODEL)


def _bin_of(distance: float) -> int:
    return math.floor(math.log2(distance + 1e-6) * BINS_PER_DOUBLING)


def _moments(rows: DataFrame, distance: Column) -> DataFrame:
    """level, bins: for each bin of distance its count, sums and sums of products.

    Combined before the shuffle; a level has as many bins as its distances have
    doublings, times BINS_PER_DOUBLING.
    """
    bins = F.floor(F.log2(distance + F.lit(1e-6)) * BINS_PER_DOUBLING).cast("int")
    sums = [F.sum(x) for x in X]
    products = [F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS]
    binned = rows.groupBy("level", bins.alias("bin")).agg(
        F.count("*").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products")
    )
    return binned.groupBy("level").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "sums", "products"))).alias("bins"))


def estimate(rows: DataFrame) -> DataFrame:
    """Centre and inverse scatter of each level, by concentration steps over all rows.

    ``rows``: level and x0.. for each document and level. The start is
    deterministic: medians and median deviations. A step sorts all documents
    of a level by distance, in bins, and takes mean and covariance of the
    nearest three quarters, which never raises the determinant; the last
    step takes all documents within the 97.5 % distance. Each step is one job
    that returns a bounded table: bins of levels.
    """
    medians = rows.groupBy("level").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in X])
    middle = store(medians, "quality-medians")
    spread = (
        rows.join(middle, "level")
        .groupBy("level")
        .agg(
            *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"d_{x}") for x in X],
            *[F.first(f"m_{x}").alias(f"m_{x}") for x in X],
        )
    )
    inverse = [
        1 / (F.pow(1.4826 * F.col(f"d_x{i}"), 2) + FEATURES[i][2] ** 2) if i == j else F.lit(0.0) for i, j in PAIRS
    ]
    model = store(
        spread.select("level", F.array(*[F.col(f"m_{x}") for x in X]).alias("centre"), F.array(*inverse).alias("inverse")),
        "quality-start",
    )
    for k in range(STEPS + 1):
        last = k == STEPS
        share = 0.975 if last else SHARE
        within = chi2_quantile(share, DIMENSIONS) if last else None
        placed = rows.join(model.select("level", F.struct("centre", "inverse").alias("model")), "level")
        bins = _moments(placed, _distance(F.col("model")))
        model = store(_fitted(bins, None if last else SHARE, within, trim_scale(share)), f"quality-{k}")
    return model


def _judged(docs: DataFrame) -> DataFrame:
    counted = store(statistics(docs), "quality-counts")
    marked = counted.withColumn("base_failed", base_failed()).withColumn("levels", _levels())
    vectors = [expr().alias(x) for x, (_, expr, _) in zip(X, FEATURES, strict=True)]
    passed = marked.filter(~F.col("base_failed")).select("*", *vectors)
    model = estimate(passed.select(F.explode("levels").alias("level"), *X))
    # One row for each group: the estimates of its levels, drawn together.
    rows = F.struct("n", "centre", "scatter")
    groups = passed.select(*[F.col("levels")[i].alias(f"l{i}") for i in range(3)]).distinct()
    for i in range(3):
        groups = groups.join(model.select(F.col("level").alias(f"l{i}"), rows.alias(f"m{i}")), f"l{i}")

    def step(cols):
        found = [drawn(list(m)) for m in zip(*(cols[f"m{i}"].to_pylist() for i in range(3)), strict=True)]
        return {"group": cols["l0"]} | dict(zip(("centre", "inverse"), zip(*found, strict=True), strict=True))

    pulled = store(by_batch(groups.select("l0", "m0", "m1", "m2"), lambda: step, struct("group string, centre doubles, inverse doubles")), "quality-models")
    judged = passed.join(pulled.select("group", F.struct("centre", "inverse").alias("model")), passed["levels"][0] == F.col("group"))
    distance = _distance(F.col("model"))
    cutoff = chi2_quantile(1 - REJECT, DIMENSIONS)
    columns = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    kept = judged.select(*columns, distance.alias("distance")).withColumn("kept", F.col("distance") <= cutoff)
    failed = marked.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return kept.unionByName(failed)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, distance and kept for every document.

    Null and empty texts have no words and fail. Null languages and sources are
    groups of their own. Rows of one id are judged each by itself. Documents
    that fail the base rules take no part in the estimate; the others are kept
    unless their squared distance from the estimate of their group passes the
    cutoff. The result is a stored table; the tables on the way to it go.
    """
    with temporary(docs.sparkSession):
        return store(_judged(docs), "quality", lasting=True)
