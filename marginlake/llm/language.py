"""Language identification by a bidirectional gated network over bytes.

The network gives every byte position label probabilities; a document's are the
mean over its positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlake.llm.common import by_batch
from marginlake.llm.recurrent import ByteTagger

#: The training sample: so many documents of each language, chosen by hash, and
#: so many characters from a random place in each. Every label is learned; where
#: they are so many that SAMPLE_TOTAL would be passed, each has fewer documents, at least one.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 400, 25_600
#: So many times the sample's rows are looked at to find those with the least hashes.
OVERSAMPLE = 4
#: A language's sample counts as so many rows there at least, so that a small one is not missed by chance.
LOOKED_AT = 16
#: Units of each direction.
UNITS = 12
TRAIN_BYTES = 48
PASSES, RATE = 6, 0.02
#: Pieces of a training batch, and batches that a pass over a small sample is cut into.
BATCH, LEAST_BATCHES = 256, 20
#: Texts are read in pieces of so many bytes; every byte is read.
PIECE_BYTES = 96
#: Pieces that are read at once, and pieces times labels.
PIECES, PIECE_LABELS = 4096, 1 << 16
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def cut_pieces(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (pieces, size), how many of each piece are text, and the text it is from. The rest is blanks."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // size)
    ends = np.cumsum(counts)
    data = b"".join(t + b" " * (-len(t) % size) for t in texts)
    pieces = np.frombuffer(data, np.uint8).reshape(-1, size)
    filled = np.full(len(pieces), size, np.int64)
    some = counts > 0
    filled[ends[some] - 1] = lengths[some] - (counts[some] - 1) * size
    return pieces, filled, np.repeat(np.arange(len(texts)), counts)


def train(rows: list[tuple[bytes, str]]) -> ByteTagger | None:
    """A network from texts and their labels; None without labels."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return None
    pieces, filled, owner = cut_pieces([t for t, _ in rows], TRAIN_BYTES)
    number = {label: i for i, label in enumerate(labels)}
    y = np.array([number[label] for _, label in rows])[owner]
    model = ByteTagger(labels, UNITS)
    batch = max(1, min(BATCH, len(y) // LEAST_BATCHES))
    model.fit(np.ascontiguousarray(pieces.T), y, PASSES, batch, RATE, filled=filled)
    return model


def sample(docs: DataFrame) -> DataFrame:
    """lang, place, text of the training sample: labelled documents that are not held out.

    Of each language those whose hashes are least. Counts come first, so that
    only a few times the sample's rows are moved, whatever the corpus's size.
    """
    text = F.col("text").cast("string")
    place = F.md5(F.concat(F.lit("language"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    begin = F.pmod(F.xxhash64(place), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))) + 1
    labelled = docs.filter(F.col("lang").isNotNull() & text.rlike(r"\p{L}")).filter(
        ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    )
    lang = F.col("lang").cast("string")
    counts = labelled.groupBy(lang.alias("lang")).count().collect()  # a row for each label, as the network has
    if not counts:
        return labelled.select(lang.alias("lang"), place.alias("place"), text.alias("text"))
    most = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // len(counts)))
    # The share of a language's hashes that holds OVERSAMPLE times its sample.
    shares = [(r["lang"], min(1.0, OVERSAMPLE * max(most, LOOKED_AT) / r["count"])) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "__lang string, __share double")
    near = F.conv(F.substring(place, 1, 8), 16, 10).cast("double") < F.col("__share") * float(1 << 32)
    part = labelled.join(F.broadcast(shares), lang == F.col("__lang")).filter(near).select(
        lang.alias("lang"),
        place.alias("place"),
        F.substring(text, begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"),
    )
    first = Window.partitionBy("lang").orderBy("place", "text")
    return part.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)


def pooled(model: ByteTagger, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all positions, a row for each text; none for empty ones (zeros)."""
    pieces, filled, owner = cut_pieces(texts, PIECE_BYTES)
    sums = np.zeros((len(texts), len(model.labels)))
    at_once = max(1, min(PIECES, PIECE_LABELS // len(model.labels)))
    for i in range(0, len(pieces), at_once):
        x = np.ascontiguousarray(pieces[i : i + at_once].T)
        prob = model.probabilities(x)
        some = filled[i : i + at_once]
        inside = np.arange(PIECE_BYTES)[:, None] < some
        if (some < PIECE_BYTES).any():
            prob *= inside[:, None, :]
        np.add.at(sums, owner[i : i + at_once], prob.sum(axis=0).T)
    return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def spans(model: ByteTagger, text: bytes) -> list[tuple[int, int, str]]:
    """Runs of bytes of one most likely label: begin, end, label."""
    pieces, _, _ = cut_pieces([text], PIECE_BYTES)
    best = model.probabilities(np.ascontiguousarray(pieces.T)).argmax(axis=1).T.reshape(-1)[: len(text)]
    cut = np.flatnonzero(np.diff(best, prepend=-1, append=-1))
    return [(int(a), int(b), model.labels[best[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame) -> ByteTagger | None:
    """Train on the driver from a sample of short texts: at most SAMPLE_TOTAL, or one for each label."""
    rows = sample(docs).orderBy("lang", "place", "text").collect()  # bounded by the sample
    return train([(r["text"].encode("utf-8", "surrogatepass"), r["lang"]) for r in rows])


def identify(docs: DataFrame, model: ByteTagger | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score (the mean probability of that label) from the whole text.

    Texts that are null or have no letter, and all texts where nothing could be
    learned, get ``und`` and score 0. Columns lang_pred and score are replaced.
    """

    def step(cols):
        texts = cols[read].to_pylist()
        pred, score = [], []
        for some in _together(texts):
            known = [model is not None and has_letter(t) for t in some]
            data = [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(some, known, strict=True)]
            if any(known):
                prob = pooled(model, data)
                best = prob.argmax(axis=1)
                pred += [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score += [min(1.0, float(p[b])) if k else 0.0 for p, b, k in zip(prob, best, known, strict=True)]
            else:
                pred += [UNKNOWN] * len(some)
                score += [0.0] * len(some)
        return cols | {"lang_pred": pred, "score": score}

    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    # A text that is kept is sent once.
    there = dict(docs.dtypes).get(text) == "string"
    read = text if there else "__text"
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], *([] if there else [F.col(f"`{text}`").cast("string").alias(read)]))
    schema = [*((f.name, f.dataType) for f in keep), ("lang_pred", "string"), ("score", "double")]
    return by_batch(rows, lambda: step, schema)


def _together(texts: list, size: int = 2_000_000):
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with letters, in their own columns; a null lang becomes the predicted one.

    Null texts and those without a letter are rejected. A low score is no reason
    to reject: it also comes from documents in two languages. Where nothing could
    be learned, a null lang stays null.
    """
    model = fit(docs)
    lettered = docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    if model is None:
        return lettered
    return identify(lettered, model).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])
