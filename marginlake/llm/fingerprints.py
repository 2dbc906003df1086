"""Document fingerprints: packed low-order bits of one-permutation MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marginlake.llm.common import _fields, by_batch, store
from marginlake.llm.minhash import likeness, low_bits, shingles, signatures

BINS = 512
BITS = 2
#: Texts handled at once in a task.
ROWS = 512


def fingerprint_rows(texts: list[str | None], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints, a row for each text, and whether the text has words."""
    sets = [shingles(t) for t in texts]
    return low_bits(signatures(sets, bins), bits), np.array([len(s) > 0 for s in sets], bool)


def _hex(packed: np.ndarray, filled: np.ndarray) -> list[str]:
    return [bytes(p).hex() if f else "" for p, f in zip(packed, filled, strict=True)]


def _like(a, b, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    (pa_, fa), (pb, fb) = a, b
    return np.where(fa & fb, likeness(pa_, pb, bins, bits), np.where(fa == fb, 1.0, 0.0))


def fingerprints(docs: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` without the text, with n_chars (code points) and fingerprint (hexadecimal).

    Texts without a word, null ones too, have the empty fingerprint. Equal
    texts have equal fingerprints. Columns n_chars and fingerprint are replaced.
    """

    def step(cols):
        texts = [t or "" for t in cols.pop("__text").to_pylist()]
        found = [_hex(*fingerprint_rows(texts[i : i + ROWS], bins, bits)) for i in range(0, len(texts), ROWS)]
        return cols | {"n_chars": [len(t) for t in texts], "fingerprint": sum(found, [])}

    keep = [f for f in docs.schema.fields if f.name not in (text, "n_chars", "fingerprint")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return by_batch(
        rows, lambda: step, [*((f.name, f.dataType) for f in keep), ("n_chars", "long"), ("fingerprint", "string")]
    )


def edited(text: str, after: str) -> str:
    """The last quarter of the text's code points replaced by as many of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def _compare(ids: list, texts: list[str]) -> list[tuple]:
    """Result rows for all but the last text, each against the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = fingerprint_rows(texts)
    new = fingerprint_rows(changed)
    head = own[0][:-1], own[1][:-1]
    after = own[0][1:], own[1][1:]
    return list(
        zip(
            ids[:-1],
            map(len, texts[:-1]),
            (hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed),
            _hex(*head),
            _hex(*new),
            _like(head, new).tolist(),
            _like(head, after).tolist(),
            strict=True,
        )
    )


RESULT = [
    ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
    ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
]


def edit_report(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how near they and the next document's are.

    The next document is that of the next larger doc_id, after the last the
    first; null ids come first, and rows of one id stand in the order of
    their texts. A single document is its own next. Null texts are empty;
    two texts without words have likeness 1, one without and one with words 0.

    One sort by ranges of ids brings neighbours together. Each task compares
    the rows it has; its first and last row go to a small table of edges, two
    rows for each task, from which the pairs between tasks are made.
    """
    kind = docs.schema["doc_id"].dataType
    schema = [("part", "int"), ("edge", "int"), ("doc_id", kind), *RESULT, ("text", "string")]
    target = to_arrow_schema(_fields(schema))
    blank = (None,) * len(RESULT)

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, texts, first = [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids += some.column(0).to_pylist()
                texts += [t or "" for t in some.column(1).to_pylist()]
                if first is None:
                    first = (part, 0, ids[0], *blank, texts[0])
                    yield _batch([first], target)
                if len(ids) > 1:
                    yield _batch([(part, None, *row, None) for row in _compare(ids, texts)], target)
                    ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield _batch([(part, 1, ids[0], *blank, texts[0])], target)

    near = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, _fields(schema))
    )
    found = store(near, "fingerprints")
    edges = found.filter("edge is not null")
    ring = Window.orderBy("part")
    all_parts = Window.partitionBy()
    parts = edges.filter("edge = 0").select("part")
    follows = parts.select(
        F.col("part").alias("from_part"),
        F.coalesce(F.lead("part").over(ring), F.min("part").over(all_parts)).alias("part"),
    )
    firsts = edges.filter("edge = 0").select("part", F.col("text").alias("next_text"))
    lasts = edges.filter("edge = 1").select(F.col("part").alias("from_part"), "doc_id", "text")
    pairs = lasts.join(follows, "from_part").join(firsts, "part").select("doc_id", "text", "next_text")

    def step(cols):
        rows = [
            _compare([i, None], [a, b])[0]
            for i, a, b in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist(), cols["next_text"].to_pylist(), strict=True)
        ]
        names = ["doc_id", *(n for n, _ in RESULT)]
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    joints = by_batch(pairs, lambda: step, [("doc_id", kind), *RESULT])
    return found.filter("edge is null").select("doc_id", *(n for n, _ in RESULT)).unionByName(joints)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target
    )
