"""Near-duplicate documents by MinHash, banded buckets and star-shaped candidates.

1. Documents of one shingle set are one class; only classes go on.
2. One-permutation signatures give each class a key for each band; classes of
   one key are a bucket. Bands are cut so that a pair at the threshold, whatever
   it is, misses all buckets once in four million times.
3. Stars: the most central class of a bucket is compared with the others. That
   is one pair for each member, not all pairs, and mostly joins the bucket.
   What a star leaves open gets another.
4. Buckets that still hold several components are settled exactly: only the
   pairs across components are compared, inside tasks, in blocks of bounded
   size, and a task returns a spanning forest of what it finds.
Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import U64, by_batch, slices, store, struct, temporary
from marginlake.llm.graph import components
from marginlake.llm.minhash import bands, shingles, signatures

#: The threshold of op4; other callers give their own.
PERCENT = 85
#: How likely a pair at the threshold may miss all buckets.
MISS = 2.7e-7
#: Rounds of stars before what is open is settled.
STARS = 2
#: Members of a star that one task group compares with the hub.
STAR_MEMBERS = 256
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 512
#: Texts handled at once in a task.
TOGETHER = 512


def banding(percent: int) -> tuple[int, int]:
    """Bands, and bins of each: a band agrees with a chance of 0.3 or more at the threshold; 32 of 6 at 85, 39 of 5 at 80."""
    like = min(percent, 99) / 100
    bins = min(8, max(1, round(math.log(0.35) / math.log(like))))
    return math.ceil(math.log(MISS) / math.log1p(-(like**bins))), bins


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union of two ascending sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _node(s: np.ndarray) -> int:
    """A 64-bit name for a shingle set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def text_hash() -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def described(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, node (names the shingle set; null if empty), n_shingles, bands."""
    count, bins = banding(percent)

    def step(cols):
        texts = cols["text"].to_pylist()
        nodes, sizes, keys = [], [], []
        for i in range(0, len(texts), TOGETHER):
            sets = [shingles(t) for t in texts[i : i + TOGETHER]]
            sizes += map(len, sets)
            nodes += (_node(s) if len(s) else None for s in sets)
            keys.append(bands(signatures(sets, count * bins), bins))
        flat = np.concatenate(keys).view(np.int64).reshape(-1)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * count
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "node": nodes, "n_shingles": sizes, "bands": lists}

    schema = [("doc_id", docs.schema["doc_id"].dataType), ("text_hash", "long"), ("node", "long"), ("n_shingles", "long"), ("bands", "longs")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    return by_batch(rows, lambda: step, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (packed, ascending) of the classes in ``wanted`` (node, first_id).

    Repeated rows of a document may give a class more than once. Texts and sets
    are joined by sorting at every size: their side is the wide one, and the
    other grows with the input.
    """

    def step(cols):
        sets = [shingles(t) for t in cols["text"].to_pylist()]
        keep = [len(s) > 0 and _node(s) == n for s, n in zip(sets, cols["node"].to_pylist(), strict=True)]
        return {
            "node": cols["node"].filter(pa.array(keep)),
            "shingles": [s.tobytes() for s, k in zip(sets, keep, strict=True) if k],
        }

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    wanted = wanted.hint("merge")
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"])).select("node", "text")
    return by_batch(rows, lambda: step, "node long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (hub, member) those that are linked. Both columns name classes.

    A hub's set goes to every STAR_MEMBERS of its members, so that a hub of
    any number of members is spread over tasks; the others' sets stream by.
    """
    out = struct("a long, b long")
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_MEMBERS).cast("int").alias("parts"))
    placed = store(
        pairs.join(counts, "hub").withColumn("part", F.pmod(F.hash("member"), F.col("parts"))).drop("parts"), "pairs"
    )
    hubs = placed.select("hub", "part").distinct().withColumn("node", F.col("hub")).hint("merge").join(sets, "node")
    members = placed.withColumnRenamed("member", "node").hint("merge").join(sets, "node")
    rows = hubs.select("hub", "part", F.lit(0).alias("kind"), "node", "shingles").unionByName(
        members.select("hub", "part", F.lit(1).alias("kind"), "node", "shingles")
    )

    def run(batches):
        at, hub = None, None
        for batch in slices(batches):
            found = []
            for h, part, kind, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, U64)
                if kind == 0:
                    at, hub = (h, part), s
                elif at == (h, part) and linked(hub, s, percent):
                    found.append((h, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").mapInArrow(run, out)


class Forest:
    """Union-find over numbers from 0."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def settle(nodes: list[int], comps: list[int], sides: list[int], data: list[bytes], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between different components among some sets; as many as join them.

    ``sides`` are block numbers: with two of them, only pairs across are compared.
    """
    sets = [np.frombuffer(d, U64) for d in data]
    sizes = np.array([len(s) for s in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    names = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([names[c] for c in comps])
    side = np.array(sides)
    across = side.min() != side.max()
    forest, found = Forest(len(names)), []
    mark = np.zeros(shingle.max() + 1, np.int32)
    for x in range(len(sets)):
        if across and side[x] != side.min():
            continue
        other = comp != comp[x]
        other &= (side != side[x]) if across else (np.arange(len(sets)) > x)
        other &= 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        if not other.any():
            continue
        own = shingle[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[shingle], starts)
        mark[own] = 0
        for y in np.flatnonzero(other & (100 * common >= percent * (sizes + sizes[x] - common))):
            if forest.join(int(comp[x]), int(comp[y])):
                found.append((nodes[x], nodes[int(y)]))
    return found


def settle_buckets(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All links across components in buckets: ``members`` has bucket, node, comp."""
    out = struct("a long, b long")
    sized = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    placed = (
        members.join(sized, "bucket")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    )
    rows = placed.hint("merge").join(sets, "node").select("bucket", "i", "j", "block", "node", "comp", "shingles")

    def run(batches):
        held, group = None, []

        def done():
            found = settle(*zip(*group, strict=True), percent=percent) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in slices(batches):
            for b, i, j, side, node, comp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, i, j) != held:
                    yield from done()
                    held, group = (b, i, j), []
                group.append((node, comp, side, data))
        yield from done()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(run, out)


def class_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that join all that the threshold joins.

    ``classes``: node, n_shingles, first_id, bands.
    """
    member = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    crowds = member.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    crowded = store(member.join(crowds, "bucket"), "buckets")
    involved = crowded.groupBy("node").agg(F.sum("crowd").alias("score"))
    first = classes.select("node", "first_id")
    involved = store(involved.join(first, "node"), "involved")
    sets = store(shingle_sets(docs, involved.select("node", "first_id")), "shingle-sets")

    # ``open_``: members of buckets that are still to be compared with each other.
    open_ = crowded.join(involved.select("node", "score"), "node").withColumn("comp", F.col("node"))
    open_ = open_.select("bucket", "node", "n_shingles", "score", "comp")
    links = None
    for k in range(STARS):
        hubs = open_.groupBy("bucket").agg(F.max(F.struct("score", "node", "n_shingles", "comp")).alias("hub"))
        faced = store(open_.join(hubs, "bucket").filter("node != hub.node"), f"star-{k}")
        least, most = F.least("n_shingles", "hub.n_shingles"), F.greatest("n_shingles", "hub.n_shingles")
        pairs = (
            faced.filter((F.col("comp") != F.col("hub.comp")) & (100 * least >= percent * most))
            .select(F.col("hub.node").alias("hub"), F.col("node").alias("member"))
            .distinct()
        )
        found = confirm(pairs, sets, percent)
        links = store(found if links is None else links.unionByName(found), f"links-{k}")
        comps = components(links).withColumnRenamed("component", "new_comp")
        # The hub has met all others and goes; a bucket of one component is done.
        moved = faced.join(comps, "node", "left").withColumn("comp", F.coalesce("new_comp", "node"))
        moved = store(moved.select("bucket", "node", "n_shingles", "score", "comp"), f"open-{k}")
        several = moved.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1")
        open_ = moved.join(several.select("bucket"), "bucket")
    return links.unionByName(settle_buckets(open_.select("bucket", "node", "comp"), sets, percent))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """What near_duplicates returns, text_hash, and component: the name of the group, null for texts without words."""
    rows = store(described(docs, percent), "signatures")
    classes = store(
        rows.filter("node is not null")
        .groupBy("node", "n_shingles")
        .agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")),
        "classes",
    )
    found = components(class_links(docs, classes, percent))
    placed = (
        classes.select("node", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = store(placed.join(least, "component").select("node", "component", "component_id"), "components")
    joined = rows.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "text_hash", "n_shingles", "component",
        component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; similar by ``percent`` or more are linked.

    Texts without words, null ones too, are linked with nothing. Rows with one
    shingle set are linked, also where they have one id. component_id is the
    least id that is not null; where all are null it is null, and all are
    kept. An empty table gives no rows. The result is a stored table; the tables on
    the way to it go.
    """
    with temporary(docs.sparkSession):
        found = _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")
        return store(found, "near-duplicates", lasting=True)


def drop_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group: of those with the least id the one whose text's hash is least.

    Texts without words are groups of their own, but for rows with one id and
    one text. Of rows with one id and one text that with the least other columns stays.
    """
    alone = F.col("component").isNull()
    with temporary(docs.sparkSession):
        rows = _grouped(docs, percent).filter("kept")
        counts = rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
        group = ("component", F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("text_hash")).alias("hash"))
        # All kept rows of a group have one id.
        one = counts.groupBy(*group).agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("one"))
        one = one.select(F.col("one.doc_id").alias("__kept"), F.col("one.text_hash").alias("__kept_hash"), F.col("one.rows").alias("__rows"))
        chosen = store(one, "kept-rows", lasting=True)
    at = F.col("doc_id").eqNullSafe(F.col("__kept")) & (text_hash() == F.col("__kept_hash"))
    once = docs.join(chosen.filter("__rows = 1"), at).select(*docs.columns)
    # Only rows that are there more than once are brought together.
    more = docs.join(chosen.filter("__rows > 1"), at).groupBy("__kept", "__kept_hash")
    least = more.agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return once.unionByName(least.select("__row.*"))
