"""Near-duplicate vectors: learned binary codes, multi-index Hamming tables, exact rerank.

1. Equal vectors are one class; only classes go on.
2. Iterative quantisation: rotations of the centred vectors are learned so that
   the signs are balanced and lose little. A code is cut into substrings of
   ``bits`` bits (growing with the logarithm of the classes) and has as many of
   them as a pair at the threshold needs to share one with a chance of 1 - MISS,
   by the rate at which its signs differ on the sample.
3. Multi-index tables: classes that agree in substring t meet in a bucket. There
   the first 64 bits of their codes are compared; only members with another one
   within ``near`` bits go on, so a bucket that chance fills ships no vectors.
4. Rerank: what is left meets again with the original vectors, in blocks. All
   cosines are computed in double precision; a pair counts in the first table
   that it shares, so that it counts once. Tasks return link counts for each class and
   a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import by_batch, slices, store, struct, temporary
from marginlake.llm.graph import components

#: Pairs of at least this cosine are linked.
COSINE = 0.95
#: Values of the sample on which rotations are learned: at most so many, whatever the table's size.
SAMPLE_VALUES = 1_000_000
#: How likely a pair at the threshold may share no table.
MISS = 1e-6
#: How likely its first 64 bits may differ by more than is looked for.
FAR = 1e-6
#: As many standard deviations: FAR of a normal distribution lies beyond.
DEVIATIONS = 4.75
#: Members of a table's bucket that chance alone brings, about.
CROWD = 8
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 1024
_ROUNDS = 30


class Hashing:
    """``mean``; ``projections`` (length x bits in all); ``bits`` of a table, ``tables``, and ``near`` of 64."""

    def __init__(self, mean: np.ndarray, projections: np.ndarray, bits: int, tables: int, near: int):
        self.mean, self.projections, self.bits, self.tables, self.near = mean, projections, bits, tables, near

    def signs(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.projections >= 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """A number for each table: the substring's bits."""
        own = signs[:, : self.tables * self.bits].reshape(len(signs), self.tables, self.bits)
        return own @ (1 << np.arange(self.bits, dtype=np.int64))

    def first64(self, signs: np.ndarray) -> np.ndarray:
        return np.packbits(signs[:, :64], axis=1, bitorder="little").view("<i8").ravel()


def valid(vector: Column) -> Column:
    """Not null, nothing in it null or non-finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def quantised(sample: np.ndarray, blocks: int, seed: int = 7) -> np.ndarray:
    """Projections of ``blocks`` learned rotations, side by side.

    Each rotation starts at random and alternates between signs and the rotation
    that brings the vectors nearest to them (orthogonal Procrustes).
    """
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(blocks):
        turn, _ = np.linalg.qr(rnd.normal(size=(sample.shape[1], sample.shape[1])))
        for _ in range(_ROUNDS):
            signs = np.where(sample @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ signs)
            turn = left @ right
        out.append(turn)
    return np.hstack(out)


def fit(sample: np.ndarray, classes: int, cosine: float = COSINE) -> Hashing:
    """Learn rotations on unit vectors; tables are laid out for ``classes`` of them."""
    rnd = np.random.default_rng(11)
    width = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(28, max(8, math.ceil(math.log2(max(classes, 2) / CROWD))))
    # Partners at exactly the threshold, in any direction, tell how often signs differ.
    aside = rnd.normal(size=sample.shape)
    aside -= np.einsum("ij,ij->i", aside, sample)[:, None] * sample
    length = np.sqrt(np.einsum("ij,ij->i", aside, aside))[:, None]
    partner = cosine * sample + math.sqrt(1 - cosine**2) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    first = quantised(centred, max(1, math.ceil(64 / width)))
    differ = ((centred @ first >= 0) != ((partner - mean) @ first >= 0)).mean(axis=1)
    agree = float(np.mean((1 - differ) ** bits))  # the chance of sharing a table, over pairs
    tables = min(512, math.ceil(math.log(MISS) / math.log1p(-min(agree, 0.999))))
    more = math.ceil(tables * bits / width) - first.shape[1] // width
    projections = np.hstack([first, quantised(centred, more, seed=8)]) if more > 0 else first
    off = (((centred @ projections[:, :64]) >= 0) != (((partner - mean) @ projections[:, :64]) >= 0)).sum(axis=1)
    spread = math.sqrt(float(off.var()) + 1e-9)
    near = min(64, math.ceil(float(off.mean()) + DEVIATIONS * spread + 1))
    return Hashing(mean, projections, bits, tables, near)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, h1, h2; hashes null where nothing can be linked) and classes (node, h1, h2, vector, size, least)."""
    # Two hashes with different seeds name a vector by 128 bits.
    here = valid(F.col("embedding"))
    hashed = vectors.select(
        "vec_id", "embedding",
        F.when(here, F.xxhash64("embedding")).alias("h1"), F.when(here, F.xxhash64(F.lit(7), "embedding")).alias("h2"),
    )
    classes = hashed.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.first("embedding").alias("vector"), F.count("*").alias("size"), F.min("vec_id").alias("least")
    )
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    return hashed.drop("embedding"), classes


def coded(classes: DataFrame, hashing: Hashing, width: int) -> DataFrame:
    """node, size, first64, keys of every class: computed once, so that all later steps agree on them."""

    def make():
        def step(cols):
            signs = hashing.signs(units(cols["vector"], width))
            keys = hashing.keys(signs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, hashing.tables), pa.int32()), pa.array(keys.ravel(), pa.int32()))
            return {"node": cols["node"], "first64": hashing.first64(signs), "keys": flat}

        return step

    return by_batch(classes.select("node", "vector"), make, "node long, first64 long, keys ints")


def _dealt(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """Members with the pairs of blocks (i, j) of their bucket that they are compared in; side: 0 in i, 1 in j.

    ``crowded``: bucket, blocks of buckets with more than one block.
    """
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    placed = members.join(crowded, "bucket", "left").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = [c for c in members.columns if c != "bucket"]
    return placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *rest)


def _crowded(members: DataFrame, name: str) -> DataFrame:
    """Stored, so that its size is known: there are few buckets of more than BLOCK members."""
    counts = members.groupBy("bucket").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > BLOCK)
    return store(counts.select("bucket", F.ceil(F.col("crowd") / BLOCK).cast("int").alias("blocks")), name)


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """bucket, i, j and the columns' parts of each group of rows sorted by these; a group has at most two blocks, about."""
    held, parts = None, []
    for batch in batches:
        b, i, j = (batch.column(c).to_numpy() for c in ("bucket", "i", "j"))
        cols = [batch.column(c) for c in columns]
        cuts = np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            key = (int(b[start]), int(i[start]), int(j[start]))
            if key != held:
                if held is not None:
                    yield (*held, parts)
                held, parts = key, []
            parts.append([c.slice(start, stop - start) for c in cols])
    if held is not None:
        yield (*held, parts)


def _sides(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the one block and of the other; the same rows twice for a block with itself."""
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


_LIVE = struct("bucket long, node long")


def alive(members: DataFrame, near: int) -> DataFrame:
    """bucket, node of members (bucket, node, first64) with another one within ``near`` bits in the bucket."""
    dealt = _dealt(members, _crowded(members, "crowded-buckets")).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    names = ("bucket", "i", "j", "block", "node", "first64")

    def run(batches):
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            rows = rows if rest is None else [np.concatenate(pair) for pair in zip(rest, rows, strict=True)]
            # The last group may go on in the next batch; a group has two blocks at most, about.
            key = rows[:3]
            last = np.flatnonzero(np.logical_and.reduce([k == k[-1:] for k in key]))
            cut = int(last[0]) if len(last) else 0
            rest = [c[cut:] for c in rows]
            yield from _live(*[c[:cut] for c in rows], near)
        if rest is not None:
            yield from _live(*rest, near)

    return dealt.mapInArrow(run, _LIVE).distinct()


#: Groups up to this size are compared all at once, row by row with the rows behind; larger ones by themselves.
_SMALL = 64


def _live(bucket, i, j, block, node, code, near) -> Iterator[pa.RecordBatch]:
    """Members of whole groups of sorted rows that have another one nearby; of two blocks only across them."""
    if len(node) < 2:
        return
    code = code.view(np.uint64)
    changes = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.r_[0, np.flatnonzero(changes) + 1]
    sizes = np.diff(np.r_[starts, len(node)])
    group = np.repeat(np.arange(len(starts)), sizes)
    found = np.zeros(len(node), bool)
    small = sizes[group] <= _SMALL
    for step in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
        one = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        if not len(one):
            break
        close = np.bitwise_count(code[one] ^ code[one + step]) <= near
        one = one[close & ((i[one] == j[one]) | (block[one] != block[one + step]))]
        found[one] = found[one + step] = True
    for g in np.flatnonzero(sizes > _SMALL):
        own = slice(starts[g], starts[g] + sizes[g])
        left, right = _sides(block[own], i[starts[g]], j[starts[g]])
        left, right = left + starts[g], right + starts[g]
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            close = np.bitwise_count(code[part][:, None] ^ code[right][None, :]) <= near
            close &= part[:, None] != right[None, :]
            found[part] |= close.any(axis=1)
            found[right] |= close.any(axis=0)
    if found.any():
        yield pa.RecordBatch.from_arrays([pa.array(bucket[found]), pa.array(node[found])], names=["bucket", "node"])


_FOUND = struct("node long, links long, other long")


def linked(members: DataFrame, width: int, cosine: float = COSINE) -> DataFrame:
    """node, links, other from members (bucket, node, size, keys, vector).

    A row holds rows that a class is linked with, all that one bucket finds first, or (other not
    null) a link of a spanning forest of the group.
    """
    dealt = _dealt(members, _crowded(members, "crowded-live")).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def run(batches):
        for bucket, i, j, parts in _groups(slices(batches), ("block", "node", "size", "keys", "vector")):
            block, node, size = (np.concatenate([p[k].to_numpy() for p in parts]) for k in range(3))
            if len(node) < 2:
                continue
            keys = np.concatenate([p[3].flatten().to_numpy().reshape(len(p[3]), -1) for p in parts])
            x = np.concatenate([units(p[4], width) for p in parts])
            yield from _compared(bucket >> 32, _sides(block, i, j), node, size, keys, x, cosine)

    return dealt.mapInArrow(run, _FOUND)


def _compared(t: int, sides, node, size, keys, x, cosine) -> Iterator[pa.RecordBatch]:
    left, right = sides
    same = left is right or (len(left) == len(right) and np.array_equal(left, right))
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    forest: list[tuple[int, int]] = []

    for at in range(0, len(left), 128):
        own = left[at : at + 128]
        a, b = np.nonzero(x[own] @ x[right].T >= cosine)
        a, b = own[a], right[b]  # both sides' rows ascend
        once = a < b if same else np.ones(len(a), bool)
        a, b = a[once], b[once]
        if t and len(a):
            # A pair counts in the first table that it shares.
            new = np.concatenate([~(keys[a[k : k + 4096], :t] == keys[b[k : k + 4096], :t]).any(axis=1) for k in range(0, len(a), 4096)])
            a, b = a[new], b[new]
        if not len(a):
            continue
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        # ``a`` ascends: one step for each row, and one for each component it joins.
        cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
        for n, others in zip(a[np.r_[0, cuts]].tolist(), np.split(b, cuts), strict=True):
            for met in np.unique(label[others]).tolist():
                if met != label[n]:
                    forest.append((n, int(others[label[others] == met][0])))
                    label[label == met] = label[n]
    some = np.flatnonzero(links)
    if len(some):
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), none], names=["node", "links", "other"])
    if forest:
        n, m = np.array(forest).T
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node[n]), none, pa.array(node[m])], names=["node", "links", "other"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding); a stored table.

    Vectors that are null, empty, zero or hold null or non-finite components are
    linked with nothing. Shorter vectors count as filled up with zeros. Equal
    vectors are linked, also in rows of one vec_id, each of which is a vector of
    its own. component_id is the least id that is not null; where all are null it
    is null, and all are kept. An empty table gives no rows. Other columns are ignored.
    """
    with temporary(vectors.sparkSession):
        rows, classes = _classes(vectors.select("vec_id", "embedding"))
        count, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
        if count:
            found = _found(classes, count, width, cosine)
        else:
            found = classes.select("node", "h1", "h2", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
        joined = rows.join(found.select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
        alone = F.col("h1").isNull()
        component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
        out = joined.select(
            "vec_id", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"), component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
        return store(out, "near-vectors", lasting=True)


def learn(classes: DataFrame, count: int, width: int, cosine: float = COSINE) -> Hashing:
    """Rotations from the classes with the least hashes: SAMPLE_VALUES / length of them, 200 at least."""
    sample = classes.orderBy("h1", "h2").select("vector").limit(max(200, SAMPLE_VALUES // width)).collect()
    sample = units(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), width)
    return fit(sample, count, cosine)


def _found(classes: DataFrame, count: int, width: int, cosine: float) -> DataFrame:
    """node, h1, h2, n_links, component_id of every class."""
    hashing = learn(classes, count, width, cosine)
    codes = store(coded(classes, hashing, width), "vector-codes")
    tables = F.posexplode("keys").alias("t", "key")
    members = codes.select("node", "first64", tables).select(
        (F.shiftleft(F.col("t").cast("long"), 32) + F.col("key")).alias("bucket"), "node", "first64"
    )
    live = store(alive(members, hashing.near), "live-members")
    # Each live class gets its vector once, then goes to its buckets with it.
    full = live.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most one a table
    full = full.join(codes.select("node", "keys"), "node").join(classes.select("node", "vector", "size"), "node")
    meeting = full.select(F.explode("buckets").alias("bucket"), "node", "size", "keys", "vector")
    found = store(linked(meeting, width, cosine), "vector-links")
    joined = components(found.filter("other is not null"), "node", "other")
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = classes.select("node", "h1", "h2", "size", "least").join(joined, "node", "left").join(counts, "node", "left")
    parts = parts.withColumn("component", F.coalesce("component", "node"))
    parts = store(parts, "linked-classes")
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    return store(parts.join(least, "component").select("node", "h1", "h2", links.alias("n_links"), "component_id"), "class-results")


SQL = f"""
with recursive v as materialized (
  select vec_id, embedding::double[] as x,
    coalesce(embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
      and len(list_filter(embedding, lambda e: e <> 0)) > 0, false) as ok
  from embeddings
), u as materialized (
  select vec_id, x, sqrt(list_inner_product(x, x)) as norm from v where ok
), linked as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
  where list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}
), reach(vec_id, seen) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from reach r join linked l on l.a = r.seen
), c as (select vec_id, min(seen) as component_id from reach group by 1
), n as (select a as vec_id, count(*) as n_links from linked group by 1)
select c.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = c.vec_id as kept
from c left join n on n.vec_id = c.vec_id
"""
