"""Short codes of vectors: a codebook for each part, learned by member-resident Lloyd rounds.

A vector is cut into PARTS equal parts; every part is a member of the entry of
its position's codebook that it is nearest to. Members live where their entry
is owned: rows are partitioned by (position, entry, salt), the salt bounding what
one owner holds. A round

1. reads the members where they are and assigns them under the new codebooks;
   those that stay are summed in place;
2. moves only the parts that change their entry, in one shuffle to the new owner;
3. sums what came, adds what stayed, and so has the next codebooks.

Nothing that stays is written again, and nothing marks what left: a task knows
the codebooks of all rounds (they are bounded), so it sees whether a part that
came in round k has left since. The price is one more assignment, in numpy, for
each round that a part has stayed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marginlake.llm.common import by_batch, slices, store, struct, temporary

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Members of one position that share a salt; an owner holds these at most.
MEMBERS = 100_000
_MEMBER = struct("position int, entry int, salt int, since int, part binary, count long, totals longs")
_SUMS = struct("position int, entry int, at int, total long, count long")


class Codebooks:
    """``entries``: integers by part, entry, place within the part; ``width``: length of the vectors."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries, width

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of vectors without null or non-finite components whose length can be cut into PARTS."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.size("embedding")
    kept = F.col("embedding").isNotNull() & finite & (length > 0) & (length % PARTS == 0)
    return vectors.select("vec_id", "label", "embedding").filter(kept)


def _order() -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]


def largest(width: int) -> int:
    """Scaled components beyond this count as this, so that a vector's error fits 64 bits."""
    return 1 << ((62 - math.ceil(math.log2(4 * width))) // 2)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a batch of vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    limit = largest(width)
    return np.clip(np.floor(np.clip(values, -limit, limit) * SCALE), -limit, limit).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every part, the lower one on a tie, and the squared distance."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    at = np.zeros(len(parts), np.int64)
    for e, entry in enumerate(entries):
        far = np.square(parts - entry).sum(axis=1)
        closer = far < best
        best[closer], at[closer] = far[closer], e
    return at, best


def _batch(**columns) -> pa.RecordBatch:
    target = to_arrow_schema(_MEMBER)
    n = len(next(iter(columns.values())))
    cols = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in target]
    return pa.RecordBatch.from_arrays(cols, schema=target)


def _packed(parts: np.ndarray) -> list[bytes]:
    data, step = parts.astype("<i8").tobytes(), 8 * parts.shape[1]
    return [data[i : i + step] for i in range(0, len(data), step)]


def _unpacked(column: pa.Array) -> np.ndarray:
    column = column.drop_null()
    data = np.frombuffer(b"".join(column.to_pylist()), "<i8")
    return data.reshape(len(column), -1) if len(column) else data.reshape(0, 1)


class _Sums:
    """Counts and totals of an owner's members by position and entry."""

    def __init__(self, entries: np.ndarray):
        self.counts = np.zeros(entries.shape[:2], np.int64)
        self.totals = np.zeros(entries.shape, np.int64)

    def add(self, position: np.ndarray, entry: np.ndarray, parts: np.ndarray) -> None:
        if len(parts):
            k = self.counts.shape[1]
            order = np.argsort(position * k + entry, kind="stable")
            place = (position * k + entry)[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            p, e = np.divmod(place[first], k)
            self.totals[p, e] += np.add.reduceat(parts[order], first, axis=0)
            self.counts[p, e] += np.diff(np.r_[first, len(place)])


def _arrivals(good: DataFrame, entries: np.ndarray, width: int, salts: int) -> DataFrame:
    """Round 1: every part moves to the owner of its nearest entry."""
    part = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches):
            x = scaled(batch.column("embedding"), width)
            salt = (seen + np.arange(len(x))) % salts  # the order within a split of a file is fixed
            seen += len(x)
            for p in range(PARTS):
                own = x[:, p * part : (p + 1) * part]
                entry, _ = nearest(own, entries[p])
                where = np.full(len(x), p)
                yield _batch(position=where, entry=entry, salt=salt, since=np.full(len(x), 1), part=_packed(own))

    return good.select("embedding").mapInArrow(run, _MEMBER)


def _resettled(members: DataFrame, books: list[np.ndarray], now: int) -> DataFrame:
    """Round ``now``: parts that change their entry, with the new one, and sums of those that stay.

    ``books[k]`` are the entries under which round ``k`` assigned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = _Sums(books[now])
        for batch in batches:
            position, entry, salt, since = (batch.column(c).to_numpy() for c in ("position", "entry", "salt", "since"))
            x = _unpacked(batch.column("part"))
            resident, new = np.ones(len(x), bool), entry.copy()
            for k in range(int(since.min(initial=now)) + 1, now + 1):
                for p in range(PARTS):
                    asked = np.flatnonzero(resident & (position == p) & (since < k))
                    found, _ = nearest(x[asked], books[k][p])
                    if k < now:
                        resident[asked] = found == entry[asked]  # else it left in round k and lives elsewhere
                    else:
                        new[asked] = found
            stays = resident & (new == entry)
            stay.add(position[stays].astype(np.int64), entry[stays].astype(np.int64), x[stays])
            goes = np.flatnonzero(resident & (new != entry))
            if len(goes):
                yield _batch(
                    position=position[goes], entry=new[goes], salt=salt[goes],
                    since=np.full(len(goes), now), part=_packed(x[goes]),
                )
        p, e = np.nonzero(stay.counts)
        if len(p):
            totals = [t.tolist() for t in stay.totals[p, e]]
            yield _batch(position=p, entry=e, salt=np.zeros(len(p)), since=np.full(len(p), now), count=stay.counts[p, e], totals=totals)

    return members.mapInArrow(run, _MEMBER)


def _summed(came: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """position, entry, at, total, count over the members that came and the sums of those that stayed."""
    target = to_arrow_schema(_SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums(np.zeros(shape, np.int64))
        for batch in batches:
            position, entry = (batch.column(c).to_numpy().astype(np.int64) for c in ("position", "entry"))
            here = np.asarray(batch.column("part").is_valid())
            held.add(position[here], entry[here], _unpacked(batch.column("part")))
            rest = ~here
            if rest.any():
                np.add.at(held.counts, (position[rest], entry[rest]), batch.column("count").drop_null().to_numpy())
                totals = batch.column("totals").drop_null().flatten().to_numpy().reshape(-1, shape[2])
                np.add.at(held.totals, (position[rest], entry[rest]), totals)
        p, e = np.nonzero(held.counts)
        at = np.tile(np.arange(shape[2]), len(p))
        p, e = np.repeat(p, shape[2]), np.repeat(e, shape[2])
        cols = (p, e, at, held.totals[p, e, at], held.counts[p, e])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return came.mapInArrow(run, _SUMS).groupBy("position", "entry", "at").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, members: int = MEMBERS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all usable vectors; None if there are none.

    The vectors' length is that of the first one (least vec_id); others of another
    length are left out. The first entries are the parts of the first ``entries``
    vectors: least vec_ids, ties by the vector, null ids last. The driver holds
    these and one total for each number of the codebooks.
    """
    good = usable(vectors)
    first = good.orderBy(*_order()).select(F.size("embedding").alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    good = good.filter(F.size("embedding") == width)
    seeds = scaled(pa.array([r["embedding"] for r in good.orderBy(*_order()).limit(entries).collect()], pa.list_(pa.float64())), width)
    # books[k]: by position, entry, place within the part, as round k assigns.
    books = [None, seeds.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()]
    salts = max(1, math.ceil(good.count() / members))
    owner = ("position", "entry", "salt")
    tables: list[DataFrame] = []
    with temporary(vectors.sparkSession):
        for now in range(1, rounds + 1):
            if now == 1:
                moving = _arrivals(good, books[1], width, salts)
            else:
                resident = reduce(DataFrame.unionByName, tables).filter("part is not null")
                moving = _resettled(resident.select("position", "entry", "salt", "since", "part"), books, now)
            tables.append(store(moving.repartition(*owner), f"members-{now}"))
            book = books[now].copy()
            for r in _summed(tables[-1], book.shape).collect():
                book[r["position"], r["entry"], r["at"]] = r["total"] // r["count"]
            books.append(book)
    return Codebooks(books[-1], width)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of all usable vectors of the codebooks' length: one map, no shuffle.

    ``code``: the index of the nearest entry of each part, two hex digits each.
    """
    width, part, entries = books.width, books.width // PARTS, books.entries

    def make():
        def step(cols):
            x = scaled(cols["embedding"], width)
            found = [nearest(x[:, p * part : (p + 1) * part], entries[p]) for p in range(PARTS)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = np.sum([far for _, far in found], axis=0, dtype=np.int64)
            return {"vec_id": cols["vec_id"], "label": cols["label"], "code": [c.tobytes().hex() for c in codes], "error": error}

        return step

    good = usable(vectors).filter(F.size("embedding") == width)
    kinds = good.schema
    return by_batch(good, make, [("vec_id", kinds["vec_id"].dataType), ("label", kinds["label"].dataType), ("code", "string"), ("error", "long")])


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for every usable vector; a stored table.

    Vectors that are null, empty or hold null or non-finite components are left
    out, as are those whose length differs from that of the least vec_id or cannot be cut into
    PARTS. Scaled components beyond ``largest`` count as that. Repeated rows are
    vectors of their own. label_error sums error over equal labels, nulls
    together; null where the sum exceeds 64 bits. An empty table gives no rows.
    Other columns are ignored.
    """
    books = train(vectors)
    with temporary(vectors.sparkSession):
        if books is None:
            coded = vectors.select("vec_id", "label").limit(0).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
            coded = store(coded, "codes", lasting=True)
        else:
            coded = store(encode(vectors, books), "codes", lasting=True)
        # Stored, so that its size is known: broadcast if small, else joined by sorting.
        sums = coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
        sums = store(sums, "label-errors", lasting=True)
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    return found.withColumn("codebooks_sha256", F.lit(books.sha256() if books else None).cast("string"))


def _sql() -> str:
    """The same rounds in plain SQL, one after the other."""
    distance = f"list_sum([(x.part[i] - c.entry[i]) * (x.part[i] - c.entry[i]) for i in range(1, len(x.part) + 1)])"
    steps = [
        f"""v as materialized (
  select row_number() over (order by vec_id) as r, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), x as materialized (
  select r, vec_id, label, p, [floor({SCALE} * e::double)::bigint for e in
      embedding[p * (len(embedding) // {PARTS}) + 1 : (p + 1) * (len(embedding) // {PARTS})]] as part
  from v, range({PARTS}) t(p)
), c0 as materialized (select p, r - 1 as e, part as entry from x where r <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} as materialized (
  select x.r, x.vec_id, x.label, x.p, any_value(x.part) as part, min(struct_pack(d := {distance}, e := c.e)) as best
  from x join c{k} c on c.p = x.p group by all
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k} as materialized (
  select p, best.e as e, i, sum(part[i])::hugeint as total, count(*)::hugeint as n
  from a{k}, (select unnest(range(1, (select max(len(part)) + 1 from x))) as i) group by all
), m{k} as materialized (
  -- floor(total / n) in whole numbers
  select p, e, list(total - ((total % n) + n) % n order by i) as low, any_value(n) as n from s{k} group by p, e
), c{k + 1} as materialized (
  select c.p, c.e, case when m.n is null then c.entry else [(y / m.n)::bigint for y in m.low] end as entry
  from c{k} c left join m{k} m on m.p = c.p and m.e = c.e
)"""
            )
    return (
        "with "
        + ", ".join(steps)
        + f""", found as (
  select vec_id, r, any_value(label) as label, string_agg(lpad(printf('%x', best.e), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error
  from a{ROUNDS} group by vec_id, r
), book as (
  select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from found, book
"""
    )


SQL = _sql()
