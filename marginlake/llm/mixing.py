"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, up to three times
over. A document's virtual finish time is the words of its queue up to its end,
divided by the source's weight. Served in the order of finish times, queues
advance in proportion to their weights until they are empty; cutting the order
where the total budget is spent gives every source its weight's share but for
less than a document, and a queue that ran dry leaves its share to the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlake.llm.common import WORD, store

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
EPOCHS = 3
#: Turns of a range of the order of service, about: the range in which the budget ends is searched by one task.
RANGE_TURNS = 20_000
#: Parts that a queue's shuffled order is cut into; sums run within and over parts.
PARTS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """A fixed random place: MD5 of seed and id, in hexadecimal."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with weight, clock, target.

    ``clock`` is the virtual time at which the budget (all sizes) is spent:
    a source's target is weight times clock, or ``epochs`` times its size if
    that is less. Rows are one for each source, by code point, null last.
    Sources without words get target 0.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(names) - 1) % len(weights) + 1)
    # In the order in which queues run dry. Words served by time V are a concave
    # curve of straight pieces, so the latest time at which one of the straight
    # lines meets the budget is the time at which the curve does.
    dry = Window.orderBy("dry_at", F.col("source").asc_nulls_last())
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    rest = dry.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("full", epochs * F.col("source_size"))
        .withColumn("dry_at", F.col("full") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("clock", F.max(F.col("left") / F.sum("weight").over(rest)).over(everything))
        .withColumn("target", F.least(F.col("weight") * F.col("clock"), F.col("full").cast("double")))
        .select("source", "source_size", "weight", "clock", "target")
    )


def queues(
    docs: DataFrame, seed: str, weights=WEIGHTS, epochs: int = EPOCHS, parts: int = PARTS, sizes: DataFrame | None = None
) -> DataFrame:
    """doc_id, source, size -> with source_size, weight, target, ``queue_end``: words of the queue up to the document's end.

    The place in the queue is uniform, so that cutting it by its leading hex
    digits gives even parts of even the largest source: sums run within parts,
    then over the few sums of parts, and all joins are on source and part.
    """
    digits = len(f"{max(parts, 2) - 1:x}")
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))

    def place(df: DataFrame) -> DataFrame:
        put = df.withColumn("queue", name).withColumn("place", shuffle_key(F.col("doc_id"), seed))
        return put.withColumn("part", F.substring("place", 1, digits))

    placed = place(docs)
    inside = (
        Window.partitionBy("queue", "part")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = place(docs if sizes is None else sizes).groupBy("queue", "source", "part").agg(F.sum("size").alias("__sum"))
    per_source = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, epochs)
    goal = per_source.select(name.alias("queue"), "source_size", "weight", "target")
    parted = (
        sums.select("queue", "part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
        .join(goal, "queue")
    )
    return (
        placed.withColumn("__upto", F.sum("size").over(inside))
        .join(parted, ["queue", "part"])
        .withColumn("queue_end", F.col("__upto") + F.col("__ahead"))
        .drop("queue", "part", "__upto", "__ahead")
    )


def finish(epoch: int) -> Column:
    """Virtual time at which a document's ``epoch``-th turn ends."""
    return (epoch * F.col("source_size") + F.col("queue_end")) / F.col("weight")


#: The order of service: finish time, ties by place, source and turn. No two turns with words are equal in it.
SERVICE = ("finish", "place", "queue", "epoch")


def cut(queued: DataFrame, epochs: int = EPOCHS) -> tuple | None:
    """Where the budget (all words of the documents) ends in the order of service: its key, and the words taken of that turn.

    All turns are range-sorted by finish time. The words of the partitions, one
    row each, say in which one the budget ends; there the running words say at
    which turn. None if there are no words.
    """
    turns = [F.struct(finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in range(epochs)]
    served = queued.filter("size > 0").select("place", _queue().alias("queue"), "size", F.inline(F.array(*turns)))
    budget, count = served.filter("epoch = 0").agg(F.sum("size"), F.count("*")).first()
    if budget is None:
        return None
    ranges = math.ceil(epochs * count / RANGE_TURNS)
    parts = store(served.repartitionByRange(ranges, *SERVICE).withColumn("part", F.spark_partition_id()), "mix-turns")
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.groupBy("part").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running))
    last = sums.filter(F.col("upto") >= budget).orderBy("part").first()
    left = budget - (last["upto"] - last["words"])
    inside = Window.orderBy(*SERVICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = (
        parts.filter(F.col("part") == last["part"])  # one partition of the range sort
        .withColumn("upto", F.sum("size").over(inside))
        .filter(F.col("upto") >= left)
        .orderBy("upto")
        .first()
    )
    return (*[row[c] for c in SERVICE], left - (row["upto"] - row["size"]))


def _queue() -> Column:
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))


def taken(epoch: int, at: tuple | None) -> Column:
    """Words that are taken of a document in its ``epoch``-th turn: all if it ends before the cut ``at``."""
    nothing = F.lit(0).cast("long")
    if at is None:
        return nothing
    key = F.struct(finish(epoch).alias("a"), F.col("place").alias("b"), _queue().alias("c"), F.lit(epoch).alias("d"))
    end = F.struct(F.lit(at[0]).alias("a"), F.lit(at[1]).alias("b"), F.lit(at[2]).alias("c"), F.lit(at[3]).alias("d"))
    some = F.when(key < end, F.col("size")).when(key == end, F.lit(at[4]).cast("long")).otherwise(nothing)
    return F.when(F.col("size") > 0, some).otherwise(nothing)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of all documents."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def take(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken.

    Null texts and texts without a word have size 0 and take nothing. Rows of
    one id are documents of their own. An empty table gives no rows. Texts are
    read once, for the sizes.
    """
    rows = store(sized(docs), "mix-sizes")
    queued = store(queues(rows, seed, weights, epochs), "mix-queues")
    at = cut(queued, epochs)
    total = sum((taken(e, at) for e in range(1, epochs)), taken(0, at))
    return queued.withColumn("taken", total).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents themselves, globally sorted by virtual finish time and cut at the budget.

    A document appears once for each turn in which it is taken; where the
    budget ends within it, with its first ``taken`` words, one blank between
    them. The columns are those of ``docs``; n_chars, if there, is
    that of the new text. Documents without words are not taken.
    """
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    sizes = store(sized(docs), "mix-sizes")
    at = cut(store(queues(sizes, seed, weights, epochs), "mix-queues"), epochs)
    turns = F.array(
        *[
            F.struct(
                F.lit(e).alias("epoch"),
                taken(e, at).alias("taken"),
                finish(e).alias("finish"),
            )
            for e in range(epochs)
        ]
    )
    served = (
        queues(rows, seed, weights, epochs, sizes=sizes)
        .withColumn("turn", F.explode(F.filter(turns, lambda t: t["taken"] > 0)))
        .orderBy("turn.finish", "place", _queue(), "turn.epoch")
    )
    whole = F.col("turn.taken") == F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("turn.taken").cast("int")), " ")
    text = F.when(whole, F.col("row.text")).otherwise(first)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return served.select(
        *[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


#: Results of SQL below equal those of ``take`` with its defaults.
SQL = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), per_source as (
  select source, sum(size)::bigint as source_size from docs group by source
), weighted as (
  select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight,
    3 * source_size as full_size
  from per_source
), lines as (
  select *, ((select sum(source_size) from per_source)
      - coalesce(sum(full_size) over (order by full_size / weight, source nulls last
          rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by full_size / weight, source nulls last
          rows between current row and unbounded following) as meets
  from weighted
), goals as (
  select source, source_size, weight, least(weight * (select max(meets) from lines), full_size::double) as target from lines
), queued as (
  select d.doc_id, d.source, d.size, g.source_size, g.target, g.weight, md5('mix' || coalesce(d.doc_id::varchar, 'null')) as place,
    case when d.source is null then '' else 's' || d.source end as queue,
    (sum(d.size) over (partition by d.source order by md5('mix' || coalesce(d.doc_id::varchar, 'null')), d.doc_id, d.size
        rows between unbounded preceding and current row))::bigint as queue_end
  from docs d join goals g on d.source is not distinct from g.source
), turns as (
  select *, (epoch * source_size + queue_end) / weight as finish from queued, range(3) t(epoch) where size > 0
), served as (
  select *, (sum(size) over (order by finish, place, queue, epoch rows between unbounded preceding and current row))::bigint - size as before
  from turns
), cut as (
  select queue, queue_end, sum(greatest(0, least(size, (select sum(size) from docs) - before))) as taken from served group by 1, 2
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(c.taken, 0)::bigint as taken
from queued q left join cut c on c.queue = q.queue and c.queue_end = q.queue_end and q.size > 0
"""
