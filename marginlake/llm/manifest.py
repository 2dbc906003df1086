"""Merkle manifest of a dataset by butterfly exchange: every partition gets its upper proof on the way up.

1. Rows become leaves; only digests move from here. Positions within a source
   come from a range sort and the counts of its partitions.
2. RUN ** LOCAL consecutive leaves of a source are a partition: one row that
   holds them. It hashes its own subtree.
3. Butterfly: in round r the partitions that agree in all digits (base RUN) of
   their number but the r-th swap subtree roots, at most RUN of them. Each hashes
   the parent itself, so ancestors are hashed redundantly and nothing has to be
   sent back down: after the last round a partition knows the siblings of all levels and the root.
   Where the last subtree is short of members, those it has stand in for the others.
4. The subroots of the sources do the same among themselves.

Built-in functions only. No group has more than RUN ** LOCAL leaves or RUN roots.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import store, temporary
from marginlake.operators.positions import numbered

#: Children of a node.
RUN = 16
#: Levels that a partition hashes by itself.
LOCAL = 2
#: One document in so many is tampered with.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``<bytes>:<value>``, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    return digest(*[framed(replaced.get(c, F.col(c))) for c in FIELDS])


def lowered(text: Column) -> Column:
    """The tampering: A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, claimed: the leaf as it is found later, of some documents from another text."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        "doc_id", "source", leaf().alias("leaf"), F.when(struck, leaf(text=lowered(F.col("text")))).otherwise(leaf()).alias("claimed")
    )


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def parents(nodes: Column) -> Column:
    """Digests of every RUN consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(_joined(F.slice(nodes, k * RUN + 1, RUN)), 256))


def _beside(nodes: Column, at: Column) -> tuple[Column, Column]:
    """The siblings to the left and to the right of node ``at`` (from 0) within its run."""
    digit = at % RUN
    return _joined(F.slice(nodes, at - digit + 1, digit)), _joined(F.slice(nodes, at + 2, RUN - 1 - digit))


def _few(df: DataFrame, rows: int, together: int) -> DataFrame:
    """At most one partition for every ``together`` of the rows there are: no small files."""
    return df.coalesce(max(1, math.ceil(rows / together)))


def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partitions (tree, block, blocks, members) and sources (source, tree, leaves).

    A tree is named by the place of its first leaf among all. Sources ascend
    bytewise, null first; so do leaves by doc_id, then by digest.
    """
    found = store(found, "leaves")
    in_order = numbered(found, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    spans = in_order.groupBy(F.col("source").alias("__source")).agg(F.min("position").alias("tree"), F.count("*").alias("leaves"))
    spans = store(spans, "sources")
    width = RUN**LOCAL
    own = in_order.join(spans, F.col("source").eqNullSafe(F.col("__source")))
    own = own.withColumn("index", F.col("position") - F.col("tree"))
    blocks = own.groupBy(
        "tree", F.floor(F.col("index") / width).alias("block"), F.ceil(F.col("leaves") / width).alias("blocks")
    ).agg(F.array_sort(F.collect_list(F.struct("index", "doc_id", "leaf", "claimed"))).alias("members"))
    count = spans.agg(F.sum(F.ceil(F.col("leaves") / width))).first()[0] or 0
    return store(_few(blocks, count, 1000), "blocks"), spans.withColumnRenamed("__source", "source")


def hashed(blocks: DataFrame) -> DataFrame:
    """Columns l0, l1, l2: the partition's own levels; a level that the tree does not have repeats the one below."""
    deep = lambda below: (F.col("blocks") > 1) | (F.size(below) > 1)
    blocks = blocks.withColumn("l0", F.transform("members", lambda m: m["leaf"]))
    for k in range(LOCAL):
        below = F.col(f"l{k}")
        blocks = blocks.withColumn(f"l{k + 1}", F.when(deep(below), parents(below)).otherwise(below))
    return blocks


_SIDES = "array<struct<left:string,right:string>>"


def butterfly(nodes: DataFrame, most: int, run: int = RUN) -> DataFrame:
    """tree, index, root, above from nodes (tree, index, nodes, digest), of which no tree has more than ``most``.

    ``above``: for each level, from below, the siblings to the left and to the
    right, joined. ``nodes`` is the number of the tree's nodes.
    """
    state = nodes.withColumn("above", F.array().cast(_SIDES))
    stride, most = 1, most
    while most > 1:
        high = F.floor(F.col("index") / stride)
        low = F.col("index") % stride
        active = F.col("nodes") > stride  # else the tree has one node left
        size = F.least(F.lit(stride), F.col("nodes") - high * stride)
        # Members of a short subtree stand in for those it lacks, if others will ask for them.
        stands_in = active & (size < stride) & (high % run > 0)
        lows = F.when(stands_in, F.sequence(low, F.lit(stride - 1).cast("long"), size)).otherwise(F.array(low))
        sent = state.select(
            "tree", "nodes", "index", "digest", "above", low.alias("own"), F.floor(high / run).alias("group"),
            (high % run).alias("digit"), F.explode(lows).alias("low"),
        )
        message = F.struct(
            "digit", "digest", F.when(F.col("low") == F.col("own"), F.col("index")).alias("index"),
            F.when(F.col("low") == F.col("own"), F.col("above")).alias("above"),
        )
        met = sent.groupBy("tree", "nodes", "group", "low").agg(F.collect_list(message).alias("met"))
        in_order = F.array_sort("met", lambda a, b: (a["digit"] - b["digit"]).cast("int"))
        met = met.withColumn("met", in_order).withColumn("digests", F.transform("met", lambda m: m["digest"]))
        met = met.withColumn("parent", F.sha2(_joined(F.col("digests")), 256))
        one = met.select("tree", "nodes", "digests", "parent", F.explode(F.filter("met", lambda m: m["index"].isNotNull())).alias("m"))
        at = F.col("m.digit").cast("int")
        sides = F.struct(
            _joined(F.slice("digests", F.lit(1), at)).alias("left"), _joined(F.slice("digests", at + 2, F.lit(run))).alias("right")
        )
        state = one.select(
            "tree", F.col("m.index").alias("index"), "nodes",
            F.when(active, F.col("parent")).otherwise(F.col("m.digest")).alias("digest"),
            F.when(active, F.concat(F.col("m.above"), F.array(sides))).otherwise(F.col("m.above")).alias("above"),
        )
        stride, most = stride * run, math.ceil(most / run)
    return state.select("tree", "index", F.col("digest").alias("root"), "above")


def _folded(start: Column, sides: Column) -> Column:
    return F.aggregate(sides, start, lambda held, s: F.sha2(F.concat(s["left"], held, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for every row; a stored table.

    Null values are framed as ``-``, also a null doc_id, which is never tampered
    with and comes first in its source. Rows of one doc_id are leaves of their
    own, ordered by their digests; equal rows have equal leaves. The null source is
    a source of its own. A table of one row has that leaf as root and the digest of
    nothing as proof. An empty table gives no rows. Other columns are ignored.
    """
    with temporary(docs.sparkSession):
        blocks, sources = placed(leaves(docs.select(*FIELDS)))
        levels = hashed(blocks)
        most, count, trees = blocks.agg(F.max("blocks"), F.count("*"), F.count_distinct("tree")).first()
        roots = levels.select("tree", F.col("block").alias("index"), F.col("blocks").alias("nodes"), F.col(f"l{LOCAL}")[0].alias("digest"))
        upper = store(_few(butterfly(roots, most or 0).withColumnRenamed("root", "subroot"), count, 5000), "upper-proofs")
        heads = numbered(upper.filter("index = 0").select("tree", "subroot"), [F.col("tree").asc()], "place")
        heads = heads.select(
            F.lit(0).cast("long").alias("tree"), (F.col("place") - 1).alias("index"), F.lit(trees).cast("long").alias("nodes"),
            F.col("subroot").alias("digest"), F.col("tree").alias("own"),
        )
        tops = butterfly(heads.drop("own"), trees).select("index", "root", F.col("above").alias("over"))
        tops = heads.select("index", F.col("own").alias("tree")).join(tops, "index").join(sources, "tree")
        tops = store(_few(tops.select("tree", "source", "root", "over"), trees, 5000), "source-proofs")
        upper = upper.join(tops, "tree").select(
            "tree", F.col("index").alias("block"), "source", "subroot", "root", F.concat("above", "over").alias("above")
        )
        return store(proofs(levels.join(upper, ["tree", "block"])), "manifest", lasting=True)


def proofs(blocks: DataFrame) -> DataFrame:
    """A row for every member: its siblings of all levels hashed, and the root its claimed leaf folds to."""

    def proof(m: Column) -> Column:
        sides, at = [], (m["index"] % RUN**LOCAL).cast("int")
        for k in range(LOCAL):
            nodes = F.col(f"l{k}")
            left, right = _beside(nodes, at)
            there = (F.col("blocks") > 1) | (F.size(nodes) > 1)
            sides.append(F.when(there, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_SIDES)))
            at = F.floor(at / RUN).cast("int")
        return F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), m["claimed"].alias("claimed"), F.concat(*sides).alias("own"))

    # Level by level within the array, so that a row carries its own siblings only.
    rows = blocks.select("source", "subroot", "root", "above", F.explode(F.transform("members", proof)).alias("m"))
    sides = F.concat("m.own", "above")
    siblings = _joined(F.transform(sides, lambda s: F.concat(s["left"], s["right"])))
    found = rows.select(
        F.col("m.doc_id").alias("doc_id"), "source", F.col("m.leaf").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), _folded(F.col("m.claimed"), sides).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, upper: int = 4) -> str:
    """Level by level; right up to RUN ** levels rows of a source and RUN ** upper sources."""
    frame = lambda c: f"coalesce(octet_length(encode(({c})::varchar)) || ':' || ({c}), '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(frame(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # CRC-32 (reflected polynomial edb88320) of the decimal digits.
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    crc = (
        "xor(list_reduce([ascii(x)::bigint for x in string_split(doc_id::varchar, '')], "
        f"lambda held, b: list_reduce(range(8), lambda c, i: {bit}, xor(held, b)), 4294967295), 4294967295)"
    )
    steps = [
        f"""d as materialized (
  select row_number() over () as rid, doc_id, source, {leaf_of("text")} as leaf,
    case when doc_id is not null and {crc} % {TAMPERED} = 0 then {leaf_of(low)} else {leaf_of("text")} end as claimed
  from documents
), own as materialized (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
    dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as n
  from d
), a0 as materialized (select tree, i, leaf as d, n from own)"""
    ]

    def grow(name: str, count: int) -> None:
        for k in range(count):
            steps.append(
                f"""{name}{k + 1} as materialized (
  select tree, i // {RUN} as i, case when max(n) = 1 then min(d) else sha256(string_agg(d, '' order by i)) end as d,
    (max(n) + {RUN - 1}) // {RUN} as n
  from {name}{k} group by tree, i // {RUN}
)"""
            )

    grow("a", levels)
    steps.append(f"b0 as materialized (select 0 as tree, tree as i, d, count(*) over () as n from a{levels})")
    grow("b", upper)
    steps.append("f0 as materialized (select rid, tree, i, claimed as d from own)")
    stages = [(f"a{k}", RUN**k, "f.tree", "f.i") for k in range(levels)] + [(f"b{k}", RUN**k, "0", "f.tree") for k in range(upper)]
    sides = []
    for k, (name, stride, tree, at) in enumerate(stages):
        here = f"{name} n on n.tree = {tree} and n.i // {RUN} = {at} // {stride * RUN}"
        sides.append(f"select f.rid, {k} as level, n.i, n.d from f0 f join {here} where n.n > 1 and n.i <> {at} // {stride}")
        steps.append(
            f"""f{k + 1} as materialized (
  select f.rid, f.tree, f.i, case when any_value(n.n) = 1 then any_value(f.d) else
    sha256(string_agg(case when n.i = {at} // {stride} then f.d else n.d end, '' order by n.i)) end as d
  from f{k} f join {here} group by f.rid, f.tree, f.i
)"""
        )
    steps.append("siblings as materialized (select rid, sha256(string_agg(d, '' order by level, i)) as proof from (" + " union all ".join(sides) + ") group by rid)")
    return (
        "with "
        + ", ".join(steps)
        + f"""
select own.doc_id, own.leaf, s.d as subroot, r.d as root, coalesce(p.proof, sha256('')) as proof_sha256, f.d as folded_root, f.d = r.d as verified
from own join a{levels} s on s.tree = own.tree cross join b{upper} r join f{len(stages)} f on f.rid = own.rid left join siblings p on p.rid = own.rid
"""
    )


SQL = _sql()
