"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of a link.

    Each round, every root takes its least neighbour as parent if that is
    smaller, parents are followed twice, and links are moved to the new roots;
    links within a root go. Rounds grow with the logarithm of the longest
    path. All tables are at most as long as the links and go through the
    shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = store(edges, "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = store(nodes.withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        parents = edges.groupBy("u").agg(F.min("v").alias("p"))
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parents = store(
            parents.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parents"
        )
        renamed = lambda t, c: (
            t.join(parents.select(F.col("u").alias(c), F.col("p").alias(f"{c}_new")), c, "left")
            .withColumn(c, F.coalesce(f"{c}_new", c))
            .drop(f"{c}_new")
        )
        labels = store(renamed(labels, "component"), "labels")
        moved = renamed(renamed(edges, "u"), "v")
        edges = store(
            moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links"
        )
    return labels
