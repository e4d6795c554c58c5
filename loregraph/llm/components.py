"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.session import materialize


def components(edges: DataFrame, node: str = "u", other: str = "v", label: str = "component") -> DataFrame:
    """``node, label`` of every node of an edge: the smallest node it is connected to. Nodes are of any
    type that has an order, structs too.

    A round links every larger neighbour of a node to the smallest one (large star), then every
    smaller neighbour and the node itself (small star). Edges are distinct and turn into stars around
    the smallest nodes, so they shrink to one per node; the number of rounds is logarithmic. They are
    written to the shared folder each round; the driver sees two sums. The smallest neighbour is an
    aggregate, reduced map-side, and a node with many edges is split by AQE where it joins."""
    one = edges.select(F.col(node).alias("u"), F.col(other).alias("v"))
    nodes = one.select("u").unionByName(one.select(F.col("v").alias("u"))).distinct()
    now = one.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(now), None
    while True:
        # large star: u's neighbours in both directions, those above u go to the smallest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        # small star: u and its neighbours below go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if size == before:
            labels = nodes.join(now, "u", "left")
            return labels.select(F.col("u").alias(node), F.coalesce("v", "u").alias(label))
        before = size
