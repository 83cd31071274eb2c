"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import materialize


def _mark(edges: DataFrame):
    """Row count and an order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of comparable ids -> (node, component): each linked node's least reachable id.

    Each round points every neighbour of a node at the least of them, first the larger ones,
    then the smaller ones (large-star, small-star); rounds grow with the logarithm of the
    longest path. Only the number of edges and a hash of them reach the driver; each round's
    edges are written to the shared folder, which cuts the lineage. Nulls and self-links are
    ignored, repeated links count once.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(pairs.distinct(), "links")  # a > b throughout
    mark = _mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionAll(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
