"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import discard, saved


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges, to see when they stop changing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of large-star (or small-star): every node hands the smallest node it
    knows to its larger (or smaller) neighbours. The smallest is a map-side aggregate
    joined back on the node, so a node with very many links is split at run time."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_low")).select(
        F.col("a").alias("_node"), F.least("a", "_low").alias("_low"))
    told = both.join(least, F.col("a") == F.col("_node"))
    if large:
        pairs = told.filter("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        pairs = (told.filter("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
                 .unionByName(least.select(F.col("_node").alias("a"), F.col("_low").alias("b"))))
    return pairs.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs): ``root`` is the
    smallest node it can reach. Alternates large-star and small-star rounds until the
    links stop changing; each round is cut off in the shared folder. Nodes without a
    link to another node are not returned."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "links")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        old, edges = edges, saved(_star(_star(edges, True), False), "links")
        discard(old)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
