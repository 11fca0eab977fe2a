"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.session import cut


def _distinct_cut(edges: DataFrame) -> DataFrame:
    return cut(edges.filter("u <> v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Rows and two order-free sums: equal for equal edge tables."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """The larger end of every edge moves to the smallest neighbour of the smaller end."""
    ends = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lower = ends.groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
    # written, so that the join deals both sides and Spark can split the rows of a hub
    lower = cut(lower.withColumnRenamed("u", "w"))
    moved = edges.join(lower, edges["v"] == lower["w"], "left")
    return moved.select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of every node move to the smallest one among them, the node too."""
    lowest = cut(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
    moved = edges.join(lowest, edges["u"] == lowest["w"])
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("w", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that can be reached.

    The table never has more rows than at its start, chains shrink by half with every step,
    and neighbourhoods are joined and reduced to minima, never collected. An edge from a
    node to itself says nothing; no edges give no rows.
    """
    now = _distinct_cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    mark, before = _mark(now), None
    while mark != before:
        before = mark
        now = _distinct_cut(_small_star(_distinct_cut(_large_star(now))))
        mark = _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
