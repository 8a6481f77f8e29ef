"""Groups of linked rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipweave.sources.sinks import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either the lesser end of its edges or the greater end of a single one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    roles = ends.groupBy("node").agg(F.max("lesser").alias("lesser"), F.sum("greater").alias("greater"))
    return roles.filter("greater > 1 or (greater = 1 and lesser = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, head): the least node that can be reached, for all nodes of the edges (a, b) but those heads themselves.

    Every node sends its greater neighbours to its least one, then its lesser ones; both steps keep what is connected and shorten all paths, until only
    stars around the heads are left. A round is a few grouped joins over narrow rows, so no group is gathered in one task.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _stars(edges):
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        met = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = materialize(met.select(F.col("m").alias("a"), "b").unionByName(met.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("head"))
