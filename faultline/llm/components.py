"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reachable.

    Each round hangs larger neighbours on a node's smallest neighbour (large star), then does the
    same among the smaller ones (small star). Rounds grow with the logarithm of the longest path.
    Minima are combined before the shuffle, so a node with many neighbours is no bottleneck.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut(ordered.filter("a != b").distinct())
    state = _state(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        current = cut(small.select("a", F.col("m").alias("b"))
                      .union(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                      .distinct())
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame):
    """Count and checksums of the edges: equal from round to round when nothing moved."""
    wide = "decimal(38,0)"
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast(wide)),
                           F.sum(F.col("b").cast(wide))).first())
