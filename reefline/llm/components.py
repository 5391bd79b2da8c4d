"""Connected components of an edge table, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(pairs: DataFrame, upward: bool) -> DataFrame:
    """Join every node ``a`` of ``pairs`` to the least node ``m`` of its neighbours and itself;
    of the neighbours keep the larger ones (``upward``) or the smaller ones and the node itself."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("_a"), "m")
    met = pairs.join(least, F.col("a") == F.col("_a"))
    if upward:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node that can be reached.

    Alternates large-star and small-star rounds: each node points its larger
    neighbours, then its smaller ones, at the least node near it, until a
    round changes nothing (a number of rounds that grows with the logarithm of
    the longest chain).  Each round's edges are written to the shared folder,
    so lineage stays short.  Null ends and loops are ignored."""
    now = keep(edges.select("a", "b").where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    while seen[0]:
        # a > b holds in every row, so the smaller neighbours of a are the b of its rows
        now = keep(_to_least(_to_least(_both(now), True), False))
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
