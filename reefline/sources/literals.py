"""Literal dimensions (SRC-5) and the numeric grid (SRC-6).

Literal tables have a fixed, known size, so broadcasting them is safe at any
data scale.  The grid is generated by ``spark.range``: every point is
``start + id * step`` (no accumulated floating error), spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline import fixed_values as fv


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def complexity_dim(spark: SparkSession, rows=None) -> DataFrame:
    return literal_table(spark, rows or fv.COMPLEXITY, "year bigint, sc double")


def grid(spark: SparkSession, start: float, stop: float, step: float, name: str = "x",
         num_partitions: int | None = None) -> DataFrame:
    """SRC-6: ``start, start+step, ..., stop`` (inclusive when it lands on stop)."""
    n = int(round((stop - start) / step)) + 1
    return spark.range(0, n, numPartitions=num_partitions).select(
        F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))


def cover_grid(spark: SparkSession, step: float = 0.01, num_partitions: int | None = None) -> DataFrame:
    """The 0..100 cover grid and its descending mirror, aligned by position."""
    n = int(round(100 / step)) + 1
    return spark.range(0, n, numPartitions=num_partitions).select(
        F.col("id").alias("i"),
        (F.col("id") * F.lit(step)).alias("cca_cover"),
        (F.lit(100.0) - F.col("id") * F.lit(step)).alias("coral_cover"))
