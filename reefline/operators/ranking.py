"""Exact positions of values within groups, computed without one task per group.

A window ``partitionBy(group).orderBy(value)`` sends a whole group to a single
task; with a group holding a third of all rows that task becomes the job.  Here:

1. rows are pre-aggregated to distinct ``(group, value)`` with a multiplicity
   (map-side combine; a hot value collapses to one row);
2. these are range-partitioned by (group, value), so a hot group spreads over as
   many partitions as its values fill, and written once with the number of the
   partition (the ranges are sampled: the written table fixes them);
3. per (group, partition) counts, a few numbers each, give the offset of every
   partition in its group by a running sum;
4. a window per (group, partition) orders only that part of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.operators.joins import join_null_safe
from reefline.session import cut_lineage


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct ``keys + [value]`` with ``_cnt`` (rows holding the value), ``_lt``
    (rows of the group with a smaller value) and ``_n`` (rows in the group).

    Rows with a NULL value are ignored; NULL keys form their own group.
    ``weight`` (optional) is a per-row multiplicity column.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w).cast("long").alias("_cnt"))
    dealt = cut_lineage(distinct.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_cnt").alias("_sum")).withColumns({
        "_off": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "_n": F.sum("_sum").over(whole)}).drop("_sum")
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = join_null_safe(dealt, parts, keys + ["_part"])
    return out.withColumn("_lt", (F.col("_off") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))).cast("long")).drop("_off", "_part")


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based number of every row by ``order`` (nulls first; ties in any order).

    Rows are dealt out by ranges and written once with the number of the range; a window runs per
    range and adds the rows of the ranges before, of which there is one count each."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_sum")) \
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(parts, "_part").withColumn(out, F.col("_off") + F.row_number().over(inside)).drop("_part", "_off")


def row_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "position") -> DataFrame:
    """1-based position by ``order`` within ``keys`` for an order column unique per group."""
    keys = list(keys)
    pos = value_positions(df.select(*keys, order), keys, order)
    pos = pos.select(*keys, order, (F.col("_lt") + 1).alias(out), F.col("_n").alias(f"{out}_n"))
    return join_null_safe(df, pos, keys + [order], "inner")
