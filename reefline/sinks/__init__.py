"""Sinks: figure data and split parts (SNK-1, SNK-2)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.operators.joins import join_null_safe
from reefline.operators.ranking import value_positions
from reefline.session import ensure_checkpoint_dir


def output_root(df: DataFrame) -> str:
    """Shared output folder: ``reefline.output.dir`` if set, else under the
    cluster's shared checkpoint folder (never a machine-local temp folder)."""
    spark = df.sparkSession
    root = spark.conf.get("reefline.output.dir", None)
    return root.rstrip("/") if root else ensure_checkpoint_dir(spark).rstrip("/") + "/reefline-output"


def write_figure_data(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet", order: Sequence[str] = ()) -> str:
    """SNK-1 / SRT-1: persist the rows behind one figure, in ``order`` over all files if it is given; returns the written path."""
    target = path or f"{output_root(df)}/{name}-{uuid.uuid4().hex[:12]}"
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").format(fmt).save(target)
    return target


def write_parts(df: DataFrame, key: str, path: str, fmt: str = "parquet") -> str:
    """SNK-2: one folder per value of ``key`` (``key=value`` layout), written in parallel.

    Rows are rebalanced by ``key`` first: at run time a part that is larger than the advisory partition
    size goes to several tasks and small parts share one, so the number of files follows the size of the
    data and not tasks times parts, and no task writes a hot part alone."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).format(fmt).save(path)
    return path


def part_numbers(df: DataFrame, key: str, out: str = "part") -> DataFrame:
    """SRT-2 / SNK-2: number the parts 1..k in sorted key order, null last (as a split by
    key returns them), computed on the distinct keys only and joined back."""
    keys = value_positions(df.select(key).distinct(), [], key)
    numbered = keys.select(key, (F.col("_lt") + 1).cast("int").alias(out))
    last = numbered.agg((F.coalesce(F.max(out), F.lit(0)) + 1).alias("n")).select("n").scalar()
    return join_null_safe(df, numbered, [key], "left").withColumn(out, F.coalesce(F.col(out), last))
