"""Intermediate tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.session import intermediate_root

_written: list[str] = []


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, free_shuffles: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the folder that ``spark.checkpoint.dir`` names and read it back.

    One pass over the input, and a lost executor loses nothing: later stages
    read the files.  ``release`` removes the tables.  ``free_shuffles`` deletes the
    shuffle files of the write when it ends, not when the driver next collects garbage;
    ``df`` should then not be computed again."""
    spark = df.sparkSession
    path = f"{intermediate_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free_shuffles:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if free_shuffles:
            spark.conf.set(FREE_SHUFFLES, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the tables that ``keep`` wrote and ``release`` has not removed."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``keep`` wrote, once their readers are done."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _written:
            _written.remove(path)


ROW = ("_reefline_file", "_reefline_row")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with two columns that tell its rows apart: the file (a hash of its path) and the row of the file.

    ``docs`` must be read from files; any other DataFrame is written first."""
    try:
        file, row = docs["_metadata.file_path"], docs["_metadata.row_index"]
    except AnalysisException:
        docs = keep(docs)
        file, row = docs["_metadata.file_path"], docs["_metadata.row_index"]
    return docs.select("*", F.xxhash64(file).alias(ROW[0]), row.alias(ROW[1]))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``numbered`` docs that ``dropped`` does not name, with the columns that docs had before."""
    return docs.join(dropped.select(*ROW), list(ROW), "left_anti").drop(*ROW)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """``crc32`` of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def running_total(df: DataFrame, key: str, order: list[str], value: str, out: str, per_key: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``key`` in ``order``.

    Rows are range-partitioned by (key, order), so a hot key spreads over many
    tasks: windows run per (key, partition) and add the offset of the earlier
    partitions, of which there is one row per key and partition.  A null key is
    a key of its own; rows that tie in ``order`` follow each other in any order.
    ``per_key`` (the key as its first column, one row per key) adds its columns; keys
    that it lacks are left out.  It joins the offsets, so no key meets in one task."""
    from pyspark.sql import Window as W

    dealt = keep(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(F.col(key).alias("_key"), F.col("_part").alias("_at"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    more = per_key.columns[1:] if per_key is not None else []
    if per_key is not None:
        wanted = per_key.select(F.col(per_key.columns[0]).alias("_wanted"), *more)
        offsets = offsets.join(wanted, F.col("_key").eqNullSafe(F.col("_wanted")))
    inside = W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = dealt.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))) \
        .select(*df.columns, out, *more)
