"""Spark session helpers.

The library never creates hidden sessions inside operators; callers pass a
``SparkSession`` (or a DataFrame, whose ``sparkSession`` is used).  ``get_session``
is a convenience for scripts, tests and the benchmark.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session used with this library should carry.  ANSI mode is the
# Spark 4 default and the null / cast rules in ``functions`` assume it.
SESSION_DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reefline", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    Nothing that a submit decides is set unless asked for: without ``master`` and
    ``driver_memory`` those of spark-submit (or of the running session) hold.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:       # a session of our own, as in scripts and the benchmark
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must point at shared storage and is used as is.  Only
    in local mode (one machine, as in tests) a fresh folder of that machine is
    made where it is unset; lineage is never cut with ``localCheckpoint``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="reefline-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back.

    One compute pass (``Dataset.checkpoint`` computes an unpersisted input
    twice), and the result is a columnar scan that keeps column pruning and
    filter pushdown for every later reader.  The files live on the cluster's
    shared storage, so losing an executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{intermediate_root(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path)
    return out.select(*df.columns)   # partition columns come back last; keep the order


def intermediate_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/reefline-tables"


def drop_intermediate_tables(spark: SparkSession) -> bool:
    """Delete the tables ``cut_lineage`` wrote under the shared checkpoint folder.

    Call it when a job's results have been written or collected: DataFrames
    returned earlier still read those files.  Uses the cluster's Hadoop
    FileSystem, so it works on any shared storage Spark can write to.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(intermediate_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False
