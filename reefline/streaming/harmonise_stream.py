"""Harmonising reported rates as they arrive (Structured Streaming).

Every step of the review harmonisation except two is a row-local expression
or a literal-vocabulary lookup, so the same operators run unchanged on a
streaming DataFrame: method families, branch tag, canonical units, unit
conversion, exclusions, non-negative filter, sentinel handling, taxon words
and keyed patches.  The two exceptions need the whole table and stay batch
only: positional patches (an order within a study) and the incomplete-study
audit (a set difference over all studies).  No state is kept, so the stream
runs in append mode without a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reefline import fixed_values as fv
from reefline.functions.predicates import nonnegative
from reefline.operators.routing import routed
from reefline.plans import review as RV
from reefline.session import ensure_checkpoint_dir
from reefline.sources.tables import RATES_SCHEMA

OUT_COLS = ["paper_name", "method", "method_family", "unit", "species", "genus", "climate", "temperature",
            "rate_std", "error", "standardization"]


def read_rates_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None,
                      schema=RATES_SCHEMA) -> DataFrame:
    """Streaming scan of reported-rate files with an explicit schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def harmonise_rows(rates: DataFrame) -> DataFrame:
    """Row-local harmonisation of a (batch or streaming) rates DataFrame into the
    three standardised parts, tagged by ``standardization``."""
    kept = routed(RV.prepare(rates), list(RV.BRANCHES.values()))
    label = F.lit(None).cast("string")
    for name, text in RV.LABELS.items():
        label = F.when(F.col("branch") == name, F.lit(text)).otherwise(label)
    kept = kept.where(F.col("branch") != RV.UNUSED).withColumn("standardization", label)
    return kept.where((F.col("standardization") != fv.STANDARDIZATION_BIOMASS) | nonnegative("rate_std")).select(*OUT_COLS)


def start_harmonise_stream(spark: SparkSession, source: str, sink: str, fmt: str = "parquet",
                           checkpoint: str | None = None, query_name: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Start the stream.  ``sink`` is a folder (Parquet, partitioned by standardisation).
    The checkpoint defaults to a folder under the shared ``spark.checkpoint.dir``."""
    out = harmonise_rows(read_rates_stream(spark, source, fmt))
    name = query_name or "harmonised_rates"
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = out.writeStream.outputMode("append").option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.format("parquet").partitionBy("standardization").option("path", sink).start()
