"""Scans with explicit schemas and early projection (SRC-1, SRC-2, SRC-7).

Parquet scans get column pruning and filter pushdown from Catalyst; CSV scans
get an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.session import cut_lineage

RATES_SCHEMA = T.StructType([
    T.StructField("row_ordinal", T.LongType(), False),
    T.StructField("paper_name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("rate", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("species", T.StringType()),
    T.StructField("climate", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
])

SURVEY_SCHEMA = T.StructType([
    T.StructField("year", T.LongType()),
    T.StructField("site", T.StringType()),
    T.StructField("habitat", T.StringType()),
    T.StructField("transect", T.StringType()),
    T.StructField("quadrat", T.StringType()),
    T.StructField("functional_group", T.StringType()),
    T.StructField("percent_cover", T.DoubleType()),
])

REFERENCE_RATES_SCHEMA = T.StructType([
    T.StructField("pubyear", T.DoubleType()),
    T.StructField("genus", T.StringType()),
    T.StructField("species", T.StringType()),
    T.StructField("conx", T.DoubleType()),
])

GROWTH_COLUMNS = ["paper_name", "genus", "climate", "temperature", "method_family", "rate_std", "std_error",
                  "standardization"]

DRAWS_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("iteration", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               columns: Sequence[str] | None = None, **options) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", **options}
    reader = spark.read.format(fmt).options(**options)
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    df = reader.load(path)
    if fmt == "parquet" and schema is not None:
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    if columns:
        df = df.select(*columns)
    return df


CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Checked:
    """Rows that fit a schema, the text of those that don't, and their numbers."""
    rows: DataFrame
    rejected: DataFrame
    n_rows: int
    n_rejected: int


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", most_rejected: float | None = None, **options) -> Checked:
    """SRC-1 / SRC-2 / SRC-4: a permissive scan of a text format that keeps what it can't read.

    A row with too few or too many fields, or a value that its column's type can't hold, is rejected as a
    whole (``rejected`` has its text); so is a missing value in a column that the schema says has none.
    The scan is written once, so that both sides and the counts come from one reading.  ``most_rejected``
    is the share of rows above which the scan is an error."""
    if fmt == "csv":
        options = {"header": "true", "enforceSchema": "true", **options}
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.format(fmt).schema(loose).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).load(path)
    required = [f.name for f in schema.fields if not f.nullable]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required], F.lit(False))
    shown = F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields])) if fmt == "csv" else F.to_json(F.struct(*schema.names))
    text = F.coalesce(F.col(CORRUPT), F.when(missing, shown))
    written = cut_lineage(raw.withColumn(CORRUPT, text))
    total, bad = written.agg(F.count(F.lit(1)), F.count(CORRUPT)).first()
    if most_rejected is not None and bad > most_rejected * total:
        raise ValueError(f"{bad} of {total} rows of {path} do not fit the schema")
    return Checked(written.where(F.col(CORRUPT).isNull()).drop(CORRUPT), written.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record")),
                   total - bad, bad)


def driver_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_rates(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC-1: the literature table of reported rates."""
    return read_table(spark, path, fmt, RATES_SCHEMA, **options)


def load_survey(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC-2: the long-term quadrat survey."""
    return read_table(spark, path, fmt, SURVEY_SCHEMA, **options)


def load_draws(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC-7: posterior draws in long form (dataset, parameter, chain, iteration, value)."""
    return read_table(spark, path, fmt, DRAWS_SCHEMA, **options)
