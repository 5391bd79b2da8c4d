"""Reported doubles round identically in Spark and in the DuckDB oracle, including
the half-way cases met on the driver tables (exact sums and means of few-decimal inputs)."""

import duckdb
from pyspark.sql import functions as F

from reefline.plans.registry import r, round_fixed

TIES = [3530.7896875, 0.0585, 141769.89925, 29591.654915, -2.5e-7, 1122437.1458535, 0.0, 1e-13, -0.0]


def test_spark_and_sql_round_alike(spark):
    df = spark.createDataFrame([(x,) for x in TIES], "x double")
    got = [row[0] for row in df.select(round_fixed(F.col("x"))).collect()]
    con = duckdb.connect()
    exp = [con.execute(f"SELECT {r(repr(x) + '::DOUBLE')}").fetchone()[0] for x in TIES]
    assert got == exp
    assert got[0] == 3530.789688 and got[1] == 0.0585
    assert all(str(v) != "-0.0" for v in got)
