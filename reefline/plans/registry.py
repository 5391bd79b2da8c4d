"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where one exists, the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query builder (and its oracle SQL, if SQL can express it)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


NUDGE = 1e-12


def round_fixed(c, digits: int = DIGITS):
    """``round(s + |s| * 1e-12) / 10^d`` with ``s = x * 10^d``, half away from zero.

    Inputs with few decimals put exact sums and means on half-way points; two
    engines (or two partitionings) then differ in the last ulp and round to
    opposite sides.  The relative nudge moves the boundary off those decimal
    points, so values a few ulps apart round alike.  The SQL twin is ``r``."""
    scale = F.lit(float(10 ** digits))
    s = c * scale
    return F.round(s + F.abs(s) * F.lit(NUDGE), 0) / scale + F.lit(0.0)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (last step of a reported query; hides ulp noise)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_fixed(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sig(c, sig: int):
    """Round to ``sig`` significant digits (nudged as ``round_fixed`` is): ``round(x * 10^k) / 10^k`` with
    ``k = sig - 1 - floor(log10|x|)``; powers of ten up to 1e22 are exact."""
    e = F.floor(F.log10(F.abs(c)))
    k = F.lit(sig - 1) - e
    p = F.pow(F.lit(10.0), F.abs(k))
    up, down = c * p, c / p
    out = F.when(k >= 0, F.round(up + F.abs(up) * F.lit(NUDGE), 0) / p).otherwise(F.round(down + F.abs(down) * F.lit(NUDGE), 0) * p)
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(out) + F.lit(0.0)


def rs(expr: str, name: str, sig: int = 10) -> str:
    """SQL twin of ``round_sig``."""
    x = f"CAST({expr} AS DOUBLE)"

    def rounded_off(v: str) -> str:
        return f"round({v} + abs({v}) * {NUDGE!r})"

    k = f"({sig - 1} - floor(log10(abs({x}))))"
    p = f"pow(10.0, abs({k}))"
    return (f"(CASE WHEN {x} = 0 OR isnan({x}) OR isinf({x}) THEN {x} WHEN {k} >= 0 THEN {rounded_off(f'({x} * {p})')} / {p} "
            f"ELSE {rounded_off(f'({x} / {p})')} * {p} END + 0.0) AS {name}")


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded`` for one expression."""
    scale = f"{float(10 ** digits)!r}::DOUBLE"
    s = f"(CAST({expr} AS DOUBLE) * {scale})"
    out = f"(round({s} + abs({s}) * {NUDGE!r}) / {scale} + 0.0)"
    return f"{out} AS {name}" if name else out
