"""Distribution summaries (AGG-1 .. AGG-11).

Exact quantiles are type 7 (linear interpolation between order statistics at
``(n-1)p``), the default of most statistics packages and of Spark's
``percentile`` and DuckDB's ``quantile_cont``.

They come from ``selection.exact_quantiles``: a sketch brackets each order
statistic and a second pass counts and keeps the values inside, so no task ever
sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.operators.joins import complete, join_null_safe
from reefline.operators.selection import exact_quantiles


def qname(p: float) -> str:
    """Column name for a probability: 0.01 -> q_0_01, 0.5 -> q_0_50."""
    return "q_" + f"{p:.2f}".replace(".", "_")


def _strict(agg: Column, value: str) -> Column:
    """NULL unless every row of the group has a value (missing propagates)."""
    return F.when(F.count(F.col(value)) == F.count(F.lit(1)), agg)


def group_mean_sd(df: DataFrame, keys: Sequence[str], value: str, mean: str = "mean", sd: str = "sd",
                  strict: bool = False) -> DataFrame:
    """AGG-1: mean and sample SD per group (NULL keys form a group).  ``strict``: a
    missing value makes the group's statistics missing."""
    m, s = F.avg(value), F.stddev_samp(value)
    if strict:
        m, s = _strict(m, value), _strict(s, value)
    return df.groupBy(*keys).agg(m.alias(mean), s.alias(sd))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """AGG-2 / AGG-4: exact type-7 quantiles per group (``keys=[]`` for global).

    NULL values are skipped (a missing value would be an error upstream).
    """
    return exact_quantiles(df, keys, value, probs, names or [qname(p) for p in probs])


def quantile_of_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                          label_col: str, label: str, names: Sequence[str] | None = None) -> DataFrame:
    """AGG-3: per-group p-quantile, then the same p-quantile across groups, as one
    row labelled ``label`` in ``label_col``."""
    names = list(names or [qname(p) for p in probs])
    return quantiles_across(group_quantiles(df, keys, value, probs, names), probs, label_col, label, names)


def quantiles_across(per_group: DataFrame, probs: Sequence[float], label_col: str, label: str, names: Sequence[str]) -> DataFrame:
    """The second half of AGG-3, from quantiles of groups that are there already."""
    # Long form (quantile name, value) so one aggregation serves every column;
    # each column then keeps the quantile at its own probability.
    long = per_group.select(F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(n).alias("_v"))
                                                for n in names])).alias("_s")).select("_s._name", "_s._v")
    qq = group_quantiles(long, ["_name"], "_v", probs, names)
    row = qq.agg(*[F.max(F.when(F.col("_name") == n, F.col(n))).alias(n) for n in names])
    return row.select(F.lit(label).alias(label_col), *names)


def with_total(df: DataFrame, key: str, value: str, total_label: str, mean: str = "mean",
               sd: str = "sd") -> DataFrame:
    """AGG-5: per-group mean and SD plus a grand-total row in one aggregation
    (grouping sets).  The total is told apart from a NULL key by ``grouping()``."""
    g = df.rollup(key).agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(sd),
                           F.grouping(key).alias("_total"))
    return g.select(F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col(key)).alias(key), mean, sd)


def crosstab_long(df: DataFrame, a: str, b: str, count: str = "n") -> DataFrame:
    """AGG-8: contingency table in long form; rows with a missing value in either
    column are left out and empty cells are reported as 0."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias(count))
    return complete(counts, a, b, fill={count: 0})


def box_stats(df: DataFrame, keys: Sequence[str], value: str, coef: float = 1.5) -> DataFrame:
    """AGG-9: box-plot statistics per group: hinges and median (type 7), whiskers at
    the most extreme values within ``coef`` IQR of the hinges, outlier count."""
    keys = list(keys)
    src = df.select(*keys, value).where(F.col(value).isNotNull() & ~F.isnan(value))
    q = group_quantiles(src, keys, value, [0.25, 0.5, 0.75], ["lower", "middle", "upper"])
    q = q.withColumn("_iqr", F.col("upper") - F.col("lower"))
    lo = F.col("lower") - F.lit(coef) * F.col("_iqr")
    hi = F.col("upper") + F.lit(coef) * F.col("_iqr")
    j = join_null_safe(src, q, keys) if keys else src.withColumns(
        {c: q.select(c).scalar() for c in ("lower", "middle", "upper", "_iqr")})
    inside = (F.col(value) >= lo) & (F.col(value) <= hi)
    agg = j.groupBy(*keys).agg(
        F.first("lower").alias("lower"), F.first("middle").alias("middle"), F.first("upper").alias("upper"),
        F.min(F.when(inside, F.col(value))).alias("ymin"), F.max(F.when(inside, F.col(value))).alias("ymax"),
        F.count(F.when(~inside, 1)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "ymin", "lower", "middle", "upper", "ymax", "n_outliers", "n")


def distinct_count(df: DataFrame, column: str, with_null: bool = True, out: str = "n_distinct") -> DataFrame:
    """AGG-10: number of distinct values; a missing value counts as one value."""
    n = F.count_distinct(F.col(column))
    if with_null:
        n = n + F.max(F.col(column).isNull().cast("int"))
    return df.agg(n.cast("long").alias(out))
