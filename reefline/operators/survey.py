"""Nested survey roll-up (AGG-6, AGG-7, JOI-1, JOI-5; ANA-10, ANA-11).

Levels go quadrat -> transect -> habitat -> site -> year.  Each level is a
mean of the level below (not a flat mean: groups are unbalanced); SD is taken
across transects within a habitat and averaged up to the site.

Means are *strict* by default: a missing input makes the group's statistic
missing, and an SD over a single value is missing too, which propagates to the
site mean of SDs.

Partitioning: the quadrat-level aggregate runs on the full key (partial
aggregation, spread over all tasks).  Its much smaller output is then
hash-partitioned once by (year, site); every coarser level down to the site
groups by a superset of (year, site), so those three aggregates reuse that
partitioning without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.predicates import is_in
from reefline.operators.joins import join_null_safe


@dataclass(frozen=True)
class Levels:
    year: str = "year"
    site: str = "site"
    habitat: str = "habitat"
    transect: str = "transect"
    quadrat: str = "quadrat"


def smean(c: str, strict: bool = True) -> Column:
    m = F.avg(c)
    return F.when(F.count(F.col(c)) == F.count(F.lit(1)), m) if strict else m


def ssd(c: str, strict: bool = True) -> Column:
    s = F.stddev_samp(c)
    return F.when(F.count(F.col(c)) == F.count(F.lit(1)), s) if strict else s


def restrict_years(df: DataFrame, years: DataFrame, year: str = "year") -> DataFrame:
    """JOI-2: survey rows whose year is in the dimension (semi join)."""
    return df.join(years.select(year).distinct(), on=year, how="left_semi")


def site_rollup(df: DataFrame, value: str, lv: Levels = Levels(), out: str = "cover", strict: bool = True,
                num_partitions: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """AGG-6: (year, site) -> mean cover and mean of habitat-level SDs of transects, for each value of ``by``."""
    y, s, h, t, q = lv.year, lv.site, lv.habitat, lv.transect, lv.quadrat
    by = list(by)
    sd_out = f"sd_{out}"
    quad = df.groupBy(*by, y, s, h, t, q).agg(smean(value, strict).alias(out))
    quad = quad.repartition(num_partitions, *by, y, s) if num_partitions else quad.repartition(*by, y, s)
    tran = quad.groupBy(*by, y, s, h, t).agg(smean(out, strict).alias(out))
    hab = tran.groupBy(*by, y, s, h).agg(ssd(out, strict).alias(sd_out), smean(out, strict).alias(out))
    return hab.groupBy(*by, y, s).agg(smean(out, strict).alias(out), smean(sd_out, strict).alias(sd_out))


def with_rate(sites: DataFrame, rate: Column, cover: str = "cover", out: str = "cr") -> DataFrame:
    """Production = cover / 100 * rate (rate usually a scalar subquery)."""
    return sites.withColumn(out, F.col(cover) / 100 * rate)


def join_dimension(df: DataFrame, dim: DataFrame, on: str = "year") -> DataFrame:
    """JOI-1: inner join to a yearly dimension."""
    return df.join(dim, on=on, how="inner")


def year_summary(sites: DataFrame, cols: Sequence[str], year: str = "year", strict: bool = True) -> DataFrame:
    """AGG-7: per year, mean and SD across sites of each listed column."""
    aggs = []
    for c in cols:
        aggs += [smean(c, strict).alias(c), ssd(c, strict).alias(f"sd_{c}")]
    return sites.groupBy(year).agg(*aggs)


def contribution(cca_sites: DataFrame, coral_sites: DataFrame, keys: Sequence[str] = ("year", "site"),
                 own: str = "cr", other: str = "cr_sc", out: str = "contribution") -> DataFrame:
    """ANA-11 / JOI-5: share of the first component in the total, per (year, site).

    Rows are matched on their keys (a key present on one side only has no
    share), rather than by position.
    """
    a = cca_sites.select(*keys, F.col(own).alias("_own"))
    b = coral_sites.select(*keys, F.col(other).alias("_other"))
    j = join_null_safe(a, b, list(keys))
    return j.select(*keys, (F.col("_own") / (F.col("_own") + F.col("_other")) * 100).alias(out))


def interval(df: DataFrame, center: str, spread: str, lwr: str = "lwr", upr: str = "upr") -> DataFrame:
    """PRJ-8: ``center +/- spread`` bounds."""
    return df.withColumns({upr: F.col(center) + F.col(spread), lwr: F.col(center) - F.col(spread)})


def group_rows(df: DataFrame, group_col: str, group: str) -> DataFrame:
    """FIL-1: rows of one functional group."""
    return df.where(is_in(group_col, [group]))
