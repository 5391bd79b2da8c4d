"""Composite analyses for the figures: quantile summary (ANA-6) and mixture (ANA-7..9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.predicates import is_in, not_in
from reefline.operators import summaries as S
from reefline.operators.mixture import Rates
from reefline.sources.multipart import union_parts

QUANTILE_NAMES = [S.qname(p) for p in fv.QUANTILE_PROBS]
CCA_CLIMATES = ["Warm temperate", "Tropical"]


def reference_rates(part1: DataFrame, part2: DataFrame) -> DataFrame:
    """SRC-3: two sheets, distinct each, nulls dropped in the first only, appended,
    rescaled from mg day-1 to g yr-1."""
    out = union_parts([part1, part2], ["pubyear", "genus", "species", "conx"], [True, False])
    return out.withColumn("conx", F.col("conx") / 1000 * fv.YEAR_TO_DAY)


def cca_quantiles(data_cca: DataFrame) -> DataFrame:
    """Per-genus quantiles of warm-climate CCA rates plus the 'All CCA' row (over crustose genera)."""
    warm = data_cca.where(is_in("climate", CCA_CLIMATES))
    per_genus = S.group_quantiles(warm, ["genus"], "rate_std", fv.QUANTILE_PROBS, QUANTILE_NAMES)
    crustose = per_genus.where(not_in("genus", fv.ARTICULATE_GENERA)).where(F.col("genus") != fv.HALIMEDA)
    avg = S.quantiles_across(crustose, fv.QUANTILE_PROBS, "genus", "All CCA", QUANTILE_NAMES)
    return per_genus.unionByName(avg)


def coral_quantiles(coral: DataFrame) -> DataFrame:
    """Per-genus quantiles of coral rates plus the 'All Corals' row."""
    per_genus = S.group_quantiles(coral, ["genus"], "conx", fv.QUANTILE_PROBS, QUANTILE_NAMES)
    return per_genus.unionByName(S.quantiles_across(per_genus, fv.QUANTILE_PROBS, "genus", "All Corals", QUANTILE_NAMES))


def quantile_summary(data_cca: DataFrame, coral: DataFrame) -> DataFrame:
    """ANA-6: both quantile tables, tagged by component."""
    return (cca_quantiles(data_cca).withColumn("component", F.lit("CCA"))
            .unionByName(coral_quantiles(coral).withColumn("component", F.lit("Coral"))))


def mixture_rates(data_cca: DataFrame, coral: DataFrame) -> Rates:
    """Quartile rates x 10 (g cm-2 yr-1 -> kg m-2 yr-1) as scalar subqueries."""
    probs = [0.25, 0.5, 0.75]
    names = ["q25", "q50", "q75"]
    # One struct-valued scalar subquery per component; its three uses are the
    # same subquery plan, which Spark computes once (subquery reuse).
    cq = S.group_quantiles(data_cca, [], "rate_std", probs, names)
    kq = S.group_quantiles(coral, [], "conx", probs, names)
    c = cq.select(F.struct(*names).alias("s")).scalar()
    k = kq.select(F.struct(*names).alias("s")).scalar()
    ten = F.lit(fv.G_CM2_TO_KG_M2)
    bounds = dict(zip(("lwr", "median", "upr"), names))
    return Rates(cca={b: c[n] * ten for b, n in bounds.items()}, coral={b: k[n] * ten for b, n in bounds.items()})
