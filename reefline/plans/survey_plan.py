"""Survey roll-up and contribution (ANA-10, ANA-11) with one pass over the survey."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.predicates import is_in
from reefline.operators import survey as SV
from reefline.session import cut_lineage


@dataclass(frozen=True)
class SurveyResult:
    cca_sites: DataFrame
    coral_sites: DataFrame
    cca_years: DataFrame
    coral_years: DataFrame


def survey_rollup(survey: DataFrame, complexity: DataFrame, cca_rate: Column, coral_rate: Column,
                  group_col: str = "functional_group") -> SurveyResult:
    """ANA-10: both functional groups rolled up to sites and years, with production
    (cover x rate) and, for corals, the structural-complexity multiplier."""
    both = SV.restrict_years(survey.where(is_in(group_col, [fv.CCA_GROUP, fv.CORAL_GROUP])), complexity)
    sites = cut_lineage(SV.site_rollup(both, "percent_cover", by=[group_col]))       # one pass over the survey
    cca_sites = SV.with_rate(SV.group_rows(sites, group_col, fv.CCA_GROUP).drop(group_col), cca_rate)
    coral_sites = SV.group_rows(sites, group_col, fv.CORAL_GROUP).drop(group_col)
    coral_sites = SV.join_dimension(SV.with_rate(coral_sites, coral_rate), complexity)
    coral_sites = coral_sites.withColumn("cr_sc", F.col("cr") * F.col("sc"))
    cca_years = SV.year_summary(cca_sites, ["cover", "cr"])
    coral_years = SV.join_dimension(SV.year_summary(coral_sites, ["cover", "cr"]), complexity)
    coral_years = coral_years.withColumns({"cr_sc": F.col("cr") * F.col("sc"),
                                           "sd_cr_sc": F.col("sd_cr") * F.col("sc")}).drop("sc")
    return SurveyResult(cca_sites, coral_sites, cca_years, coral_years)


def contribution_by_year(res: SurveyResult) -> DataFrame:
    """ANA-11: yearly mean +/- SD of the CCA share of total production."""
    c = SV.contribution(res.cca_sites, res.coral_sites)
    y = c.groupBy("year").agg(SV.smean("contribution").alias("contribution_avg"),
                              SV.ssd("contribution").alias("sd"))
    return SV.interval(y, "contribution_avg", "sd")
