"""Registered queries for job 3: the nested survey roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.operators import survey as SV
from reefline.plans import survey_plan as SP
from reefline.plans.catalogue_summaries import _mixture_rates, _rates_sql
from reefline.plans.registry import query, r, rounded
from reefline.plans.review_sql import review_with
from reefline.sources import bindings as B
from reefline.sqltext import sql_str

SURVEY_VIEWS = ("survey", "complexity", "ref_part1", "ref_part2")


def _strict(agg: str, col: str) -> str:
    return f"CASE WHEN count({col}) = count(*) THEN {agg}({col}) END"


def _sites_sql(group: str) -> str:
    return (f"SELECT year, site, {_strict('avg', 'cover')} AS cover, {_strict('avg', 'sd_cover')} AS sd_cover FROM ("
            f"SELECT year, site, habitat, {_strict('stddev_samp', 'cover')} AS sd_cover, {_strict('avg', 'cover')} AS cover FROM ("
            f"SELECT year, site, habitat, transect, {_strict('avg', 'cover')} AS cover FROM ("
            f"SELECT year, site, habitat, transect, quadrat, {_strict('avg', 'percent_cover')} AS cover FROM survey "
            f"WHERE functional_group = {sql_str(group)} AND year IN (SELECT year FROM complexity) "
            f"GROUP BY year, site, habitat, transect, quadrat) GROUP BY year, site, habitat, transect) "
            f"GROUP BY year, site, habitat) GROUP BY year, site")


def _survey_sql(body: str) -> str:
    sites = (f"rt AS ({_rates_sql()}),\n"
             f"cca_sites AS (SELECT s.*, s.cover / 100 * rt.cca AS cr FROM ({_sites_sql(fv.CCA_GROUP)}) s, rt),\n"
             f"coral_sites AS (SELECT s.*, s.cover / 100 * rt.coral AS cr, cx.sc, s.cover / 100 * rt.coral * cx.sc AS cr_sc "
             f"FROM ({_sites_sql(fv.CORAL_GROUP)}) s, rt, complexity cx WHERE cx.year = s.year)")
    full = review_with("__BODY__", SURVEY_VIEWS)
    return full.replace("\n__BODY__", f",\n{sites}\n{body}")


def _res(spark, sf_dir):
    q = _mixture_rates(spark, sf_dir)
    return SP.survey_rollup(B.survey(spark, sf_dir), B.survey_complexity(spark), q.cca["median"], q.coral["median"])


@query("nested_survey", _survey_sql(
    f"SELECT year, site, {r('cover', 'cover')}, {r('sd_cover', 'sd_cover')}, {r('cr', 'cr')} FROM cca_sites"))
def nested_survey(spark, sf_dir):
    """AGG-6: quadrat -> transect -> habitat -> site means (strict SD propagation), CCA."""
    return rounded(_res(spark, sf_dir).cca_sites.select("year", "site", "cover", "sd_cover", "cr"))


@query("dim_join_year", _survey_sql(
    f"SELECT year, site, {r('cover', 'cover')}, {r('sc', 'sc')}, {r('cr_sc', 'cr_sc')} FROM coral_sites"))
def dim_join_year(spark, sf_dir):
    """JOI-1: coral sites joined to the yearly complexity multiplier."""
    return rounded(_res(spark, sf_dir).coral_sites.select("year", "site", "cover", "sc", "cr_sc"))


_YEARS_SQL = ("SELECT 'CCA' AS component, year, {cov}, {sdc}, {cr}, {sdcr}, NULL::DOUBLE AS cr_sc, NULL::DOUBLE AS sd_cr_sc "
              "FROM (SELECT year, " + _strict('avg', 'cover') + " AS cover, " + _strict('stddev_samp', 'cover')
              + " AS sd_cover, " + _strict('avg', 'cr') + " AS cr, " + _strict('stddev_samp', 'cr')
              + " AS sd_cr FROM cca_sites GROUP BY year) UNION ALL "
              "SELECT 'Coral', y.year, {cov}, {sdc}, {cr}, {sdcr}, " + r("y.cr * cx.sc") + ", " + r("y.sd_cr * cx.sc")
              + " FROM (SELECT year, " + _strict('avg', 'cover') + " AS cover, " + _strict('stddev_samp', 'cover')
              + " AS sd_cover, " + _strict('avg', 'cr') + " AS cr, " + _strict('stddev_samp', 'cr')
              + " AS sd_cr FROM coral_sites GROUP BY year) y JOIN complexity cx ON cx.year = y.year")
_YEARS_SQL = _YEARS_SQL.format(cov=r("cover", "cover"), sdc=r("sd_cover", "sd_cover"), cr=r("cr", "cr"),
                               sdcr=r("sd_cr", "sd_cr"))


@query("survey_rollup", _survey_sql(_YEARS_SQL))
def survey_rollup(spark, sf_dir):
    """ANA-10 / AGG-7: yearly cover and production of both groups (+ complexity for corals)."""
    res = _res(spark, sf_dir)
    cols = ["year", "cover", "sd_cover", "cr", "sd_cr"]
    cca = res.cca_years.select(F.lit("CCA").alias("component"), *cols,
                               F.lit(None).cast("double").alias("cr_sc"), F.lit(None).cast("double").alias("sd_cr_sc"))
    coral = res.coral_years.select(F.lit("Coral").alias("component"), *cols, "cr_sc", "sd_cr_sc")
    return rounded(cca.unionByName(coral))


@query("contribution", _survey_sql(
    "SELECT year, " + ", ".join(r(c, c) for c in ("contribution_avg", "sd", "upr", "lwr")) + " FROM ("
    "SELECT year, avg_c AS contribution_avg, sd, avg_c + sd AS upr, avg_c - sd AS lwr FROM ("
    "SELECT year, " + _strict('avg', 'contribution') + " AS avg_c, " + _strict('stddev_samp', 'contribution')
    + " AS sd FROM (SELECT a.year, a.site, a.cr / (a.cr + b.cr_sc) * 100 AS contribution FROM cca_sites a "
    "JOIN coral_sites b ON a.year IS NOT DISTINCT FROM b.year AND a.site IS NOT DISTINCT FROM b.site) GROUP BY year))"))
def contribution(spark, sf_dir):
    """ANA-11 / JOI-5: CCA share of production per (year, site), yearly mean +/- SD."""
    return rounded(SP.contribution_by_year(_res(spark, sf_dir)))


@query("semi_year", "WITH " + ", ".join(f"{n} AS ({B.sql_views()[n]})" for n in ("survey", "complexity"))
       + " SELECT year, functional_group, count(*) AS n FROM survey WHERE year IN (SELECT year FROM complexity) "
         "GROUP BY year, functional_group")
def semi_year(spark, sf_dir):
    """JOI-2: survey rows restricted to the years of the dimension (one year is absent)."""
    s = SV.restrict_years(B.survey(spark, sf_dir), B.survey_complexity(spark))
    return s.groupBy("year", "functional_group").agg(F.count(F.lit(1)).alias("n"))
