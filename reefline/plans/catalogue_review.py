"""Registered queries for job 1, systematic-review harmonisation (ANA-1..5, CLN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline.plans import review as RV
from reefline.plans.registry import query, r, rounded
from reefline.plans.review_sql import review_with
from reefline.sources import bindings as B

ORDER = B.LINEITEM_ORDER
BRANCH_COLS = ["paper_name", "method", "method_family", "unit", "species", "genus", "climate", "rate_std"]


def _branch_sql(*tables: str) -> str:
    sel = ("paper_name, method, method_family, unit, species, genus, climate, "
           + r("rate_std", "rate_std"))
    return review_with(" UNION ALL ".join(f"SELECT {sel} FROM {t}" for t in tables))


def _prepared(spark, sf_dir, *columns):
    return RV.prepare(B.study_rates(spark, sf_dir).select(*columns or ("*",)))


def _routed(spark, sf_dir):
    return RV.route_rates(B.study_rates(spark, sf_dir), ORDER)


@query("harmonise_biomass", _branch_sql("biom", "vol"))
def harmonise_biomass(spark, sf_dir):
    return rounded(RV.harmonise_biomass_and_volume(_prepared(spark, sf_dir, *RV.RATE_COLUMNS)).select(*BRANCH_COLS))


@query("harmonise_surface", _branch_sql("surf"))
def harmonise_surface(spark, sf_dir):
    return rounded(RV.harmonise_surface(_prepared(spark, sf_dir), ORDER).select(*BRANCH_COLS))


@query("harmonise_extension", _branch_sql("ext"))
def harmonise_extension(spark, sf_dir):
    return rounded(RV.harmonise_extension(_prepared(spark, sf_dir, *RV.RATE_COLUMNS)).select(*BRANCH_COLS))


RESCUE_COLS = ["paper_name", "method", "method_family", "unit", "species", "genus", "error", "rate_ext", "rate_surf",
               "rate_biom"]


@query("rescue_incomplete", review_with(
    "SELECT paper_name, method, method_family, unit, species, genus, error, "
    + ", ".join(r(c, c) for c in ("rate_ext", "rate_surf", "rate_biom")) + " FROM rescued"))
def rescue_incomplete(spark, sf_dir):
    return rounded(RV.rescue_incomplete(_routed(spark, sf_dir)).select(*RESCUE_COLS))


GROWTH_SQL_COLS = ("paper_name, genus, climate, " + r("temperature", "temperature") + ", method_family, "
                   + r("rate_std", "rate_std") + ", " + r("std_error", "std_error") + ", standardization")


@query("growth_table", review_with(f"SELECT {GROWTH_SQL_COLS} FROM growth"))
def growth_table(spark, sf_dir):
    g = RV.growth(B.study_rates(spark, sf_dir), ORDER, extra=B.extra_rates(spark, sf_dir))
    return rounded(g)


@query("incomplete_audit", review_with(
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT paper_name FROM prepared)) AS n_studies, "
    "(SELECT count(*) FROM used) AS n_used, (SELECT count(*) FROM inc_keys) AS n_incomplete"))
def incomplete_audit(spark, sf_dir):
    """AGG-10/11, SET-4/5: studies in total, used by a branch, and incomplete, from the bits of one aggregate."""
    used, count = F.col("branches") != 0, F.count(F.lit(1))
    return RV.study_audit(_routed(spark, sf_dir)).agg(
        count.alias("n_studies"), F.count(F.when(used, 1)).alias("n_used"), F.count(F.when(~used & F.col("no_method"), 1)).alias("n_incomplete"))
