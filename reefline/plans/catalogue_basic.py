"""Registered queries for single operators: scans, projections, filters, cleaning steps.

Each runs over whole driver tables (through the bindings) and reports either the
transformed rows or a per-key count / mean, with an SQL twin for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions import as_number, censor, in_range, nonnegative, not_contains, not_in
from reefline.functions.text import binomial, genus_of
from reefline.operators import cleaning as C
from reefline.operators.routing import to_targets
from reefline.plans import figures as FG
from reefline.plans import review as RV
from reefline.plans.registry import query, r, rounded
from reefline.plans.review_sql import convert, in_set, patched, review_with
from reefline.sources import bindings as B
from reefline.sources.multipart import positional_append
from reefline.sources.tables import driver_table
from reefline.sqltext import sql_lit, sql_str

RATES = "WITH rates AS (" + B.study_rates_sql() + ")\n"
RATE_COLS = ["paper_name", "method", "unit", "rate", "error", "species", "climate", "temperature"]


def _rates(spark, sf_dir):
    return B.study_rates(spark, sf_dir)


def _count_by(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


# --- sources -------------------------------------------------------------------------

@query("scan_rates", RATES + "SELECT paper_name, method, unit, " + r("rate", "rate")
       + ", error, species, climate, " + r("temperature", "temperature") + " FROM rates")
def scan_rates(spark, sf_dir):
    """SRC-1: the reported-rates table (projected columns only reach the scans)."""
    return rounded(_rates(spark, sf_dir).select(*RATE_COLS))


@query("scan_survey", "WITH survey AS (" + B.survey_sql() + ") SELECT year, site, habitat, transect, quadrat, "
       "functional_group, " + r("percent_cover", "percent_cover") + " FROM survey")
def scan_survey(spark, sf_dir):
    """SRC-2: the quadrat survey table."""
    return rounded(B.survey(spark, sf_dir))


@query("scan_draws", "WITH draws AS (" + B.draws_sql() + ") SELECT dataset, parameter, chain, iteration, "
       + r("value", "value") + " FROM draws")
def scan_draws(spark, sf_dir):
    """SRC-7: the long draws table (iterations numbered per chain, equal chain lengths)."""
    return rounded(B.draws(spark, sf_dir))


@query("scan_union_distinct", review_with("SELECT pubyear, genus, species, " + r("conx", "conx") + " FROM reference_rates"))
def scan_union_distinct(spark, sf_dir):
    """SRC-3 / SET-1 / SET-3 / FIL-10 / CLN-16: two sheets, distinct each, nulls dropped
    in the first only, appended and rescaled."""
    return rounded(FG.reference_rates(*B.reference_parts(spark, sf_dir)))


@query("positional_append", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def positional_append_q(spark, sf_dir):
    """SRC-4 / PRJ-4: a table appended by column position under the base's names."""
    base = driver_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    extra = driver_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return positional_append(base, extra)


# --- projections ---------------------------------------------------------------------

@query("select_rename_drop", RATES + "SELECT paper_name, species, unit, " + r("rate", "rate_raw") + ", "
       + r("rate * 10", "rate_x10") + ", 'reported' AS source FROM rates")
def select_rename_drop(spark, sf_dir):
    """PRJ-1/2/3/5/6: select and reorder, drop, rename, derived and constant columns."""
    df = _rates(spark, sf_dir).select("paper_name", "species", "unit", "rate", "temperature")
    df = df.drop("temperature").withColumnRenamed("rate", "rate_raw")
    df = df.withColumn("rate_x10", F.col("rate_raw") * 10).withColumn("source", F.lit("reported"))
    return rounded(df)


_NUM = "CASE WHEN regexp_matches(error, {p}) THEN TRY_CAST(trim(error) AS DOUBLE) END"


def _num_sql():
    from reefline.functions.numeric import NUMBER_PATTERN
    return _NUM.format(p=sql_str(NUMBER_PATTERN))


@query("error_bounds", RATES + "SELECT paper_name, " + r("rate", "rate") + ", " + r(f"({_num_sql()})", "err") + ", "
       + r(f"rate - ({_num_sql()})", "lwr") + ", " + r(f"rate + ({_num_sql()})", "upr") + " FROM rates")
def error_bounds(spark, sf_dir):
    """PRJ-8 / FUN-8: error text made numeric (non-numbers missing) and rate +/- error."""
    df = _rates(spark, sf_dir).withColumn("err", as_number("error"))
    return rounded(df.select("paper_name", "rate", "err", (F.col("rate") - F.col("err")).alias("lwr"),
                             (F.col("rate") + F.col("err")).alias("upr")))


# --- filters -------------------------------------------------------------------------

@query("filter_eq_in", RATES + "SELECT paper_name, method, climate, " + r("rate", "rate") + " FROM rates "
       "WHERE climate = 'Tropical' AND method IN ('TA', '13C')")
def filter_eq_in(spark, sf_dir):
    """FIL-1 / FIL-3: equality and set membership."""
    df = _rates(spark, sf_dir).where((F.col("climate") == "Tropical") & F.col("method").isin("TA", "13C"))
    return rounded(df.select("paper_name", "method", "climate", "rate"))


@query("filter_neq", RATES + "SELECT method, count(*) AS n FROM rates WHERE method <> 'TA' AND method <> '13C' GROUP BY method")
def filter_neq(spark, sf_dir):
    """FIL-2: ANDed inequalities (a missing value is dropped)."""
    return _count_by(_rates(spark, sf_dir).where((F.col("method") != "TA") & (F.col("method") != "13C")), "method")


@query("not_in_null_safe", RATES + "SELECT climate, count(*) AS n FROM rates WHERE NOT "
       + in_set("climate", ["Tropical", "Polar"]) + " GROUP BY climate")
def not_in_null_safe(spark, sf_dir):
    """FIL-4 / SET-6: NOT IN that keeps missing values."""
    return _count_by(_rates(spark, sf_dir).where(not_in("climate", ["Tropical", "Polar"])), "climate")


@query("not_in_null_member", RATES + "SELECT climate, count(*) AS n FROM rates WHERE NOT "
       + in_set("climate", ["Tropical", None]) + " GROUP BY climate")
def not_in_null_member(spark, sf_dir):
    """FIL-4: NOT IN with a missing value in the set drops missing rows too."""
    return _count_by(_rates(spark, sf_dir).where(not_in("climate", ["Tropical", None])), "climate")


@query("nonnegative_rates", "SELECT c_custkey, " + r("c_acctbal", "c_acctbal")
       + " FROM customer WHERE c_acctbal >= 0 AND NOT isnan(c_acctbal)")
def nonnegative_rates(spark, sf_dir):
    """FIL-5: value >= 0 (missing and NaN rejected)."""
    c = driver_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return rounded(c.where(nonnegative("c_acctbal")))


@query("float_inequality", RATES + "SELECT " + r("temperature", "temperature")
       + ", count(*) AS n FROM rates WHERE temperature <> 0.05 GROUP BY temperature")
def float_inequality(spark, sf_dir):
    """FIL-6: inequality on one floating value (missing rows dropped too)."""
    df = _rates(spark, sf_dir).where(F.col("temperature") != F.lit(0.05))
    return rounded(_count_by(df, "temperature"))


@query("between_filter", RATES + "SELECT " + r("rate", "rate") + ", count(*) AS n FROM rates "
       "WHERE rate BETWEEN 0 AND 10 AND NOT isnan(rate) GROUP BY rate")
def between_filter(spark, sf_dir):
    """FIL-7 / FUN-11: inclusive range."""
    return rounded(_count_by(_rates(spark, sf_dir).where(in_range("rate", 0, 10)), "rate"))


@query("pattern_exclusion", RATES + "SELECT sp AS species, count(*) AS n FROM (SELECT NULLIF(species, 'blue ring') AS sp "
       "FROM rates) WHERE NOT COALESCE(contains(sp, 'red'), FALSE) GROUP BY sp")
def pattern_exclusion(spark, sf_dir):
    """FIL-8 / FUN-4: substring exclusion that keeps missing values."""
    df = _rates(spark, sf_dir).select(F.nullif(F.col("species"), F.lit("blue ring")).alias("species"))
    return _count_by(df.where(not_contains("species", "red")), "species")


@query("drop_null_columns", RATES + "SELECT climate, count(*) AS n FROM rates WHERE climate IS NOT NULL GROUP BY climate")
def drop_null_columns(spark, sf_dir):
    """FIL-9 / FUN-14: drop rows missing a named column."""
    return _count_by(_rates(spark, sf_dir).na.drop(subset=["climate"]), "climate")


@query("axis_censor", RATES + "SELECT " + r("CASE WHEN rate BETWEEN 0 AND 30 AND NOT isnan(rate) THEN rate END", "y")
       + ", count(*) AS n FROM rates GROUP BY 1")
def axis_censor(spark, sf_dir):
    """FIL-11: values outside the axis limits become missing (rows kept)."""
    return rounded(_count_by(_rates(spark, sf_dir).select(censor("rate", 0, 30).alias("y")), "y"))


# --- cleaning steps ------------------------------------------------------------------

@query("method_family", review_with("SELECT method, NULLIF(method_family, 'NA') AS method_family, count(*) AS n "
                                    "FROM prepared GROUP BY ALL"))
def method_family(spark, sf_dir):
    """CLN-1/2/3, JOI-7, FUN-5: families from the vocabulary, sentinel fill and unfill."""
    p = C.unfill(C.classify_methods(_rates(spark, sf_dir)), ["method_family"])
    return _count_by(p, "method", "method_family")


@query("unit_canonical", RATES + "SELECT CASE WHEN " + in_set("unit", fv.BIOMASS_TO_CANONICAL) + " THEN "
       + sql_str(fv.CANONICAL_BIOMASS) + " ELSE unit END AS unit, count(*) AS n FROM rates GROUP BY 1")
def unit_canonical(spark, sf_dir):
    """CLN-4 / FUN-6: spellings folded into the canonical biomass spelling."""
    return _count_by(C.canonicalise(_rates(spark, sf_dir), fv.BIOMASS_TO_CANONICAL, fv.CANONICAL_BIOMASS), "unit")


def _conv_sql() -> str:
    parts = []
    for label, rules in (("biomass", fv.BIOMASS_RATE_RULES), ("volume", fv.VOLUME_RATE_RULES),
                         ("surface", fv.SURFACE_RATE_RULES), ("extension", fv.EXTENSION_RATE_RULES)):
        parts.append(f"SELECT '{label}' AS target, unit, {convert('rate', 'unit', rules)} AS v FROM u")
    canon = (f"CASE WHEN {in_set('unit', fv.BIOMASS_TO_CANONICAL)} THEN {sql_str(fv.CANONICAL_BIOMASS)} "
             f"WHEN {in_set('unit', fv.SURFACE_TO_CANONICAL)} THEN {sql_str(fv.CANONICAL_SURFACE)} "
             f"WHEN {in_set('unit', fv.EXTENSION_TO_CANONICAL)} THEN {sql_str(fv.CANONICAL_EXTENSION)} ELSE unit END")
    return (RATES.replace(")\n", "),\n", 1) + f"u AS (SELECT {canon} AS unit, rate FROM rates)\n"
            + "SELECT target, unit, count(v) AS n, " + r("avg(v)", "mean_std") + " FROM ("
            + " UNION ALL ".join(parts) + ") WHERE v IS NOT NULL GROUP BY target, unit")


@query("unit_conversion", _conv_sql())
def unit_conversion(spark, sf_dir):
    """CLN-5/6/7/8 / FUN-7 / FUN-10: every rate converted by each target's rules
    (no rule -> missing), summarised per (target, unit)."""
    df = _rates(spark, sf_dir)
    df = C.canonicalise(C.canonicalise(C.canonicalise(df, fv.BIOMASS_TO_CANONICAL, fv.CANONICAL_BIOMASS),
                                       fv.SURFACE_TO_CANONICAL, fv.CANONICAL_SURFACE),
                        fv.EXTENSION_TO_CANONICAL, fv.CANONICAL_EXTENSION)
    out = None
    for label, rules in (("biomass", fv.BIOMASS_RATE_RULES), ("volume", fv.VOLUME_RATE_RULES),
                         ("surface", fv.SURFACE_RATE_RULES), ("extension", fv.EXTENSION_RATE_RULES)):
        part = C.convert_units(df, rules, "v").select(F.lit(label).alias("target"), "unit", "v")
        out = part if out is None else out.unionByName(part)
    g = out.where(F.col("v").isNotNull()).groupBy("target", "unit").agg(F.count("v").alias("n"),
                                                                       F.avg("v").alias("mean_std"))
    return rounded(g)


@query("rescue_route", review_with(
    "SELECT 'biomass' AS target, count(*) AS n FROM rescued WHERE rate_biom IS NOT NULL UNION ALL "
    "SELECT 'surface', count(*) FROM rescued WHERE rate_surf IS NOT NULL UNION ALL "
    "SELECT 'extension', count(*) FROM rescued WHERE rate_ext IS NOT NULL"))
def rescue_route(spark, sf_dir):
    """CLN-9: rescued rows routed to the target whose column is not missing."""
    names = {"rate_biom": "biomass", "rate_surf": "surface", "rate_ext": "extension"}
    rescued = to_targets(RV.rescue_incomplete(RV.route_rates(_rates(spark, sf_dir), B.LINEITEM_ORDER)), names, "target", "rate_std")
    counts = rescued.agg(*[F.count(F.when(F.col("target") == n, 1)).alias(n) for n in names.values()])     # a target without rows counts 0
    return counts.unpivot([], list(names.values()), "target", "n")


@query("error_convert", review_with("SELECT standardization, count(std_error) AS n, " + r("avg(std_error)", "mean_error")
                                    + " FROM growth WHERE std_error IS NOT NULL GROUP BY standardization"))
def error_convert(spark, sf_dir):
    """CLN-10: standardised errors per part (rules missing for four units -> missing)."""
    g = RV.growth(_rates(spark, sf_dir), B.LINEITEM_ORDER, extra=B.extra_rates(spark, sf_dir))
    return rounded(g.where(F.col("std_error").isNotNull()).groupBy("standardization").agg(
        F.count("std_error").alias("n"), F.avg("std_error").alias("mean_error")))


@query("patch_scalar", review_with("SELECT paper_name, method, method_family, climate, count(*) AS n FROM ("
                                   "SELECT * REPLACE (" + patched(fv.BIOMASS_PATCHES, None) + ") FROM prepared) GROUP BY ALL"))
def patch_scalar(spark, sf_dir):
    """CLN-11: keyed scalar patches applied in order (method, family, climate)."""
    p = C.patch_values(C.classify_methods(_rates(spark, sf_dir)), fv.BIOMASS_PATCHES)
    return _count_by(p, "paper_name", "method", "method_family", "climate")


@query("patch_arith", RATES + "SELECT paper_name, " + r("avg(r2)", "mean_rate") + " FROM (SELECT paper_name, CASE WHEN "
       + in_set("paper_name", fv.BIOMASS_DAY_NOT_HOUR) + " THEN rate / 24.0 ELSE rate END AS r2 FROM rates) GROUP BY paper_name")
def patch_arith(spark, sf_dir):
    """CLN-12: keyed arithmetic patch (rate / 24 for the listed study)."""
    df = C.patch_scale(_rates(spark, sf_dir), fv.BIOMASS_DAY_NOT_HOUR, "rate", fv.DAY_TO_HOUR)
    return rounded(df.groupBy("paper_name").agg(F.avg("rate").alias("mean_rate")))


_POS_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in B.LINEITEM_ORDER)


@query("patch_positional", RATES + "SELECT paper_name, count(*) AS n, " + r("avg(r2)", "mean_rate") + " FROM ("
       "SELECT paper_name, CASE WHEN paper_name = " + sql_str(fv.SURFACE_POSITIONAL[0]) + " THEN ["
       + ", ".join(sql_lit(float(v)) for v in fv.SURFACE_POSITIONAL[1]["rate"]) + "][((row_number() OVER (PARTITION BY "
       f"paper_name ORDER BY {_POS_ORDER}) - 1) % 2) + 1] ELSE rate END AS r2 FROM rates) GROUP BY paper_name")
def patch_positional(spark, sf_dir):
    """CLN-13 / WIN-1: n-th row of the study (total order of the source rows) gets the n-th value."""
    target, values = fv.SURFACE_POSITIONAL
    df = C.patch_positional(_rates(spark, sf_dir), target, {"rate": values["rate"]}, B.LINEITEM_ORDER)
    return rounded(df.groupBy("paper_name").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean_rate")))


_EXCLUDED = fv.BIOMASS_EXCLUDED + fv.SURFACE_EXCLUDED


@query("study_exclusion", RATES + "SELECT paper_name, count(*) AS n FROM rates r WHERE NOT EXISTS (SELECT 1 FROM (VALUES "
       + ", ".join(f"({sql_str(p)})" for p in _EXCLUDED) + ") x(p) WHERE x.p = r.paper_name) GROUP BY paper_name")
def study_exclusion(spark, sf_dir):
    """CLN-14 / JOI-3: anti join against an exclusion table."""
    excl = spark.createDataFrame([(p,) for p in _EXCLUDED], "paper_name string")
    return _count_by(C.exclude_by_table(_rates(spark, sf_dir), F.broadcast(excl)), "paper_name")


@query("recode_label", RATES + "SELECT CASE WHEN climate = 'Cool Temperate' THEN 'Cool temperate' ELSE climate END AS climate, "
       "count(*) AS n FROM rates GROUP BY 1")
def recode_label(spark, sf_dir):
    """CLN-15: one label recoded."""
    old, new = fv.CLIMATE_RECODE
    return _count_by(C.recode(_rates(spark, sf_dir), "climate", old, new), "climate")


_ONE_WORD = "CASE WHEN p_size < 10 THEN split_part(p_name, ' ', 1) ELSE p_name END"


@query("taxon_words", "SELECT string_split(sp, ' ')[1] AS genus, COALESCE(string_split(sp, ' ')[1], 'NA') || '_' || "
       "COALESCE(string_split(sp, ' ')[2], 'NA') AS species, count(*) AS n FROM (SELECT " + _ONE_WORD
       + " AS sp FROM part) GROUP BY ALL")
def taxon_words(spark, sf_dir):
    """CLN-17 / FUN-1 / FUN-2: genus = first word, Genus_species with 'NA' for a missing word."""
    p = driver_table(spark, sf_dir, "part", ["p_name", "p_size"])
    sp = F.when(F.col("p_size") < 10, F.split(F.col("p_name"), " ")[0]).otherwise(F.col("p_name")).alias("sp")
    df = p.select(sp).select(genus_of("sp").alias("genus"), binomial("sp").alias("species"))
    return _count_by(df, "genus", "species")

