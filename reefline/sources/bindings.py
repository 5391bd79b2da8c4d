"""Bindings of the driver's TPC-H-like tables to the library's logical tables.

The library's operators take logical tables (study rates, survey, reference
rates, draws).  Test and benchmark data arrive as a TPC-H-like star schema, so
each logical table is derived from it here, once, as a lazy Spark plan.  Every
binding has an SQL twin (``*_sql``) producing the same rows, which the oracle
queries use as a CTE.

Join strategy: the fact side (lineitem / orders / events) is never broadcast;
nation and region have a fixed size (25 / 5 rows) and are broadcast; part,
supplier and customer grow with the data, so the choice is left to the planner,
which broadcasts a side only when its measured size allows it.
Binding vocabularies are literal maps evaluated in codegen, not joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.lookup import lookup
from reefline.sources.tables import driver_table
from reefline.sqltext import sql_case, sql_in_list, sql_lit

# --- binding vocabularies (ours: how driver values stand in for study values) ---

# supplier key -> study name.  Keys not listed keep the supplier name.
STUDY_OF_SUPPLIER = [
    (0, "Graba-Landry et al. 2018"), (1, "Vasquez-Elizondo and Enriquez 2016"), (2, "Johnson and Carpenter 2012"),
    (3, "Ragazzola et al. 2012"), (4, "Donham et al 2022"), (5, "Semesi et al. 2009"),
    (6, "Narvarte et al. 2019"), (7, "Short et al. 2014"), (8, "Schubert et al 2021"),
    (9, "Russel et al. 2009"), (10, "Barner et al. 2018"), (11, "Ragazzola et al. 2013"),
    (12, "Legrand et al 2019"), (13, "Noisette et al. 2013 J phycol"), (14, "Burdett et al. 2018"),
    (15, "Tanaka et al. 2016"), (16, "Westfield et al 2022"), (17, "Williams et al 2020"),
    (18, "McCoy and Ragazzola 2014"), (19, "O'Leary et al. 2017"), (20, "McGraw et al. 2010"),
    (21, "Wei et al 2020"), (22, "Navarte et al 2020"), (23, "Qui-Minet et al. 2019"),
    (24, "Johnson et al 2019"), (25, "Schubert et al 2022"), (26, "Piazza et al 2022"),
    (27, "Sordo et al. 2018"), (28, "Noisette et al 2013 JEMBE"), (29, "Ragazzola et al 2020"),
]
# Studies reported without a method and in an unusable unit (they go to the rescue path).
INCOMPLETE_SUPPLIERS = [1, 3, 5, 7, 9, 11]
INCOMPLETE_UNIT = "um"

# p_brand -> reported unit spelling (None = unit missing).
UNIT_OF_BRAND = [
    ("Brand#1", "µmol/g/h"), ("Brand#2", "µmolC/g day"), ("Brand#3", "umol/g(dwt)/min"),
    ("Brand#4", "nmoles g-1 dry weight min-l"), ("Brand#5", "g CaCO3/g/h"), ("Brand#6", "mgCaCO3 g-1 d-1"),
    ("Brand#7", "mg g–1 d–1)"), ("Brand#8", "umol C h -1 g -1\x02"),
    ("Brand#9", "Net Calcification (μmol CaCO3 g−1 DW  hr−1)"), ("Brand#10", "mg wet weight mg-1 day-1"),
    ("Brand#11", "mg/cm2/d"), ("Brand#12", "mg/cm-2/year"), ("Brand#13", "mmol/cm**2/day"),
    ("Brand#14", "µmol CaCO3/cm2/h"), ("Brand#15", "Calcif in umol m-2 h-1"), ("Brand#16", "g CaCO3/cm3/year"),
    ("Brand#17", "mm/year"), ("Brand#18", "mm d-1"), ("Brand#19", "µm/day"), ("Brand#20", "cm month-1"),
    ("Brand#21", "mm/4 months"), ("Brand#22", "% per day"), ("Brand#23", "um"), ("Brand#24", None),
    ("Brand#25", "cm2 per year"),
]

# p_type -> reported method (None = not reported).
METHOD_OF_TYPE = [
    ("ECONOMY", "TA"), ("LARGE", "Calcofluor white"), ("MEDIUM", "13C"), ("PROMO", "Relative growth rate"),
    ("SMALL", None), ("STANDARD", "Net respiration"),
]

# r_name -> climate text (None = missing, 'NA' = the missing-value sentinel as text).
CLIMATE_OF_REGION = [
    ("AFRICA", None), ("AMERICA", "Tropical"), ("ASIA", "Warm temperate"), ("EUROPE", "Cool Temperate"),
    ("MIDDLE EAST", "NA"),
]

# p_type -> survey functional group (others keep p_type).
GROUP_OF_TYPE = [("ECONOMY", "Crustose Corallines"), ("LARGE", "Coral")]

# Yearly multiplier for the survey years (1998 deliberately absent).
SURVEY_COMPLEXITY = [(1995, 3.07), (1996, 2.73), (1997, 2.46), (1999, 1.75), (2000, 1.58), (2001, 2.21)]

NON_NUMERIC_TAX = 0.08       # this l_tax value is reported as text 'n/a'
DRAW_CHAINS = 4
BIOMASS_EVENT_TYPES = ["click", "purchase", "view"]

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = driver_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = driver_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                       .select("n_nationkey", "r_name"))


def study_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one row per lineitem as a reported rate of a study.

    Carries the lineitem columns as ``l_*`` provenance: together they are the
    total order used wherever row order matters (positional patches).
    """
    li = driver_table(spark, sf_dir, "lineitem", LINEITEM_ORDER)
    part = driver_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    sup = driver_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    # regions come last: the planner takes supplier joined with them for larger than it is, and would shuffle lineitem once more
    df = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    df = df.join(_geo(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    incomplete = F.coalesce(F.col("s_suppkey").isin(INCOMPLETE_SUPPLIERS), F.lit(False))
    return df.select(
        F.coalesce(lookup("s_suppkey", STUDY_OF_SUPPLIER), F.col("s_name")).alias("paper_name"),
        F.when(~incomplete, lookup("p_type", METHOD_OF_TYPE)).alias("method"),
        F.when(incomplete, F.lit(INCOMPLETE_UNIT)).otherwise(lookup("p_brand", UNIT_OF_BRAND)).alias("unit"),
        (F.col("l_quantity") - 5).alias("rate"),
        F.when(F.col("l_tax") == NON_NUMERIC_TAX, F.lit("n/a")).otherwise(F.col("l_tax").cast("string")).alias("error"),
        F.col("p_name").alias("species"),
        lookup("r_name", CLIMATE_OF_REGION).alias("climate"),
        F.col("l_discount").alias("temperature"),
        *LINEITEM_ORDER,
    )


def study_rates_sql() -> str:
    inc = f"s.s_suppkey IN {sql_in_list(INCOMPLETE_SUPPLIERS)}"
    order_cols = ", ".join(f"l.{c}" for c in LINEITEM_ORDER)
    return f"""
SELECT COALESCE({sql_case('s.s_suppkey', STUDY_OF_SUPPLIER)}, s.s_name) AS paper_name,
       CASE WHEN {inc} THEN NULL ELSE {sql_case('p.p_type', METHOD_OF_TYPE)} END AS method,
       CASE WHEN {inc} THEN {sql_lit(INCOMPLETE_UNIT)} ELSE {sql_case('p.p_brand', UNIT_OF_BRAND)} END AS unit,
       l.l_quantity - 5 AS rate,
       CASE WHEN l.l_tax = {sql_lit(NON_NUMERIC_TAX)} THEN 'n/a' ELSE CAST(l.l_tax AS VARCHAR) END AS error,
       p.p_name AS species,
       {sql_case('r.r_name', CLIMATE_OF_REGION)} AS climate,
       l.l_discount AS temperature,
       {order_cols}
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: quadrat survey rows (year, site, habitat, transect, quadrat, group, cover)."""
    li = driver_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
                                                  "l_linestatus", "l_linenumber", "l_quantity"])
    part = driver_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    sup = driver_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    df = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    return df.select(
        F.year("l_shipdate").cast("bigint").alias("year"),
        F.col("s_nationkey").cast("bigint").alias("site"),
        F.col("l_returnflag").alias("habitat"),
        F.col("l_linestatus").alias("transect"),
        F.col("l_linenumber").cast("bigint").alias("quadrat"),
        F.coalesce(lookup("p_type", GROUP_OF_TYPE), F.col("p_type")).alias("functional_group"),
        F.col("l_quantity").alias("percent_cover"),
    )


def survey_sql() -> str:
    return f"""
SELECT CAST(year(l.l_shipdate) AS BIGINT) AS year, CAST(s.s_nationkey AS BIGINT) AS site,
       l.l_returnflag AS habitat, l.l_linestatus AS transect, CAST(l.l_linenumber AS BIGINT) AS quadrat,
       COALESCE({sql_case('p.p_type', GROUP_OF_TYPE)}, p.p_type) AS functional_group,
       l.l_quantity AS percent_cover
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""


def reference_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B3 as two 'sheets': finished orders, and the others.  Species is missing for low priority."""
    orders = driver_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                                    "o_orderpriority"])
    cust = driver_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    df = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderstatus",
        F.year("o_orderdate").cast("double").alias("pubyear"),
        F.col("c_mktsegment").alias("genus"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("species"),
        F.col("o_totalprice").alias("conx"))
    cols = ["pubyear", "genus", "species", "conx"]
    return (df.where(F.col("o_orderstatus") == "F").select(*cols),
            df.where(~F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).select(*cols))


def reference_parts_sql() -> tuple[str, str]:
    base = """SELECT CAST(year(o.o_orderdate) AS DOUBLE) AS pubyear, c.c_mktsegment AS genus,
       NULLIF(o.o_orderpriority, '5-LOW') AS species, o.o_totalprice AS conx
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
    return (f"{base} WHERE o.o_orderstatus = 'F'",
            f"{base} WHERE NOT COALESCE(o.o_orderstatus = 'F', FALSE)")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: every event as a posterior draw.

    chain = event_id mod 4, iteration = position of the event within its
    (parameter, chain) by event_id.  Chains differ in length;
    ``operators.draws.equal_length`` is the step that diagnostics need.
    """
    from reefline.operators.ranking import row_position

    ev = driver_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    ev = ev.select(
        F.when(F.col("event_type").isin(BIOMASS_EVENT_TYPES), F.lit("Biomass")).otherwise(F.lit("Extension"))
         .alias("dataset"),
        F.col("event_type").alias("parameter"),
        (F.col("event_id") % DRAW_CHAINS).cast("int").alias("chain"),
        "event_id", "value")
    return row_position(ev, ["dataset", "parameter", "chain"], "event_id", out="iteration").select(
        "dataset", "parameter", "chain", "iteration", "value")


def draws_sql() -> str:
    return f"""
SELECT dataset, parameter, chain, row_number() OVER (PARTITION BY dataset, parameter, chain ORDER BY event_id) AS iteration, value
FROM (SELECT CASE WHEN event_type IN {sql_in_list(BIOMASS_EVENT_TYPES)} THEN 'Biomass' ELSE 'Extension' END AS dataset,
             event_type AS parameter, CAST(event_id % {DRAW_CHAINS} AS INTEGER) AS chain, event_id, value FROM events) e"""


EXTRA_SEGMENT = "HOUSEHOLD"
EXTRA_GENUS = "Halimeda"


def extra_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra rates delivered as an 8-column table in growth order, by position (SRC-4):
    customers of one segment stand in for a separately reported genus."""
    cust = driver_table(spark, sf_dir, "customer", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return cust.where(F.col("c_mktsegment") == EXTRA_SEGMENT).select(
        F.col("c_name").alias("Paper name"), F.lit(EXTRA_GENUS).alias("Genus"), F.lit("Tropical").alias("Climate"),
        F.col("c_nationkey").cast("double").alias("Temperature"), F.lit("BW or RGR").alias("Method_family"),
        (F.col("c_acctbal") / 1000).alias("Rate_std"), F.lit(None).cast("double").alias("std_error"),
        F.lit("Surface – mg_cm2_day").alias("Standardization"))


def extra_rates_sql() -> str:
    return f"""SELECT c_name AS paper_name, {sql_lit(EXTRA_GENUS)} AS genus, 'Tropical' AS climate,
       CAST(c_nationkey AS DOUBLE) AS temperature, 'BW or RGR' AS method_family, c_acctbal / 1000 AS rate_std,
       CAST(NULL AS DOUBLE) AS std_error, 'Surface – mg_cm2_day' AS standardization
FROM customer WHERE c_mktsegment = {sql_lit(EXTRA_SEGMENT)}"""


def survey_complexity(spark: SparkSession) -> DataFrame:
    from reefline.sources.literals import complexity_dim
    return complexity_dim(spark, SURVEY_COMPLEXITY)


def survey_complexity_sql() -> str:
    rows = ", ".join(f"({y}, {sql_lit(float(v))})" for y, v in SURVEY_COMPLEXITY)
    return f"SELECT CAST(year AS BIGINT) AS year, sc FROM (VALUES {rows}) t(year, sc)"


def sql_views() -> dict[str, str]:
    """CTE bodies for the oracle: rates, survey, ref_part1, ref_part2, draws, complexity."""
    p1, p2 = reference_parts_sql()
    return {"rates": study_rates_sql(), "survey": survey_sql(), "ref_part1": p1, "ref_part2": p2,
            "draws": draws_sql(), "complexity": survey_complexity_sql(), "extra": extra_rates_sql()}


def with_views(body: str, *names: str) -> str:
    views = sql_views()
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if names else body
