"""Registered queries for job 2: distribution summaries and the mixture sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.text import genus_of
from reefline.operators import summaries as S
from reefline.operators.joins import join_null_safe
from reefline.operators.mixture import crossover_thresholds, mixture_curves, ratio_sweep
from reefline.plans import figures as FG
from reefline.plans import review as RV
from reefline.plans.registry import query, r, rounded
from reefline.plans.review_sql import review_with
from reefline.plans.sql_helpers import quantiles_sql
from reefline.sources import bindings as B
from reefline.session import cut_lineage
from reefline.sources.literals import cover_grid
from reefline.sqltext import sql_in_list, sql_str

ORDER = B.LINEITEM_ORDER
QN = FG.QUANTILE_NAMES
QP = fv.QUANTILE_PROBS


def _growth(spark, sf_dir):
    """The unified growth table, materialised once (several aggregates read it)."""
    return cut_lineage(RV.growth(B.study_rates(spark, sf_dir), ORDER, extra=B.extra_rates(spark, sf_dir)))


def _data_cca(spark, sf_dir, *columns):
    """The surface rows of the growth table, of which only ``columns`` are written."""
    g = RV.growth(B.study_rates(spark, sf_dir), ORDER, extra=B.extra_rates(spark, sf_dir))
    return cut_lineage(RV.cca_surface_g_cm2_year(g).select(*columns))


def _reference_rates(spark, sf_dir, *columns):
    """The coral rates, written once as quantiles read them twice."""
    return cut_lineage(FG.reference_rates(*B.reference_parts(spark, sf_dir)).select(*columns or ("*",)))


def _rq(names):
    return ", ".join(r(n, n) for n in names)


# --- quantiles ---------------------------------------------------------------

_CCA_WARM = f"(SELECT * FROM data_cca WHERE COALESCE(climate IN {sql_in_list(FG.CCA_CLIMATES)}, FALSE))"
_CCA_CRUST = (f"(SELECT * FROM {_CCA_WARM} WHERE NOT COALESCE(genus IN {sql_in_list(fv.ARTICULATE_GENERA)}, FALSE) "
              f"AND genus <> {sql_str(fv.HALIMEDA)})")


def _qoq_sql(src: str, key: str, col: str, label: str) -> str:
    per = quantiles_sql(src, [key], col, QP, QN)
    cols = ", ".join(f"(SELECT q FROM ({quantiles_sql('(' + per + ')', [], n, [p], ['q'])})) AS {n}"
                     for n, p in zip(QN, QP))
    return f"SELECT {sql_str(label)} AS genus, {cols}"


QUANTILE_SUMMARY_SQL = review_with(
    f"SELECT component, genus, {_rq(QN)} FROM ("
    f"SELECT 'CCA' AS component, * FROM ({quantiles_sql(_CCA_WARM, ['genus'], 'rate_std', QP, QN)}) UNION ALL "
    f"SELECT 'CCA', * FROM ({_qoq_sql(_CCA_CRUST, 'genus', 'rate_std', 'All CCA')}) UNION ALL "
    f"SELECT 'Coral', * FROM ({quantiles_sql('reference_rates', ['genus'], 'conx', QP, QN)}) UNION ALL "
    f"SELECT 'Coral', * FROM ({_qoq_sql('reference_rates', 'genus', 'conx', 'All Corals')}))")


@query("quantile_summary", QUANTILE_SUMMARY_SQL)
def quantile_summary(spark, sf_dir):
    """ANA-6 (flagship): per-genus quantiles and the quantile-of-quantiles rows."""
    cca = _data_cca(spark, sf_dir, "genus", "climate", "rate_std")
    return rounded(FG.quantile_summary(cca, _reference_rates(spark, sf_dir, "genus", "conx"))
                   .select("component", "genus", *QN))


_RATES_GENUS = "(SELECT string_split(species, ' ')[1] AS genus, rate FROM rates)"


_GQ_SQL = (f"WITH rates AS ({B.study_rates_sql()}) "
           f"SELECT genus, {_rq(QN)} FROM ({quantiles_sql(_RATES_GENUS, ['genus'], 'rate', QP, QN)})")


@query("group_quantiles", _GQ_SQL)
def group_quantiles(spark, sf_dir):
    """AGG-2: exact quantiles of the reported rate per genus (first word of the species)."""
    rates = cut_lineage(B.study_rates(spark, sf_dir).select(genus_of("species").alias("genus"), "rate"))     # joins, and read twice
    return rounded(S.group_quantiles(rates, ["genus"], "rate", QP, QN))


@query("group_quantiles_ranked", _GQ_SQL)
def group_quantiles_ranked(spark, sf_dir):
    """AGG-2 with the rows dealt out anew first: the result does not depend on the partitioning."""
    rates = cut_lineage(B.study_rates(spark, sf_dir).select(genus_of("species").alias("genus"), "rate").repartition("rate"))
    return rounded(S.group_quantiles(rates, ["genus"], "rate", QP, QN))


@query("quantile_of_quantiles", review_with(f"SELECT genus, {_rq(QN)} FROM ({_qoq_sql('reference_rates', 'genus', 'conx', 'All Corals')})"))
def quantile_of_quantiles(spark, sf_dir):
    """AGG-3: the 'All Corals' row."""
    return rounded(S.quantile_of_quantiles(_reference_rates(spark, sf_dir), ["genus"], "conx", QP, "genus", "All Corals", QN))


GQ = [S.qname(p) for p in fv.GLOBAL_QUANTILE_PROBS]


@query("global_quantiles", review_with(
    f"SELECT 'CCA' AS component, {_rq(GQ)} FROM ({quantiles_sql('data_cca', [], 'rate_std', fv.GLOBAL_QUANTILE_PROBS, GQ)}) "
    f"UNION ALL SELECT 'Coral', {_rq(GQ)} FROM ({quantiles_sql('reference_rates', [], 'conx', fv.GLOBAL_QUANTILE_PROBS, GQ)})"))
def global_quantiles(spark, sf_dir):
    """AGG-4: the 7-probability quantile vector of each component."""
    c = S.group_quantiles(_data_cca(spark, sf_dir, "rate_std"), [], "rate_std", fv.GLOBAL_QUANTILE_PROBS, GQ)
    k = S.group_quantiles(_reference_rates(spark, sf_dir, "conx"), [], "conx", fv.GLOBAL_QUANTILE_PROBS, GQ)
    return rounded(c.select(F.lit("CCA").alias("component"), *GQ)
                   .unionByName(k.select(F.lit("Coral").alias("component"), *GQ)))


@query("group_plus_total", review_with(
    f"SELECT genus, {r('mean', 'mean')}, {r('sd', 'sd')} FROM (SELECT genus, avg(conx) AS mean, stddev_samp(conx) AS sd "
    f"FROM reference_rates GROUP BY genus UNION ALL SELECT 'All Corals', avg(conx), stddev_samp(conx) FROM reference_rates)"))
def group_plus_total(spark, sf_dir):
    """AGG-5: per-genus mean and SD plus the grand total in one grouping-sets aggregate."""
    return rounded(S.with_total(_reference_rates(spark, sf_dir), "genus", "conx", "All Corals"))


# Name suffix, table of the SQL twin, branch, whether a missing value makes a group's mean missing, largest rate in box plots.
BRANCHES = [("", "biom", RV.harmonise_biomass, False, 10), ("_surface", "surf", lambda p: RV.harmonise_surface(p, ORDER), True, None),
            ("_extension", "ext", RV.harmonise_extension, True, None)]


def _mean_sd_sql(table: str, strict: bool) -> str:
    def of(agg: str) -> str:
        return f"CASE WHEN count(rate_std) = count(*) THEN {agg}(rate_std) END" if strict else f"{agg}(rate_std)"
    return review_with(f"SELECT method_family, climate, {r('mean', 'growth_rate')}, {r('sd', 'sd')}, n FROM (SELECT method_family, climate, "
                       f"{of('avg')} AS mean, {of('stddev_samp')} AS sd, count(*) AS n FROM {table} GROUP BY method_family, climate)")


def _crosstab_sql(table: str) -> str:
    present = f"FROM {table} WHERE method_family IS NOT NULL AND genus IS NOT NULL"
    return review_with(
        f"SELECT a.method_family, b.genus, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT method_family {present}) a "
        f"CROSS JOIN (SELECT DISTINCT genus {present}) b LEFT JOIN (SELECT method_family, genus, count(*) AS n {present} "
        "GROUP BY method_family, genus) c ON c.method_family = a.method_family AND c.genus = b.genus")


def _box_sql(table: str, largest: float | None) -> str:
    src = (f"(SELECT method_family, rate_std FROM {table} WHERE rate_std IS NOT NULL AND NOT isnan(rate_std)"
           + (f" AND rate_std <= {largest}" if largest is not None else "") + ")")
    hinges = quantiles_sql(src, ["method_family"], "rate_std", [0.25, 0.5, 0.75], ["lower", "middle", "upper"])
    return review_with(
        "SELECT method_family, " + ", ".join(r(c, c) for c in ("ymin", "lower", "middle", "upper", "ymax"))
        + ", n_outliers, n FROM (SELECT method_family, lower, middle, upper, min(CASE WHEN inside THEN v END) AS ymin, "
        "max(CASE WHEN inside THEN v END) AS ymax, count(*) FILTER (WHERE NOT inside) AS n_outliers, count(*) AS n FROM ("
        "SELECT s.method_family, s.rate_std AS v, q.lower, q.middle, q.upper, s.rate_std >= q.lower - 1.5 * (q.upper - q.lower) "
        f"AND s.rate_std <= q.upper + 1.5 * (q.upper - q.lower) AS inside FROM {src} s JOIN ({hinges}) q "
        "ON s.method_family IS NOT DISTINCT FROM q.method_family) GROUP BY method_family, lower, middle, upper)")


def _register_branch(suffix, table, harmonise, strict, largest) -> None:
    """AGG-1, AGG-8 and AGG-9 of one branch."""
    ordinals = ORDER if suffix == "_surface" else []       # of a positional correction

    def rows(spark, sf_dir):
        return harmonise(RV.prepare(B.study_rates(spark, sf_dir).select(*RV.RATE_COLUMNS, *ordinals)))

    @query("group_mean_sd" + suffix, _mean_sd_sql(table, strict))
    def group_mean_sd(spark, sf_dir):
        """AGG-1: mean and SD by (method family, climate); NULL keys are groups."""
        written = cut_lineage(rows(spark, sf_dir).select("method_family", "climate", "rate_std"))
        keys = ["method_family", "climate"]
        stats = S.group_mean_sd(written, keys, "rate_std", "growth_rate", "sd", strict)
        return rounded(join_null_safe(stats, written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys))

    @query("crosstab_long" + suffix, _crosstab_sql(table))
    def crosstab_long(spark, sf_dir):
        """AGG-8: method family x genus counts, empty cells as 0."""
        return S.crosstab_long(rows(spark, sf_dir), "method_family", "genus")

    @query("box_stats" + suffix, _box_sql(table, largest))
    def box_stats(spark, sf_dir):
        """AGG-9: box-plot statistics per method family."""
        df = cut_lineage(rows(spark, sf_dir).select("method_family", "rate_std"))
        return rounded(S.box_stats(df if largest is None else df.where(F.col("rate_std") <= largest), ["method_family"], "rate_std"))


for _branch in BRANCHES:
    _register_branch(*_branch)


@query("distinct_with_null", "WITH rates AS (" + B.study_rates_sql() + ") SELECT "
       "CAST(count(DISTINCT climate) + max(CAST(climate IS NULL AS INTEGER)) AS BIGINT) AS n_distinct FROM rates")
def distinct_with_null(spark, sf_dir):
    """AGG-10: distinct climates counting a missing value as one value."""
    return S.distinct_count(B.study_rates(spark, sf_dir), "climate")


# --- mixture -------------------------------------------------------------------

def _rates_sql() -> str:
    def q(src, col, p):
        return f"(SELECT q FROM ({quantiles_sql(src, [], col, [p], ['q'])}))"
    return (f"SELECT {q('data_cca', 'rate_std', 0.25)} * 10.0 AS cca_lwr, {q('data_cca', 'rate_std', 0.5)} * 10.0 AS cca, "
            f"{q('data_cca', 'rate_std', 0.75)} * 10.0 AS cca_upr, {q('reference_rates', 'conx', 0.25)} * 10.0 AS coral_lwr, "
            f"{q('reference_rates', 'conx', 0.5)} * 10.0 AS coral, {q('reference_rates', 'conx', 0.75)} * 10.0 AS coral_upr")


def _own_total_sql(bound: str, ratio: str) -> tuple[str, str]:
    """The stated formulas for one bound: own = q1 r c / 100, total = q2 (100 - c) / 100 + own, bounds crossed."""
    q2, q1 = {"lwr": ("cca_lwr", "coral_upr"), "median": ("cca", "coral"), "upr": ("cca_upr", "coral_lwr")}[bound]
    own = f"{q1} * {ratio} * (coral_cover / 100.0)"
    return own, f"{q2} * ((100.0 - coral_cover) / 100.0) + {own}"


def _share_sql(part: str, total: str) -> str:
    return f"(({part}) / NULLIF(({total}), 0)) * 100.0"


def _curve_sql() -> list[tuple[str, str]]:
    other = {"lwr": "cca_upr * (cca_cover / 100.0)", "median": "cca * (cca_cover / 100.0)", "upr": "cca_lwr * (cca_cover / 100.0)"}
    opposite = {"lwr": "upr", "median": "median", "upr": "lwr"}
    out = [(f"{b}_ccca", e) for b, e in other.items()]
    for form, of_own, of_other, ratio in (("", "g_percent_coral", "g_percent_cca", "1.0"),
                                          ("_b", "g_percent_branching", "gb_percent_cca", "2.97"),
                                          ("_m", "g_percent_massive", "gm_percent_cca", "1.54")):
        for b in opposite:
            own, total = _own_total_sql(b, ratio)
            end = "" if b == "median" else "_" + b
            out += [(f"{b}_ccoral{form}", own), (f"{b}{form}", total), (of_own + end, _share_sql(own, total)),
                    (of_other + end, _share_sql(other[b], _own_total_sql(opposite[b], ratio)[1]))]
    return out


def _mixture_rates(spark, sf_dir):
    return FG.mixture_rates(_data_cca(spark, sf_dir, "rate_std"), _reference_rates(spark, sf_dir, "conx"))


_GRID = "(SELECT range * 0.01::DOUBLE AS cca_cover, 100.0::DOUBLE - range * 0.01::DOUBLE AS coral_cover FROM range(10001))"
_MIX_SELECT = ", ".join(f"({e}) AS {n}" for n, e in _curve_sql())
_MIX_SQL = f"SELECT cca_cover, coral_cover, {_MIX_SELECT} FROM {_GRID} g, ({_rates_sql()}) rt"


@query("mixture_curves", review_with(
    "SELECT " + ", ".join(r(n, n) for n in ["cca_cover", "coral_cover"] + [n for n, _ in _curve_sql()])
    + f" FROM ({_MIX_SQL})"))
def mixture_curves_q(spark, sf_dir):
    """ANA-7: component curves and percent shares on the 10,001-point cover grid."""
    return rounded(mixture_curves(cover_grid(spark), _mixture_rates(spark, sf_dir)))


@query("crossover_thresholds", review_with(
    "SELECT max(CASE WHEN ceil(g_percent_coral) = 50 THEN coral_cover END) AS flat_threshold, "
    "max(CASE WHEN ceil(g_percent_massive) = 50 THEN coral_cover END) AS massive_threshold, "
    "max(CASE WHEN ceil(g_percent_branching) = 50 THEN coral_cover END) AS branching_threshold "
    f"FROM ({_MIX_SQL})"))
def crossover_thresholds_q(spark, sf_dir):
    """ANA-8: coral cover at which the coral share first rounds up to 50 % (3 growth forms)."""
    return rounded(crossover_thresholds(cover_grid(spark), _mixture_rates(spark, sf_dir)))


def _sweep_sql() -> str:
    lwr, med, upr = (_share_sql(*_own_total_sql(b, "(k / 100.0)")) for b in ("lwr", "median", "upr"))
    cells = ("(SELECT CAST(range // 10001 + 1 AS INTEGER) AS k, 100.0::DOUBLE - (range % 10001) * 0.01::DOUBLE AS coral_cover "
             "FROM range(4000400))")
    return (f"SELECT k / 100.0 AS r, max(CASE WHEN ceil({lwr}) = 50 THEN coral_cover END) AS threshold_lwr, "
            f"max(CASE WHEN ceil({med}) = 50 THEN coral_cover END) AS threshold, "
            f"max(CASE WHEN ceil({upr}) = 50 THEN coral_cover END) AS threshold_upr "
            f"FROM {cells} c, ({_rates_sql()}) rt GROUP BY k")


@query("ratio_sweep", review_with(
    "SELECT " + ", ".join(r(c, c) for c in ("r", "threshold_lwr", "threshold", "threshold_upr"))
    + f" FROM ({_sweep_sql()})"))
def ratio_sweep_q(spark, sf_dir):
    """ANA-9: thresholds for 400 rugosity ratios over the 4,000,400-cell sweep."""
    return rounded(ratio_sweep(spark, _mixture_rates(spark, sf_dir)))
