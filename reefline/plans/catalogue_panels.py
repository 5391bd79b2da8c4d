"""Registered queries: model frames, review panels, parts and figure sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.operators import model as MD
from reefline.operators import panels as PN
from reefline.plans.catalogue_summaries import QUANTILE_SUMMARY_SQL, _growth, quantile_summary
from reefline.plans.registry import query, r, round_fixed, round_sig, rounded, rs
from reefline.plans.review_sql import in_set, review_with
from reefline.sinks import part_numbers, write_figure_data
from reefline.sqltext import sql_str

_NOT_HAL = f"NOT {in_set('genus', [fv.HALIMEDA])}"
_FRAMES = (f"frames AS (SELECT *, 'Biomass' AS dataset FROM growth WHERE standardization = {sql_str(fv.STANDARDIZATION_BIOMASS)} "
           f"AND method_family <> {sql_str(fv.VOLUME_FAMILY)} AND NOT {in_set('paper_name', fv.PANEL_EXCLUDED_STUDIES)} "
           f"AND {_NOT_HAL} UNION ALL SELECT *, 'Extension' FROM growth WHERE standardization = "
           f"{sql_str(fv.STANDARDIZATION_EXTENSION)} AND {_NOT_HAL} UNION ALL SELECT *, 'Surface' FROM growth WHERE "
           f"standardization = {sql_str(fv.STANDARDIZATION_SURFACE)} AND {_NOT_HAL})")


def _with_frames(body: str) -> str:
    return review_with("__BODY__").replace("\n__BODY__", f",\n{_FRAMES}\n{body}")


@query("model_frames", _with_frames(
    "SELECT dataset, count(*) AS n, count(DISTINCT paper_name) AS n_studies, " + r("avg(rate_std)", "mean_rate")
    + " FROM frames GROUP BY dataset"))
def model_frames(spark, sf_dir):
    """ANA-13: the three model inputs (rows, studies and mean rate per dataset)."""
    f = MD.model_frames(_growth(spark, sf_dir))
    return rounded(f.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_distinct("paper_name").alias("n_studies"),
                                            F.avg("rate_std").alias("mean_rate")))


@query("cell_statistics", _with_frames(
    "SELECT dataset, climate, genus, method_family, count(rate_std) AS n, " + rs("sum(rate_std)", "sum_y", 9) + ", "
    + r("avg(rate_std)", "mean_y") + ", " + r("stddev_samp(rate_std)", "sd_y") + ", " + rs("sum(rate_std * rate_std)", "sum_y2", 9)
    + " FROM frames GROUP BY dataset, climate, genus, method_family"))
def cell_statistics(spark, sf_dir):
    """AGG-16: n, sum, sum of squares, mean and SD of the rate per (dataset, climate, genus, method family)."""
    cells = MD.cell_statistics(MD.model_frames(_growth(spark, sf_dir)))
    doubles = [round_fixed(F.col(c)).alias(c) for c in ("mean_y", "sd_y")]
    doubles += [round_sig(F.col(c), 9).alias(c) for c in ("sum_y", "sum_y2")]
    return cells.select("dataset", "climate", "genus", "method_family", "n", *doubles)


@query("method_effect", _with_frames(
    "SELECT dataset, method_family, n, " + r("raw * n / (n + 1.0)", "effect") + " FROM ("
    "SELECT f.dataset, f.method_family, avg(f.rate_std - c.cm) AS raw, count(*) AS n FROM frames f JOIN "
    "(SELECT dataset, climate, genus, avg(rate_std) AS cm FROM frames GROUP BY dataset, climate, genus) c "
    "ON f.dataset = c.dataset AND f.climate IS NOT DISTINCT FROM c.climate AND f.genus IS NOT DISTINCT FROM c.genus "
    "WHERE f.rate_std IS NOT NULL GROUP BY f.dataset, f.method_family)"))
def method_effect(spark, sf_dir):
    """AGG-17: shrunken mean deviation of each method from its (climate, genus) cell."""
    return rounded(MD.method_effect(MD.model_frames(_growth(spark, sf_dir))))


EM_ROUNDS = 50
_NULL_SAFE = " AND ".join(f"f.{c} IS NOT DISTINCT FROM w.{c}" for c in ("dataset", "climate", "genus"))
_EM_SQL = f"""SELECT d.dataset, d.method_family, d.n::BIGINT AS n, {rs("tau2", "tau2", 9)}, {rs("sigma2", "sigma2", 9)},
{r("CASE WHEN d.n * tau2 + sigma2 > 0 THEN s * tau2 / (d.n * tau2 + sigma2) ELSE 0 END", "effect")} FROM (
WITH RECURSIVE of_cell AS (
  SELECT dataset, climate, genus, method_family, count(*) AS n, avg(rate_std) AS m, coalesce(stddev_samp(rate_std), 0) AS sd
  FROM frames WHERE rate_std IS NOT NULL GROUP BY ALL),
whole AS (SELECT dataset, climate, genus, sum(n * m) / sum(n) AS cm FROM of_cell GROUP BY ALL),
dev AS (SELECT f.dataset, f.method_family, sum(n)::DOUBLE AS n, sum(n * (m - cm)) AS s, sum((n - 1) * sd * sd + n * (m - cm) * (m - cm)) AS q
        FROM of_cell f JOIN whole w ON {_NULL_SAFE} GROUP BY ALL),
em AS (
  SELECT dataset, 0 AS round, sum(q) / sum(n) AS tau2, sum(q) / sum(n) AS sigma2 FROM dev GROUP BY dataset
  UNION ALL
  SELECT dataset, round + 1, avg(b * b + v), sum(q - 2 * b * s + n * (b * b + v)) / sum(n) FROM (
    SELECT e.dataset, round, n, s, q, s * tau2 / (n * tau2 + sigma2) AS b, sigma2 * tau2 / (n * tau2 + sigma2) AS v
    FROM em e JOIN dev d ON e.dataset = d.dataset WHERE round < {EM_ROUNDS}) GROUP BY dataset, round)
SELECT dev.*, tau2, sigma2 FROM dev JOIN em ON em.dataset = dev.dataset AND round = {EM_ROUNDS}) d"""


@query("method_effect_estimated", _with_frames(_EM_SQL))
def method_effect_estimated(spark, sf_dir):
    """AGG-17: method effects whose shrinkage, the ratio of two variances, is estimated by EM from the cell statistics."""
    frames = MD.model_frames(_growth(spark, sf_dir))
    out = MD.method_effect_estimated(frames, rounds=EM_ROUNDS)
    return out.select("dataset", "method_family", "n", *[round_sig(F.col(c), 9).alias(c) for c in ("tau2", "sigma2")], round_fixed(F.col("effect")).alias("effect"))


def _panels_sql() -> str:
    std = "standardization"
    studies = f"NOT {in_set('paper_name', fv.PANEL_EXCLUDED_STUDIES)}"
    hal_ne = f"genus <> {sql_str(fv.HALIMEDA)}"
    art, not_art = in_set("genus", fv.ARTICULATE_GENERA), f"NOT {in_set('genus', fv.ARTICULATE_GENERA)}"
    rules = [
        (1, fv.STANDARDIZATION_BIOMASS, f"{studies} AND {hal_ne} AND {not_art}", 1.0, (0.0, 30.0)),
        (2, fv.STANDARDIZATION_BIOMASS, f"{studies} AND {hal_ne} AND {art}", 1.0, None),
        (3, fv.STANDARDIZATION_BIOMASS, f"{studies} AND genus = {sql_str(fv.HALIMEDA)}", 1.0, None),
        (4, fv.STANDARDIZATION_EXTENSION, f"{_NOT_HAL} AND {not_art}", 1.0, None),
        (5, fv.STANDARDIZATION_EXTENSION, f"{_NOT_HAL} AND {art}", 1.0, None),
        (6, fv.STANDARDIZATION_SURFACE, f"{_NOT_HAL} AND {not_art}", 0.36525, (0.0, 1.2)),
        (7, fv.STANDARDIZATION_SURFACE, f"{_NOT_HAL} AND {art}", 0.36525, (0.0, 1.2)),
        (8, fv.STANDARDIZATION_SURFACE, f"genus = {sql_str(fv.HALIMEDA)}", 0.36525, (0.0, 1.2)),
    ]
    crank = "CASE climate " + " ".join(f"WHEN {sql_str(c)} THEN {i + 1}" for i, c in enumerate(fv.PANEL_CLIMATE_ORDER)) + " END"
    mrank = "CASE method_family " + " ".join(f"WHEN {sql_str(c)} THEN {i + 1}" for i, c in enumerate(fv.PANEL_METHOD_ORDER)) + " END"
    parts = []
    for pid, part, keep, scale, lim in rules:
        y = "rate_std" if scale == 1.0 else f"rate_std * {scale}"
        e = "std_error" if scale == 1.0 else f"std_error * {scale}"
        exprs = {"y": y, "ymin": f"{y} - {e}", "ymax": f"{y} + {e}"}
        if lim:
            exprs = {k: f"CASE WHEN ({v}) BETWEEN {lim[0]} AND {lim[1]} AND NOT isnan({v}) THEN {v} END"
                     for k, v in exprs.items()}
        parts.append(f"SELECT {pid} AS panel, paper_name, genus, method_family, climate, "
                     + ", ".join(r(v, k) for k, v in exprs.items())
                     + f", {crank} AS climate_rank, {mrank} AS method_rank FROM growth WHERE {std} = {sql_str(part)} AND {keep}")
    return " UNION ALL ".join(parts)


@query("review_panels", review_with(_panels_sql()))
def review_panels(spark, sf_dir):
    """ANA-12: the eight review panels with error bounds, censored to axis limits."""
    return rounded(PN.review_panels(_growth(spark, sf_dir)))


@query("split_parts", review_with(
    "SELECT dense_rank() OVER (ORDER BY standardization) AS part, standardization, n, n_studies FROM ("
    "SELECT standardization, count(*) AS n, count(DISTINCT paper_name) AS n_studies FROM growth GROUP BY standardization)"))
def split_parts(spark, sf_dir):
    """SNK-2 / SRT-2: parts numbered in sorted key order, sized."""
    g = part_numbers(_growth(spark, sf_dir), "standardization")
    return g.groupBy("part", "standardization").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("paper_name").alias("n_studies")).select(
        F.col("part").cast("bigint").alias("part"), "standardization", "n", "n_studies")


@query("figure_sink", QUANTILE_SUMMARY_SQL)
def figure_sink(spark, sf_dir):
    """SNK-1: the quantile-summary figure data written to the shared output folder and read back."""
    path = write_figure_data(quantile_summary(spark, sf_dir), "quantile_summary")
    return spark.read.parquet(path)
