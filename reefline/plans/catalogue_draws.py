"""Registered queries for job 4: posterior-draw summaries and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.stats import qnorm_sql
from reefline.functions.text import chartr
from reefline.operators import draws as D
from reefline.operators.joins import complete, join_null_safe
from reefline.plans import effects as EF
from reefline.plans.registry import query, r, rounded
from reefline.plans.sql_helpers import quantiles_sql
from reefline.session import cut_lineage
from reefline.sources import bindings as B


def _draws(spark, sf_dir):
    """The draws binding, materialised once: every summary reads it several times."""
    return cut_lineage(B.draws(spark, sf_dir))


def _equal(spark, sf_dir):
    return cut_lineage(D.equal_length(_draws(spark, sf_dir)))


K = ["dataset", "parameter"]
_DRAWS = "WITH draws AS (" + B.draws_sql() + ")\n"
_DRAWS_C = "WITH draws AS (" + B.draws_sql() + "),\n"


def _summary_sql() -> str:
    q = quantiles_sql("draws", K, "value", [0.5, 0.05, 0.95], ["median", "q5", "q95"])
    dev = ("(SELECT d.dataset, d.parameter, abs(d.value - q.median) AS dev FROM draws d JOIN (" + q
           + ") q ON d.dataset = q.dataset AND d.parameter = q.parameter)")
    mad = quantiles_sql(dev, K, "dev", [0.5], ["mad_raw"])
    return ("SELECT b.dataset, b.parameter, b.mean, q.median, b.sd, m.mad_raw * " + repr(fv.MAD_SCALE)
            + " AS mad, q.q5, q.q95 FROM (SELECT dataset, parameter, avg(value) AS mean, stddev_samp(value) AS sd "
            "FROM draws GROUP BY dataset, parameter) b JOIN (" + q + ") q USING (dataset, parameter) JOIN (" + mad
            + ") m USING (dataset, parameter)")


STATS = ["mean", "median", "sd", "mad", "q5", "q95"]


@query("draw_summary", _DRAWS + "SELECT dataset, parameter, " + ", ".join(r(c, c) for c in STATS)
       + " FROM (" + _summary_sql() + ")")
def draw_summary(spark, sf_dir):
    """AGG-13: mean, median, sd, mad, q5, q95 per parameter."""
    return rounded(D.draw_summary(_draws(spark, sf_dir)))


# Diagnostics compare chains of one length: the first iterations, as many as the parameter's shortest chain has.
_EQUAL = ("equal AS (SELECT * FROM (SELECT *, min(len) OVER (PARTITION BY dataset, parameter) AS half2 FROM (SELECT *, "
          "count(*) OVER (PARTITION BY dataset, parameter, chain) AS len FROM draws)) WHERE iteration <= half2)")


def _split_sql(src: str, out: str) -> str:
    return (f"{out} AS (SELECT * EXCLUDE (half2), chain * 2 + CASE WHEN iteration <= floor(half2 / 2) THEN 0 ELSE 1 END AS split_chain "
            f"FROM {src} WHERE iteration <= floor(half2 / 2) OR iteration >= ceil(half2 / 2 + 1))")


_SPLIT = _EQUAL + ", " + _split_sql("equal", "split")


def _rhat_sql(src: str, col: str, out: str) -> str:
    return (f"SELECT dataset, parameter, sqrt((n * var_m / w + n - 1) / n) AS {out} FROM ("
            f"SELECT dataset, parameter, CAST(min(n) AS DOUBLE) AS n, var_samp(m) AS var_m, avg(v) AS w FROM ("
            f"SELECT dataset, parameter, split_chain, count(*) AS n, avg({col}) AS m, var_samp({col}) AS v FROM {src} "
            f"GROUP BY dataset, parameter, split_chain) GROUP BY dataset, parameter)")


def _z_sql(src: str, col: str, out: str) -> str:
    rk = (f"(rank() OVER (PARTITION BY dataset, parameter ORDER BY {col}) + "
          f"(count(*) OVER (PARTITION BY dataset, parameter, {col}) - 1) / 2.0)")
    s = "CAST(count(*) OVER (PARTITION BY dataset, parameter) AS DOUBLE)"
    return f"(SELECT *, {qnorm_sql(f'({rk} - 0.375) / ({s} - 0.75 + 1)')} AS {out} FROM {src})"


@query("rhat_split", _DRAWS_C + _SPLIT + " SELECT dataset, parameter, "
       + r("rhat", "rhat") + " FROM (" + _rhat_sql("split", "value", "rhat") + ")")
def rhat_split(spark, sf_dir):
    """AGG-14 (plain): basic R-hat on split chains."""
    return rounded(D.rhat_split(_equal(spark, sf_dir)))


# Folded around the median of all draws first, split afterwards.
_FOLD = ("whole_folded AS (SELECT e.*, abs(e.value - m.med) AS folded FROM equal e JOIN ("
         + quantiles_sql("equal", K, "value", [0.5], ["med"]) + ") m USING (dataset, parameter)), " + _split_sql("whole_folded", "folded"))


_RHAT_RANK = ("SELECT dataset, parameter, greatest(b.rhat_bulk, t.rhat_tail) AS rhat FROM (" + _rhat_sql(_z_sql("split", "value", "z"), "z", "rhat_bulk")
              + ") b JOIN (" + _rhat_sql(_z_sql("folded", "folded", "zf"), "zf", "rhat_tail") + ") t USING (dataset, parameter)")


@query("rhat_rank", _DRAWS_C + _SPLIT + ", " + _FOLD + " SELECT dataset, parameter, " + r("rhat", "rhat") + f" FROM ({_RHAT_RANK})")
def rhat_rank(spark, sf_dir):
    """AGG-14: rank-normalised split R-hat (max of bulk and folded-tail)."""
    return rounded(D.rhat_rank(_equal(spark, sf_dir)))


def _ess_ctes() -> str:
    """Direct lag sums, then the truncation by window functions; ``ess`` has one row per (dataset, parameter, series)."""
    of = "dataset, parameter, series"
    tail = quantiles_sql("equal", K, "value", [0.05, 0.95], ["low", "high"])
    return f"""series AS (
  SELECT dataset, parameter, 'bulk' AS series, split_chain, iteration, z AS x FROM {_z_sql("split", "value", "z")}
  UNION ALL SELECT s.dataset, s.parameter, 'low', split_chain, iteration, CAST(s.value <= q.low AS INTEGER) FROM split s JOIN ({tail}) q USING (dataset, parameter)
  UNION ALL SELECT s.dataset, s.parameter, 'high', split_chain, iteration, CAST(s.value <= q.high AS INTEGER) FROM split s JOIN ({tail}) q USING (dataset, parameter)),
centred AS (
  SELECT {of}, split_chain, x - avg(x) OVER w AS y, avg(x) OVER w AS chain_mean, count(*) OVER w AS n,
         row_number() OVER (PARTITION BY {of}, split_chain ORDER BY iteration) AS pos
  FROM series WINDOW w AS (PARTITION BY {of}, split_chain)),
sizes AS (SELECT {of}, count(*) AS m, min(n) AS n, coalesce(var_samp(chain_mean), 0) AS between_chains
          FROM (SELECT {of}, split_chain, any_value(chain_mean) AS chain_mean, any_value(n) AS n FROM centred GROUP BY ALL) GROUP BY ALL),
lags AS (SELECT a.dataset, a.parameter, a.series, b.pos - a.pos AS lag, sum(a.y * b.y) AS s FROM centred a JOIN centred b
         ON a.dataset = b.dataset AND a.parameter = b.parameter AND a.series = b.series AND a.split_chain = b.split_chain AND b.pos >= a.pos GROUP BY ALL),
acov AS (SELECT l.*, z.m, z.n, s / (m * n) AS c, max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY {of}) / (m * (n - 1.0)) AS within, between_chains
         FROM lags l JOIN sizes z USING ({of})),
rho AS (SELECT {of}, m, n, lag, CASE WHEN lag = 0 THEN 1 ELSE 1 - (within - c) / (within * (n - 1) / n + between_chains) END AS rho FROM acov),
pairs AS (SELECT {of}, m, n, lag // 2 AS k, sum(rho) AS p, max(CASE WHEN lag % 2 = 0 THEN rho END) AS even FROM rho GROUP BY ALL),
low AS (SELECT *, min(p) OVER (PARTITION BY {of} ORDER BY k) AS lowest FROM pairs),
cuts AS (SELECT {of}, least(greatest(0, ceil((any_value(n) - 5) / 2.0)), coalesce(min(k) FILTER (NOT p > 0), 1e18)) AS cut FROM low GROUP BY ALL),
taus AS (SELECT {of}, any_value(m) * any_value(n) AS total, -1 + 2 * coalesce(sum(lowest) FILTER (k < cut), 0)
                + coalesce(max(CASE WHEN k = cut AND (even > 0 OR p >= 0) THEN even END), 0) AS tau FROM low JOIN cuts USING ({of}) GROUP BY ALL),
ess AS (SELECT {of}, total / greatest(tau, 1 / log10(total)) AS ess FROM taus),
both_ess AS (SELECT dataset, parameter, max(ess) FILTER (series = 'bulk') AS ess_bulk, min(ess) FILTER (series <> 'bulk') AS ess_tail
             FROM ess GROUP BY dataset, parameter)"""


@query("draw_ess", _DRAWS_C + _SPLIT + ", " + _ess_ctes() + " SELECT dataset, parameter, " + r("ess_bulk", "ess_bulk", 3) + ", "
       + r("ess_tail", "ess_tail", 3) + " FROM both_ess")
def draw_ess(spark, sf_dir):
    """AGG-15: bulk and tail effective sample sizes (blocked autocovariances)."""
    d = _equal(spark, sf_dir)
    return rounded(join_null_safe(D.ess_bulk(d), D.ess_tail(d), K), 3)


def _wide(spark, sf_dir):
    d = _draws(spark, sf_dir)
    name = F.concat(F.lit("r_Method_family["), F.col("parameter"), F.lit(".events,Intercept]"))
    return D.long_to_wide(d.withColumn("name", name), ["chain", "iteration"])


@query("param_long", _DRAWS + "SELECT chain, iteration, 'r_Method_family[' || parameter || '.events,Intercept]' AS name, "
       "'r_Method_family' AS variable, parameter || '.events' AS condition, parameter || ' events' AS methods, "
       + r("value", "value") + " FROM draws")
def param_long(spark, sf_dir):
    """FUN-13 / FUN-3: wide draws (one column per parameter) back to long, with the
    variable and condition parsed from the name and dots turned into spaces."""
    long = D.wide_to_long(_wide(spark, sf_dir), ["chain", "iteration"]).where(F.col("value").isNotNull())
    long = D.parse_parameter(long).withColumn("methods", chartr("condition", ".", " "))
    return rounded(long.select("chain", "iteration", "name", "variable", "condition", "methods", "value"))


@query("complete_pairs", _DRAWS + "SELECT a.dataset, b.parameter, " + ", ".join(r("s." + c, c) for c in STATS)
       + " FROM (SELECT DISTINCT dataset FROM draws) a CROSS JOIN (SELECT DISTINCT parameter FROM draws) b LEFT JOIN ("
       + _summary_sql() + ") s ON s.dataset = a.dataset AND s.parameter = b.parameter")
def complete_pairs(spark, sf_dir):
    """JOI-6: the draw summary completed to every (dataset, parameter) pair."""
    return rounded(complete(D.draw_summary(_draws(spark, sf_dir)), "dataset", "parameter"))


_EFFECTS = (", summary AS (" + _summary_sql() + "), rhats AS (" + _RHAT_RANK + "), known AS (SELECT *, replace(parameter, '.', ' ') AS methods "
            "FROM summary JOIN rhats USING (dataset, parameter) JOIN both_ess USING (dataset, parameter)) ")


@query("effect_summary", _DRAWS_C + _SPLIT + ", " + _FOLD + ", " + _ess_ctes() + _EFFECTS
       + "SELECT a.dataset, b.methods, 'r_Method_family' AS variable, coalesce(k.parameter, replace(b.methods, ' ', '.')) AS condition, "
       + ", ".join(r("k." + c, c, 4) for c in EF.SUMMARY_COLS) + ", " + r("k.mean - k.sd", "lwr", 4) + ", " + r("k.mean + k.sd", "upr", 4)
       + " FROM (SELECT DISTINCT dataset FROM known) a CROSS JOIN (SELECT DISTINCT methods FROM known) b "
         "LEFT JOIN known k ON k.dataset = a.dataset AND k.methods = b.methods")
def effect_summary(spark, sf_dir):
    """ANA-14: per-method summary with R-hat and ESS, filler rows and mean +/- sd."""
    return rounded(EF.effect_summary(_draws(spark, sf_dir)), 4)


EFFECT_DRAWS = 100_000


def _uniform_sql(at: int) -> str:
    return f"((('0x' || substr(h, {at}, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query("effect_samples", _DRAWS_C + "summary AS (" + _summary_sql() + "), hashed AS (SELECT s.dataset, s.parameter AS methods, s.mean, s.sd, "
       f"md5('42|' || s.dataset || '|' || s.parameter || '|' || d.draw) AS h FROM summary s, (SELECT range AS draw FROM range(1, {EFFECT_DRAWS + 1})) d) "
       "SELECT dataset, methods, " + r(f"mean + sd * (sqrt(-2.0 * ln({_uniform_sql(1)})) * cos(2 * pi() * {_uniform_sql(14)}))", "random_effect", 4)
       + " FROM hashed")
def effect_samples(spark, sf_dir):
    """ANA-15 / SRC-8: 100,000 normal draws per (dataset, method), completed, split by dataset, missing pairs dropped."""
    s = D.draw_summary(_draws(spark, sf_dir)).withColumn("methods", F.col("parameter"))
    samples = EF.effect_samples(s, EFFECT_DRAWS)
    parts = [EF.dataset_samples(samples, d) for d in ("Biomass", "Extension")]
    return rounded(parts[0].unionByName(parts[1]), 4)
