"""Posterior-draw summaries (AGG-13 .. AGG-15, WIN-3, WIN-4, FUN-13, SRC-8).

Input is a long draws table ``keys + [chain, iteration, value]`` with
iterations ``1..N`` in every chain.  Definitions follow the published
convergence diagnostics (Vehtari, Gelman, Simpson, Carpenter, Buerkner 2021):

* split chains: first ``floor(N/2)`` iterations and the last ``floor(N/2)``
  (the middle one is dropped when N is odd), giving ``2M`` chains;
* basic R-hat: ``sqrt((n * var(chain means) / mean(chain vars) + n - 1) / n)``;
* rank-normalised R-hat: the larger of basic R-hat on normal scores of the
  average ranks ``qnorm((r - 3/8) / (S - 3/4 + 1))`` of the split chains, and the
  same on the folded draws ``|x - median|``: the median is that of all draws, and the
  folded draws are split afterwards;
* ESS: Geyer's initial positive then monotone sequence on the combined
  autocorrelations, ``ESS = M N / tau`` with ``tau >= 1 / log10(M N)``.

The diagnostics compare chains of one length: ``equal_length`` cuts the chains of
a parameter to its shortest one, as an explicit step.

Everything is spread over tasks: ranks come from ``ranking.value_positions``,
sums over chains from grouped aggregates, autocovariances from pairs of blocks of
fixed size (``autocovariance``), for as many lags as truncation needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.stats import with_qnorm
from reefline.operators import autocovariance as AC
from reefline.operators.joins import join_null_safe
from reefline.operators.ranking import value_positions
from reefline.operators.summaries import group_quantiles
from reefline.session import cut_lineage

KEYS = ("dataset", "parameter")


def draw_summary(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """AGG-13: mean, median, sd, mad (scaled by 1.4826), q5, q95 per parameter."""
    keys = list(keys)
    base = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    q = group_quantiles(draws, keys, value, [0.5, 0.05, 0.95], ["median", "q5", "q95"])
    dev = join_null_safe(draws.select(*keys, value), q.select(*keys, "median"), keys)
    dev = dev.select(*keys, F.abs(F.col(value) - F.col("median")).alias("_dev"))
    mad = group_quantiles(dev, keys, "_dev", [0.5], ["_mad"])
    out = join_null_safe(join_null_safe(base, q, keys), mad, keys)
    return out.select(*keys, "mean", "median", "sd", (F.col("_mad") * F.lit(fv.MAD_SCALE)).alias("mad"), "q5", "q95")


def equal_length(draws: DataFrame, keys: Sequence[str] = KEYS, chain: str = "chain", iteration: str = "iteration") -> DataFrame:
    """The first iterations of every chain, as many as the parameter's shortest chain has."""
    keys = list(keys)
    lengths = draws.groupBy(*keys, chain).agg(F.count(F.lit(1)).alias("_len")).groupBy(*keys).agg(F.min("_len").alias("_len"))
    return join_null_safe(draws, lengths, keys).where(F.col(iteration) <= F.col("_len")).drop("_len")


def split_chains(draws: DataFrame, keys: Sequence[str] = KEYS, chain: str = "chain",
                 iteration: str = "iteration") -> DataFrame:
    """WIN-4: each chain cut into halves -> ``split_chain`` (2c, 2c+1); an odd
    chain length drops its middle iteration.  Chain lengths come from a grouped
    count joined back (no window over a whole chain)."""
    keys = list(keys)
    lengths = draws.groupBy(*keys, chain).agg(F.count(F.lit(1)).alias("_len"))
    d = join_null_safe(draws, lengths, keys + [chain])
    half = F.floor(F.col("_len") / 2)
    first = F.col(iteration) <= half
    second = F.col(iteration) >= F.ceil(F.col("_len") / 2 + 1)
    d = d.where(first | second)
    return d.withColumn("split_chain", F.col(chain) * 2 + F.when(first, 0).otherwise(1)).drop("_len")


def rhat_basic(split: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
               chain: str = "split_chain", out: str = "rhat") -> DataFrame:
    """Basic (split) R-hat per parameter from per-chain means and variances."""
    keys = list(keys)
    per_chain = split.groupBy(*keys, chain).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"),
                                                F.var_samp(value).alias("v"))
    p = per_chain.groupBy(*keys).agg(F.min("n").cast("double").alias("n"), F.var_samp("m").alias("var_m"),
                                     F.avg("v").alias("w"))
    n = F.col("n")
    vb = n * F.col("var_m")
    return p.select(*keys, F.sqrt((vb / F.col("w") + n - 1) / n).alias(out))


def z_scale(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """WIN-3: normal scores of average ranks within each parameter (ties share ranks)."""
    keys = list(keys)
    pos = value_positions(df.select(*keys, value), keys, value)
    r = F.col("_lt") + (F.col("_cnt") + 1) / 2.0
    s = F.col("_n").cast("double")
    pos = with_qnorm(pos, (r - 0.375) / (s - 0.75 + 1), out).select(*keys, value, out)
    return join_null_safe(df, pos, keys + [value], "left")


def fold(df: DataFrame, keys: Sequence[str], value: str, out: str = "folded") -> DataFrame:
    """``|x - median(x)|`` per parameter."""
    keys = list(keys)
    med = group_quantiles(df, keys, value, [0.5], ["_med"])
    return join_null_safe(df, med, keys).withColumn(out, F.abs(F.col(value) - F.col("_med"))).drop("_med")


def rhat_split(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """AGG-14 (plain): basic R-hat on split chains."""
    return rhat_basic(split_chains(draws, keys), keys, value)


def rhat_rank(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """AGG-14: rank-normalised split R-hat = max(bulk, tail)."""
    keys = list(keys)
    bulk = rhat_basic(z_scale(split_chains(draws, keys), keys, value, "z"), keys, "z", out="rhat_bulk")
    return _larger_rhat(bulk, draws, keys, value)


def _larger_rhat(bulk: DataFrame, draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    folded = split_chains(fold(draws, keys, value), keys)
    tail = rhat_basic(z_scale(folded, keys, "folded", "zf"), keys, "zf", out="rhat_tail")
    return join_null_safe(bulk, tail, keys).select(*keys, F.greatest("rhat_bulk", "rhat_tail").alias("rhat"))


# --- effective sample size ------------------------------------------------------

def ess_of(split: DataFrame, keys: Sequence[str], value: str, out: str = "ess", chain: str = "split_chain",
           iteration: str = "iteration", first_lags: int = AC.FIRST_LAGS, block: int = AC.BLOCK) -> DataFrame:
    """ESS of each parameter from its split chains (all of one length).

    The biased autocovariances (1/N) of the chains are averaged by lag.  Parameters that ``first_lags``
    lags do not decide are taken again with the lags of neighbouring blocks, and then with twice as many
    block distances, up to the chain length; block distances that are summed already are kept."""
    keys = list(keys)
    x = split.select(*keys, chain, iteration, F.col(value).cast("double").alias("_x"))
    blocks = AC.in_blocks(x, keys + [chain], iteration, "_x", block)
    chains = cut_lineage(blocks.groupBy(*keys, chain).agg(F.sum("_len").alias("_n"), (F.sum("_sum") / F.sum("_len")).alias("_mean")))
    blocks = join_null_safe(blocks, chains.drop("_n"), keys + [chain])
    stats = cut_lineage(chains.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("_n").alias("n"), F.var_samp("_mean").alias("var_cm")))

    reach, complete, done = 0, min(first_lags, block), None
    sums = cut_lineage(AC.pair_sums(blocks, keys, chain, 0, 1, block, below=complete))
    while True:
        found = cut_lineage(_decided(sums, stats, keys, complete, out))
        ready = found.where(~F.col("_more")).select(*keys, out)
        done = ready if done is None else done.unionByName(ready)
        left = found.where("_more").select(*keys)
        if not left.take(1):
            return done
        blocks, stats = (join_null_safe(d, left, keys, "left_semi") for d in (blocks, stats))
        more = AC.pair_sums(blocks, keys, chain, reach + 1 if reach else 0, max(2 * reach, 1), block)
        if reach:
            more = more.unionByName(join_null_safe(sums, left, keys, "left_semi"))
        reach = max(2 * reach, 1)
        sums, complete = cut_lineage(more.groupBy(*keys, "lag").agg(F.sum("s").alias("s"))), reach * block


def _decided(sums: DataFrame, stats: DataFrame, keys: list[str], complete: int, out: str) -> DataFrame:
    """``keys + [out, _more]`` from the lag sums below ``complete``; ``_more`` marks parameters that need more lags."""
    zero = sums.where(F.col("lag") == 0).select(*keys, F.col("s").alias("_s0"))
    within = F.col("_s0") / (F.col("m") * F.greatest(F.col("n") - 1, F.lit(1)))
    between = F.when((F.col("m") > 1) & ~F.isnan("var_cm"), F.col("var_cm"))
    base = join_null_safe(stats, zero, keys, "left").withColumns({"_within": within, "_total": within * (F.col("n") - 1) / F.col("n") + F.coalesce(between, F.lit(0.0))})
    usable = (F.col("n") >= 3) & (F.col("_total") > 0) & ~F.isnan("_total")
    rows = join_null_safe(sums, base.where(usable), keys).where(F.col("lag") < F.least(F.lit(complete), F.col("n")))
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("_within") - F.col("s") / (F.col("m") * F.col("n"))) / F.col("_total"))
    tau = AC.truncated_tau(rows.select(*keys, "n", "lag", rho.alias("rho")), keys)
    draws = (F.col("m") * F.col("n")).cast("double")
    ess = F.when(usable, draws / F.greatest(F.col("tau"), 1 / F.log10(F.greatest(draws, F.lit(2.0))))).otherwise(F.lit(float("nan")))
    known = join_null_safe(base, tau, keys, "left")
    return known.select(*keys, ess.alias(out), (F.coalesce(usable, F.lit(False)) & F.col("tau").isNull()).alias("_more"))


def ess_many(split: DataFrame, keys: Sequence[str], series: dict[str, F.Column]) -> DataFrame:
    """ESS of several series of the same split chains in one pass: the series are
    stacked as an extra key, so one per-chain and one per-parameter Python stage
    serve all of them.  Returns ``keys`` + one column per series name."""
    keys = list(keys)
    packed = F.array(*[F.struct(F.lit(n).alias("_series"), e.cast("double").alias("_x")) for n, e in series.items()])
    stacked = split.select(*keys, "split_chain", "iteration", F.explode(packed).alias("_s")).select(
        *keys, "split_chain", "iteration", "_s._series", "_s._x")
    ess = ess_of(stacked, keys + ["_series"], "_x", "_ess")
    return ess.groupBy(*keys).agg(*[F.max(F.when(F.col("_series") == n, F.col("_ess"))).alias(n) for n in series])


def _tail_quantiles(draws: DataFrame, keys: list[str], value: str, probs: Sequence[float]):
    names = [f"_q{i}" for i in range(len(probs))]
    return group_quantiles(draws, keys, value, list(probs), names), names


def ess_bulk(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """AGG-15: bulk ESS = ESS of the normal scores of the split chains."""
    split = z_scale(split_chains(draws, keys), keys, value, "z")
    return ess_of(split, keys, "z", "ess_bulk")


def ess_tail(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
             probs: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """AGG-15: tail ESS = min over the 5 % and 95 % quantile indicators."""
    keys = list(keys)
    q, names = _tail_quantiles(draws, keys, value, probs)
    d = split_chains(join_null_safe(draws, q, keys), keys)
    e = ess_many(d, keys, {f"_e{i}": F.col(value) <= F.col(n) for i, n in enumerate(names)})
    return e.select(*keys, F.least(*[F.col(f"_e{i}") for i in range(len(names))]).alias("ess_tail"))


def summarise_draws(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Summary of all draws and convergence of chains of equal length, per parameter (the default measure set)."""
    keys = list(keys)
    draws = cut_lineage(draws)
    summary = cut_lineage(draw_summary(draws, keys, value))
    even = cut_lineage(equal_length(draws, keys))
    # split chains and their normal scores are shared by R-hat (bulk) and all ESS
    q, names = _tail_quantiles(even, keys, value, (0.05, 0.95))
    z = cut_lineage(z_scale(split_chains(join_null_safe(even, q, keys), keys), keys, value, "z"))
    rhat = _larger_rhat(rhat_basic(z, keys, "z", out="rhat_bulk"), even, keys, value)
    ess = ess_many(z, keys, {"ess_bulk": F.col("z"), "_e0": F.col(value) <= F.col(names[0]),
                             "_e1": F.col(value) <= F.col(names[1])})
    ess = ess.select(*keys, "ess_bulk", F.least("_e0", "_e1").alias("ess_tail"))
    for extra in (rhat, ess):
        summary = join_null_safe(summary, extra, keys)
    return cut_lineage(summary)


def parse_parameter(df: DataFrame, name_col: str = "name", variable: str = "variable",
                    condition: str = "condition") -> DataFrame:
    """FUN-13: ``r_Group[condition,term]`` -> variable ``r_Group`` and ``condition``."""
    return df.withColumns({
        variable: F.regexp_extract(F.col(name_col), r"^([^\[]+)", 1),
        condition: F.regexp_extract(F.col(name_col), r"\[([^,\]]+)", 1)})


def wide_to_long(wide: DataFrame, id_cols: Sequence[str], value: str = "value", name_col: str = "name") -> DataFrame:
    """Unpivot every non-id column (one per parameter) into (name, value) rows."""
    cols = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(list(id_cols), [F.col(f"`{c}`") for c in cols], name_col, value)


def long_to_wide(long: DataFrame, id_cols: Sequence[str], name_col: str = "name", value: str = "value") -> DataFrame:
    """One column per parameter found in ``name_col`` (the names become the schema, so they are read first)."""
    return long.groupBy(*id_cols).pivot(name_col).agg(F.first(value))


def normal_from_hash(seed: int, *cols: F.Column) -> F.Column:
    """Standard normal value determined by the row's identity (Box-Muller on two
    numbers of 13 hex digits from an MD5 of seed and columns).  Unlike a generator seeded
    per partition, recomputing a lost partition gives the same values, whatever the row order."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    u1, u2 = ((F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52) for at in (1, 14))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)


def expand_normal(summary: DataFrame, n: int, keep: Sequence[str], mean: str = "mean", sd: str = "sd",
                  out: str = "random_effect", seed: int = 42, piece: int = 1000) -> DataFrame:
    """SRC-8: ``n`` normal draws per summary row, ``mean + sd * z``.

    Each row is exploded into pieces of draw numbers, which are dealt out over all tasks before they are
    exploded further (no join); ``z`` is a function of (seed, row keys, draw number), so the
    result is reproducible and survives recomputation after executor loss.
    """
    keep = list(keep)
    pieces = summary.select(*keep, mean, sd, F.explode(F.sequence(F.lit(0), F.lit((int(n) - 1) // piece))).alias("_piece")) \
        .repartition(*keep, "_piece")
    numbers = F.sequence(F.col("_piece") * piece + 1, F.least(F.lit(int(n)), (F.col("_piece") + 1) * piece))
    base = pieces.select(*keep, mean, sd, F.explode(numbers).alias("draw"))
    z = normal_from_hash(seed, *[F.col(k) for k in keep], F.col("draw"))
    return base.withColumn(out, F.col(mean) + F.col(sd) * z).drop(mean, sd)
