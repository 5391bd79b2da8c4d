"""Model frames and cell statistics (ANA-13, AGG-16, AGG-17).

The analysed study fitted a mixed model ``rate ~ climate + genus + (1 | method
family)`` per standardisation and loaded saved fits.  Fitting a sampler is
not a data operation; what is built here is the model input (three filtered
frames) and its sufficient cell statistics, plus a closed-form shrunken
method effect that approximates the random intercept (it is *not* the
posterior of the fitted model).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.predicates import not_in
from reefline.operators.joins import join_null_safe


def model_frames(growth: DataFrame) -> DataFrame:
    """Three model inputs tagged by ``dataset`` (FIL-2, FIL-4)."""
    part = F.col("standardization")
    biom = growth.where((part == fv.STANDARDIZATION_BIOMASS) & (F.col("method_family") != fv.VOLUME_FAMILY)
                        & not_in("paper_name", fv.PANEL_EXCLUDED_STUDIES) & not_in("genus", [fv.HALIMEDA]))
    ext = growth.where((part == fv.STANDARDIZATION_EXTENSION) & not_in("genus", [fv.HALIMEDA]))
    surf = growth.where((part == fv.STANDARDIZATION_SURFACE) & not_in("genus", [fv.HALIMEDA]))
    return (biom.withColumn("dataset", F.lit("Biomass"))
            .unionByName(ext.withColumn("dataset", F.lit("Extension")))
            .unionByName(surf.withColumn("dataset", F.lit("Surface"))))


def cell_statistics(frames: DataFrame, value: str = "rate_std",
                    keys=("dataset", "climate", "genus", "method_family")) -> DataFrame:
    """AGG-16: n, sum y, sum y^2 per model cell, with the equivalent mean and SD
    (algebraic aggregates: fully map-side combined).  Mean and SD are the
    well-conditioned form; the power sum's low digits depend on summation order."""
    y = F.col(value)
    return frames.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2"),
                                     F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("sd_y"))


def method_effect(frames: DataFrame, value: str = "rate_std", shrink: float = 1.0) -> DataFrame:
    """AGG-17: mean deviation of a method's rates from their (climate, genus) cell
    mean, shrunk by ``n / (n + shrink)``."""
    cells = frames.groupBy("dataset", "climate", "genus").agg(F.avg(value).alias("_cell_mean"))
    dev = join_null_safe(frames.where(F.col(value).isNotNull()), cells, ["dataset", "climate", "genus"])
    per = dev.groupBy("dataset", "method_family").agg(F.avg(F.col(value) - F.col("_cell_mean")).alias("_raw"),
                                                      F.count(F.lit(1)).alias("n"))
    return per.select("dataset", "method_family", "n",
                      (F.col("_raw") * F.col("n") / (F.col("n") + F.lit(float(shrink)))).alias("effect"))


def method_effect_estimated(frames: DataFrame, value: str = "rate_std", rounds: int = 50, dataset: str = "dataset",
                            method: str = "method_family", cell: Sequence[str] = ("climate", "genus")) -> DataFrame:
    """AGG-17 with the shrinkage estimated: ``(dataset, method_family, n, tau2, sigma2, effect)``.

    Deviations of rates from their cell mean follow ``d = b(method) + e`` with ``b ~ N(0, tau2)`` and
    ``e ~ N(0, sigma2)``; EM (a fixed number of rounds, started at equal variances) estimates both, and
    the effect is the mean of ``b`` given the data: the sum of deviations over ``n + sigma2 / tau2``.
    Everything comes from the cell statistics: n, mean and SD of each (cell, method), so rows are read
    once.  A dataset's methods, levels of a vocabulary, are gathered in one array for its rounds; a
    dataset whose deviations are all 0 has no effects (0)."""
    keys = [dataset, *cell]
    stats = cell_statistics(frames.where(F.col(value).isNotNull()), value, (*keys, method))
    whole = stats.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")).alias("_mean"))
    off = F.col("mean_y") - F.col("_mean")
    n = F.col("n").cast("double")
    dev = join_null_safe(stats, whole, keys).groupBy(dataset, method).agg(
        F.sum("n").alias("n"), F.sum(n * off).alias("s"), F.sum((n - 1) * F.coalesce("sd_y", F.lit(0.0)) ** 2 + n * off * off).alias("q"))
    levels = dev.groupBy(dataset).agg(F.collect_list(F.struct(F.col(method).alias("m"), F.col("n").cast("double").alias("n"), "s", "q")).alias("_l"),
                                      F.sum("n").cast("double").alias("_n"), F.sum("q").alias("_q"))
    count = F.size("_l").cast("double")

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + of(x))

    def em(state: Column, _: Column) -> Column:
        tau2, sigma2 = state["tau2"], state["sigma2"]

        def b(x: Column) -> Column:
            return x["s"] * tau2 / (x["n"] * tau2 + sigma2)

        def second(x: Column) -> Column:                 # mean of b squared, given the data
            return b(x) * b(x) + sigma2 * tau2 / (x["n"] * tau2 + sigma2)

        return F.struct((total(second) / count).alias("tau2"),
                        (total(lambda x: x["q"] - 2 * b(x) * x["s"] + x["n"] * second(x)) / F.col("_n")).alias("sigma2"))

    start = F.struct((F.col("_q") / F.col("_n")).alias("tau2"), (F.col("_q") / F.col("_n")).alias("sigma2"))
    none = F.struct(F.lit(0.0).alias("tau2"), F.lit(0.0).alias("sigma2"))
    fitted = levels.withColumn("_v", F.when(F.col("_q") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(int(rounds))), start, em)).otherwise(none))
    each = fitted.select(dataset, F.explode("_l").alias("x"), "_v.tau2", "_v.sigma2")
    spread = F.col("x.n") * F.col("tau2") + F.col("sigma2")
    return each.select(dataset, F.col("x.m").alias(method), F.col("x.n").cast("bigint").alias("n"), "tau2", "sigma2",
                       F.when(spread > 0, F.col("x.s") * F.col("tau2") / spread).otherwise(0.0).alias("effect"))
