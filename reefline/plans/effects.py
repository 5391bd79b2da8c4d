"""Method-effect summary and samples (ANA-14, ANA-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.functions.text import chartr
from reefline.operators import draws as D
from reefline.operators.joins import complete

SUMMARY_COLS = ["mean", "median", "sd", "mad", "q5", "q95", "rhat", "ess_bulk", "ess_tail"]


def effect_summary(draws: DataFrame, variable: str = "r_Method_family") -> DataFrame:
    """ANA-14: per (dataset, method) draw summary with convergence, filler rows for
    methods missing from a dataset, and the ``mean +/- sd`` segment."""
    s = D.summarise_draws(draws)
    s = s.withColumns({"condition": F.col("parameter"), "variable": F.lit(variable),
                       "methods": chartr("parameter", ".", " ")}).drop("parameter")
    s = complete(s, "dataset", "methods", fill={"variable": variable})
    s = s.withColumn("condition", F.coalesce("condition", F.translate("methods", " ", ".")))
    return s.withColumns({"lwr": F.col("mean") - F.col("sd"), "upr": F.col("mean") + F.col("sd")})


def effect_samples(summary: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """ANA-15: ``n`` normal draws per (dataset, method) from the summary's mean and
    sd, completed to every (method, dataset) pair (missing pairs get NULL)."""
    base = summary.where(F.col("mean").isNotNull())
    samples = D.expand_normal(base, n, ["dataset", "methods"], seed=seed)
    return complete(samples.drop("draw"), "methods", "dataset")


def dataset_samples(samples: DataFrame, dataset: str) -> DataFrame:
    """The samples of one dataset, missing pairs dropped."""
    return samples.where((F.col("dataset") == dataset) & F.col("random_effect").isNotNull())
