"""Two-component mixture over a cover grid (ANA-7, ANA-8, ANA-9).

Component 1 (coral) covers ``c`` percent of the reef, component 2 (CCA) the
rest.  With rates ``q`` (already scaled) and a rugosity ratio ``r``:
``own = q_coral * r * c/100``, ``total = q_cca * (100-c)/100 + own`` and the
share is ``own / total * 100``.  The lower/upper bounds are *crossed* on
purpose: the lower coral share pairs the coral upper quartile with the CCA lower
one, and the CCA shares divide by the opposite bound's total.

Rates arrive as ``Column`` expressions - normally scalar subqueries over a
quantile aggregate - so the grid, the rates and the sweep are one lazy plan.
No join: a sweep has one row per ratio, and its thresholds are found by
bisection over the grid (14 evaluations instead of 10,001 cells); only ratios
whose order of shares is in doubt are exploded into cells and scanned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.numeric import ceil_double, safe_div


# Curve bound -> (bound of component 2, bound of component 1).  The pairing is crossed on purpose.
PAIRED = {"lwr": ("lwr", "upr"), "median": ("median", "median"), "upr": ("upr", "lwr")}
# Growth form of component 1: suffix of its curves, name of its share, prefix of component 2's share, rugosity ratio.
FORMS = (("", "coral", "g", 1.0), ("_b", "branching", "gb", fv.R_BRANCHING), ("_m", "massive", "gm", fv.R_MASSIVE))


# Shares are percentages of a few operations in doubles: their error is far below this.
NOISE = 1e-9


@dataclass(frozen=True)
class Rates:
    """Scaled rates of the two components by bound (``lwr``, ``median``, ``upr``: the three quartiles)."""
    cca: dict[str, Column]
    coral: dict[str, Column]


def _share(part: Column, total: Column) -> Column:
    return safe_div(part, total) * 100


def produced(q: Rates, bound: str, coral_cover: Column, ratio: Column) -> tuple[Column, Column]:
    """Production of component 1 and of both together, for one bound and ratio."""
    of_cca, of_coral = PAIRED[bound]
    own = q.coral[of_coral] * ratio * (coral_cover / 100)
    return own, q.cca[of_cca] * ((F.lit(100.0) - coral_cover) / 100) + own


def mixture_columns(cca_cover: Column, coral_cover: Column, q: Rates) -> dict[str, Column]:
    """All curves and percent shares at one grid point, by column name."""
    out: dict[str, Column] = {}
    for bound, (_, crossed) in PAIRED.items():
        out[f"{bound}_ccca"] = q.cca[crossed] * (cca_cover / 100)
    for suffix, name, prefix, ratio in FORMS:
        for bound in PAIRED:
            own, total = produced(q, bound, coral_cover, F.lit(ratio))
            out[f"{bound}_ccoral{suffix}"], out[f"{bound}{suffix}"] = own, total
        for bound, (_, crossed) in PAIRED.items():
            tail = "" if bound == "median" else f"_{bound}"
            out[f"g_percent_{name}{tail}"] = _share(out[f"{bound}_ccoral{suffix}"], out[f"{bound}{suffix}"])
            out[f"{prefix}_percent_cca{tail}"] = _share(out[f"{bound}_ccca"], out[f"{crossed}{suffix}"])
    return out


def mixture_curves(grid: DataFrame, q: Rates, columns: list[str] | None = None) -> DataFrame:
    """ANA-7: the curves and shares for every grid point (``cca_cover``, ``coral_cover``)."""
    cols = mixture_columns(F.col("cca_cover"), F.col("coral_cover"), q)
    keep = columns or list(cols)
    return grid.select("cca_cover", "coral_cover", *[cols[k].alias(k) for k in keep])


def first_cover_at(share: Column, cover: Column, target: float = 50.0) -> Column:
    """AGG-12: the first grid point, in descending cover order, whose share rounded
    up is ``target`` - i.e. the largest such cover; NULL if none."""
    return F.max(F.when(ceil_double(share) == F.lit(target), cover))


def crossover_thresholds(grid: DataFrame, q: Rates) -> DataFrame:
    """ANA-8: flat, massive and branching coral-cover thresholds (one row)."""
    cols = mixture_columns(F.col("cca_cover"), F.col("coral_cover"), q)
    cover = F.col("coral_cover")
    return grid.agg(first_cover_at(cols["g_percent_coral"], cover).alias("flat_threshold"),
                    first_cover_at(cols["g_percent_massive"], cover).alias("massive_threshold"),
                    first_cover_at(cols["g_percent_branching"], cover).alias("branching_threshold"))


def _cover(j: Column, cover_step: float) -> Column:
    """Coral cover at grid point ``j`` of a grid that falls from 100."""
    return F.lit(100.0) - j * F.lit(cover_step)


def _bisected(share: Callable[[Column], Column], n_grid: int, target: float) -> Column:
    """First grid point (from 0) whose share is at most ``target``, ``n_grid`` if none, for shares that fall along the grid.

    ceil(log2(n_grid + 1)) evaluations of the share, in one higher-order aggregate."""
    rounds = math.ceil(math.log2(n_grid + 1))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["above"] + s["at"]) / 2)
        reached, open_ = share(mid) <= target, s["at"] - s["above"] > 1
        return F.struct(F.when(open_ & ~F.coalesce(reached, F.lit(False)), mid).otherwise(s["above"]).alias("above"),
                        F.when(open_ & F.coalesce(reached, F.lit(False)), mid).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(-1).cast("bigint").alias("above"), F.lit(n_grid).cast("bigint").alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["at"]


def ratio_sweep(spark: SparkSession, q: Rates, n_ratios: int = 400, ratio_step: float = 0.01,
                cover_step: float = 0.01, num_partitions: int | None = None, target: float = 50.0) -> DataFrame:
    """ANA-9: thresholds (lower, median, upper) for ratios ``r = k * step``, k = 1..n.

    With positive rates the share grows with the cover, so the threshold is found by bisection over the
    grid.  The share is computed in doubles: a ratio whose shares beside the threshold come so near to a whole
    percentage that their order could be one of rounding is scanned instead, as is every ratio
    if a rate is zero, negative or missing.  Both ways evaluate the same expression at the same grid points."""
    n_grid = int(round(100 / cover_step)) + 1
    rates = {f"{part}_{b}": c for part, of in (("cca", q.cca), ("coral", q.coral)) for b, c in of.items()}
    ratios = spark.range(1, n_ratios + 1, numPartitions=num_partitions).select(F.col("id").cast("int").alias("k")) \
        .withColumns({"ratio": F.col("k") / F.lit(1 / ratio_step), **rates})
    held = Rates(cca={b: F.col(f"cca_{b}") for b in q.cca}, coral={b: F.col(f"coral_{b}") for b in q.coral})
    names = {"lwr": "threshold_lwr", "median": "threshold", "upr": "threshold_upr"}

    def share(bound: str, cover: Column) -> Column:
        return _share(*produced(held, bound, cover, F.col("ratio")))

    found = ratios.withColumns({f"at_{b}": _bisected(lambda j, b=b: share(b, _cover(j, cover_step)), n_grid, target) for b in names})
    sure = F.lit(True)
    for c in rates:
        sure = sure & F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    out = {}
    for b, name in names.items():
        at = F.col(f"at_{b}")
        here, above = share(b, _cover(at, cover_step)), share(b, _cover(at - 1, cover_step))
        sure = sure & ((at == 0) | (above - target > NOISE)) & ((at == n_grid) | (ceil_double(here) == target) | (target - 1 - here > NOISE))
        out[name] = F.when((at < n_grid) & (ceil_double(here) == target), _cover(at, cover_step))
    found = found.withColumn("sure", F.coalesce(sure, F.lit(False)))
    bisected = found.where("sure").select("k", *[c.alias(n) for n, c in out.items()])
    points = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_grid - 1).cast("bigint")))
    cells = found.where("NOT sure").select("k", "ratio", *rates, points.alias("j")).withColumn("cover", _cover(F.col("j"), cover_step))
    scanned = cells.groupBy("k").agg(*[first_cover_at(share(b, F.col("cover")), F.col("cover"), target).alias(n) for b, n in names.items()])
    return bisected.unionByName(scanned).select((F.col("k") / F.lit(1 / ratio_step)).alias("r"), *names.values())
