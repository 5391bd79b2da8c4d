"""Review panels (ANA-12): filtered extracts with error bounds and axis censoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.lookup import lookup
from reefline.functions.predicates import censor, is_in, not_in

@dataclass(frozen=True)
class Panel:
    panel: int
    part: str
    keep: Column
    scale: float = 1.0
    limits: tuple[float, float] | None = None


def _panels() -> list[Panel]:
    g, paper = "genus", "paper_name"
    studies = not_in(paper, fv.PANEL_EXCLUDED_STUDIES)
    hal_ne = F.col(g) != fv.HALIMEDA
    not_hal = not_in(g, [fv.HALIMEDA])
    art, not_art = is_in(g, fv.ARTICULATE_GENERA), not_in(g, fv.ARTICULATE_GENERA)
    surf_scale = fv.SURFACE_TO_G_CM2_YEAR
    return [
        Panel(1, fv.STANDARDIZATION_BIOMASS, studies & hal_ne & not_art, limits=fv.PANEL_BIOMASS_LIMITS),
        Panel(2, fv.STANDARDIZATION_BIOMASS, studies & hal_ne & art),
        Panel(3, fv.STANDARDIZATION_BIOMASS, studies & (F.col(g) == fv.HALIMEDA)),
        Panel(4, fv.STANDARDIZATION_EXTENSION, not_hal & not_art),
        Panel(5, fv.STANDARDIZATION_EXTENSION, not_hal & art),
        Panel(6, fv.STANDARDIZATION_SURFACE, not_hal & not_art, surf_scale, fv.PANEL_SURFACE_LIMITS),
        Panel(7, fv.STANDARDIZATION_SURFACE, not_hal & art, surf_scale, fv.PANEL_SURFACE_LIMITS),
        Panel(8, fv.STANDARDIZATION_SURFACE, F.col(g) == fv.HALIMEDA, surf_scale, fv.PANEL_SURFACE_LIMITS),
    ]


def order_rank(c, order: list[str]) -> Column:
    """SRT-4: position of a label in a legend order (NULL when not listed)."""
    return lookup(c, [(v, i + 1) for i, v in enumerate(order)])


def review_panels(growth: DataFrame) -> DataFrame:
    """Every panel's points: y and y -/+ error (scaled), censored to the axis limits.

    The plan is a union of eight filtered projections of the growth table
    (row-local, no shuffle); callers pass a materialised growth table.
    """
    out = None
    for p in _panels():
        y = F.col("rate_std") * F.lit(p.scale) if p.scale != 1.0 else F.col("rate_std")
        err = F.col("std_error") * F.lit(p.scale) if p.scale != 1.0 else F.col("std_error")
        cols = {"y": y, "ymin": y - err, "ymax": y + err}
        if p.limits:
            cols = {k: censor(v, *p.limits) for k, v in cols.items()}
        sel = growth.where((F.col("standardization") == p.part) & p.keep).select(
            F.lit(p.panel).alias("panel"), "paper_name", "genus", "method_family", "climate",
            *[v.alias(k) for k, v in cols.items()],
            order_rank("climate", fv.PANEL_CLIMATE_ORDER).alias("climate_rank"),
            order_rank("method_family", fv.PANEL_METHOD_ORDER).alias("method_rank"))
        out = sel if out is None else out.unionByName(sel)
    return out
