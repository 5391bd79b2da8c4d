"""Systematic-review harmonisation (ANA-1 .. ANA-5).

``prepare`` classifies methods.  The four branches (biomass, volume, surface,
extension) are rules (``BRANCHES``) that one projection applies to every row, and
``route_rates`` writes its result once: rows a branch keeps with their converted
rate, all others as they were.  The audit of the studies is one aggregate
over that table, the rescue path reads its spare rows, and the growth table is
the kept rows and the rescued ones.

All steps are row-local except the positional corrections (rows of two studies,
numbered together) and the audit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.predicates import contains_any, is_in, nonnegative, not_contains, not_in
from reefline.operators import cleaning as C
from reefline.operators.joins import join_null_safe
from reefline.operators.routing import Branch, branch_name, routed, to_targets
from reefline.session import cut_lineage
from reefline.sources.tables import GROWTH_COLUMNS

BIOMASS, VOLUME, SURFACE, EXTENSION, UNUSED = "biomass", "volume", "surface", "extension", "none"
LABELS = {BIOMASS: fv.STANDARDIZATION_BIOMASS, VOLUME: fv.STANDARDIZATION_BIOMASS, SURFACE: fv.STANDARDIZATION_SURFACE,
          EXTENSION: fv.STANDARDIZATION_EXTENSION}
RESCUE_TARGETS = {"rate_ext": fv.STANDARDIZATION_EXTENSION, "rate_surf": fv.STANDARDIZATION_SURFACE, "rate_biom": fv.STANDARDIZATION_BIOMASS}


def non_standard() -> Column:
    """SET-6: in none of the earlier unit classes and not unusable."""
    return (not_in("unit", fv.BIOMASS_UNITS + fv.SURFACE_UNITS + [fv.VOLUME_UNIT])
            & not_contains("unit", "%")
            & not_in("unit", fv.NON_STANDARD_EXCLUDED)
            & not_in("unit", fv.NON_STANDARD_ALREADY_USED))


def _surface_rows() -> Column:
    return F.col("rate").isNotNull() & not_contains("species", '"CCA"') & not_contains("species", "CCA")


BRANCHES = {b.name: b for b in (
    Branch(BIOMASS, units=fv.BIOMASS_UNITS, spellings=fv.BIOMASS_TO_CANONICAL, unit=fv.CANONICAL_BIOMASS,
           rules=fv.BIOMASS_RATE_RULES, rejects="wet", divided=(fv.BIOMASS_DAY_NOT_HOUR, fv.DAY_TO_HOUR), excluded=fv.BIOMASS_EXCLUDED,
           nonnegative=True, patches=fv.BIOMASS_PATCHES),
    # CLN-7: volume rates go through calcite density into the biomass unit
    Branch(VOLUME, units=[fv.VOLUME_UNIT], rules=fv.VOLUME_RATE_RULES, family=fv.VOLUME_FAMILY, patches=fv.VOLUME_PATCHES),
    Branch(SURFACE, units=fv.SURFACE_UNITS, keeps=_surface_rows, spellings=fv.SURFACE_TO_CANONICAL, unit=fv.CANONICAL_SURFACE,
           early=fv.SURFACE_PRE_PATCHES, rules=fv.SURFACE_RATE_RULES, excluded=fv.SURFACE_EXCLUDED, nonnegative=True, patches=fv.SURFACE_PATCHES),
    # no rule on the rate's sign: missing rates stay
    Branch(EXTENSION, takes=non_standard, spellings=fv.EXTENSION_TO_CANONICAL, unit=fv.CANONICAL_EXTENSION, rules=fv.EXTENSION_RATE_RULES,
           patches=fv.EXTENSION_PATCHES))}


def prepare(rates: DataFrame) -> DataFrame:
    """Method families, sentinel fill and dropped methods, plus the ``branch`` that a row's unit sends it to."""
    return branch_name(C.classify_methods(rates), list(BRANCHES.values()), "branch", UNUSED)


def _harmonised(prepared: DataFrame, *names: str) -> DataFrame:
    return routed(prepared, [BRANCHES[n] for n in names]).where(F.col("branch") != UNUSED)


def harmonise_biomass(prepared: DataFrame) -> DataFrame:
    """ANA-1 without the volume part: biomass-normalised rates in umol g-1 h-1."""
    return _harmonised(prepared, BIOMASS)


def harmonise_volume(prepared: DataFrame) -> DataFrame:
    """CLN-7: volume rates through calcite density into the biomass unit."""
    return _harmonised(prepared, VOLUME)


def harmonise_biomass_and_volume(prepared: DataFrame) -> DataFrame:
    """ANA-1: both parts in one pass."""
    return _harmonised(prepared, BIOMASS, VOLUME)


def harmonise_surface(prepared: DataFrame, order: list[str] | None) -> DataFrame:
    """ANA-2: surface-normalised rates in mg cm-2 day-1.  ``order=None`` skips the
    positional patch (it needs a row order; streams have none)."""
    if order is not None:
        target, values = fv.SURFACE_POSITIONAL
        prepared = C.patch_positional(prepared.where(is_in("unit", fv.SURFACE_UNITS) & _surface_rows()), target, values, order)
    return _harmonised(prepared, SURFACE)


def harmonise_extension(prepared: DataFrame) -> DataFrame:
    """ANA-3: extension rates in mm yr-1 (no non-negative filter: missing rates stay)."""
    return _harmonised(prepared, EXTENSION)


@dataclass(frozen=True)
class Routed:
    """Every prepared row once, in ``branch`` the branch that keeps it or ``none``; ``no_method`` marks a missing
    method as reported.  ``numbered`` has the few rows of positional corrections."""
    table: DataFrame
    numbered: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.table.unionByName(self.numbered)

    def kept(self, *branches: str) -> DataFrame:
        return self.rows.where(F.col("branch").isin(list(branches or LABELS)))


def _rescuable() -> Column:
    return (not_contains("unit", "%") & F.coalesce(F.col("temperature") != F.lit(fv.RESCUE_TEMPERATURE_EXCLUDED), F.lit(False))
            & F.col("rate").isNotNull())


def route_rates(rates: DataFrame, order: list[str]) -> Routed:
    """All branches in one pass over ``rates``: two written tables, whatever reads them.

    Rows whose values a positional correction replaces by their place in the study wait under a branch
    of their own; they are numbered by ranges of (study, order), corrected, and routed like the others."""
    prepared = prepare(rates)
    rules = list(BRANCHES.values())
    at_surface = is_in("paper_name", [fv.SURFACE_POSITIONAL[0]]) & (F.col("branch") == SURFACE) & _surface_rows()
    at_rescue = is_in("paper_name", [fv.RESCUE_POSITIONAL[0]]) & _rescuable()
    place = F.when(at_surface, F.lit(WAITING[0])).when(at_rescue, F.lit(WAITING[1]))
    extra = [c for c in order if c not in RATE_COLUMNS]
    ordinals = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(extra)] or [F.lit(0).alias("o0")])
    # a lambda is evaluated outside the fused stage, whose one method would otherwise be too long for the JVM to compile
    ordinals = F.element_at(F.transform(F.array(F.lit(0)), lambda _: ordinals), 1)
    slim = prepared.select(*RATE_COLUMNS, "method_family", (F.col("method") == F.lit(fv.NA_TEXT)).alias("no_method"), place.alias("_place"),
                           F.when(place.isNotNull(), ordinals).alias("_order"))
    tagged = routed(slim, rules, unless=F.col("_place").isNotNull()).withColumn("branch", F.coalesce("_place", "branch"))
    table = cut_lineage(tagged.drop("_place"))
    by_place = [F.col(f"_order.o{extra.index(c)}") if c in extra else F.col(c) for c in order]
    numbered = _numbered(table.where(F.col("branch").isin(*WAITING)), "branch", by_place)

    def corrected(df: DataFrame, correction: tuple, where: Column) -> DataFrame:
        for column, vals in correction[1].items():
            nth = F.element_at(F.array(*[F.lit(v).cast(df.schema[column].dataType) for v in vals]), (F.col("_nth") % len(vals) + 1).cast("int"))
            df = df.withColumn(column, F.when(where, nth).otherwise(F.col(column)))
        return df

    # a correction holds for the rows that its branch, or the rescue path, goes on with
    before = numbered.withColumn("_place", F.col("branch")).withColumn("_raw", F.struct(*fv.SURFACE_POSITIONAL[1]))
    again = routed(corrected(before, fv.SURFACE_POSITIONAL, F.col("_place") == WAITING[0]).drop("branch"), rules)
    unused = F.col("branch") == UNUSED
    for column in fv.SURFACE_POSITIONAL[1]:
        again = again.withColumn(column, F.when(unused & (F.col("_place") == WAITING[0]), F.col(f"_raw.{column}")).otherwise(F.col(column)))
    again = corrected(again, fv.RESCUE_POSITIONAL, unused & (F.col("_place") == WAITING[1]))
    rest = table.where(~F.col("branch").isin(*WAITING)).drop("_order")
    return Routed(rest, again.select(*rest.columns))


WAITING = ("positional_surface", "positional_rescue")
RATE_COLUMNS = ["paper_name", "method", "unit", "rate", "error", "species", "climate", "temperature"]


def _numbered(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``_nth``: the place (from 0) of a row among those of its ``key`` by ``order``, nulls first.

    Dealt out by ranges and written once; windows run per range and add the rows of the ranges before."""
    from pyspark.sql import Window

    dealt = cut_lineage(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    joined = dealt.join(counts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_nth", F.col("_offset") + F.row_number().over(inside) - 1).drop("_key", "_of", "_offset", "_part")


def study_audit(r: Routed) -> DataFrame:
    """AGG-11 / SET-4 / SET-5: ``(paper_name, branches, no_method)``, one row per study: a bit for each branch that
    keeps a row of it, and whether a row has no method.  One aggregate, of one row per study and task before its shuffle."""
    bit = F.lit(0)
    for i, name in enumerate(LABELS):
        bit = F.when(F.col("branch") == name, F.lit(1 << i)).otherwise(bit)
    return r.rows.groupBy("paper_name").agg(F.bit_or(bit).alias("branches"), F.bool_or("no_method").alias("no_method"))


def incomplete_studies(r: Routed) -> DataFrame:
    """Studies with a missing method that no branch used (key table)."""
    return study_audit(r).where(F.col("no_method") & (F.col("branches") == 0)).select("paper_name")


def rescue_incomplete(r: Routed) -> DataFrame:
    """ANA-4: rows of incomplete studies, patched and converted into three targets."""
    spare = r.rows.where((F.col("branch") == UNUSED) & _rescuable() & ~contains_any("paper_name", fv.RESCUE_STUDY_PATTERN_EXCLUDED))
    df = join_null_safe(spare.drop("genus", "rate_std", "branch", "no_method"), incomplete_studies(r), ["paper_name"], "left_semi")
    df = C.patch_values(df, fv.RESCUE_PATCHES)
    df = C.convert_targets(df, {"rate_ext": fv.RESCUE_EXTENSION_RULES, "rate_surf": fv.RESCUE_SURFACE_RULES,
                                "rate_biom": fv.RESCUE_BIOMASS_RULES})
    return C.add_taxon(df)


def growth(rates: DataFrame, order: list[str], extra: DataFrame | None = None) -> DataFrame:
    """ANA-5: the unified growth table with standardised rate and error, tagged by
    standardisation, including the late corrections.  ``rates`` is read once."""
    r = route_rates(rates, order)
    label = F.lit(None).cast("string")
    for name, text in LABELS.items():
        label = F.when(F.col("branch") == name, F.lit(text)).otherwise(label)
    columns = ["paper_name", "genus", "climate", "temperature", "method_family", "rate_std", "error", "unit", "standardization"]
    kept = r.kept().withColumn("standardization", label).select(*columns)
    rescued = to_targets(rescue_incomplete(r), RESCUE_TARGETS, "standardization", "rate_std").select(*columns)
    g = kept.unionByName(rescued)
    g = g.where((F.col("standardization") != F.lit(fv.STANDARDIZATION_BIOMASS)) | nonnegative("rate_std"))
    g = C.convert_error(g).select(*GROWTH_COLUMNS)
    if extra is not None:
        from reefline.sources.multipart import positional_append
        g = positional_append(g, extra)
    old, new = fv.CLIMATE_RECODE
    g = C.recode(g, "climate", old, new)
    g = C.patch_values(g, fv.GROWTH_PATCHES)
    genus, climate = fv.BIOMASS_GENUS_CLIMATE_FIX
    return C.set_where(g, "climate", climate, (F.col("standardization") == F.lit(fv.STANDARDIZATION_BIOMASS))
                       & (F.col("genus") == F.lit(genus)))


def growth_part(g: DataFrame, label: str) -> DataFrame:
    """SNK-2 / SRT-2: one standardisation part, selected by its tag (not by position)."""
    return g.where(F.col("standardization") == F.lit(label))


def cca_surface_g_cm2_year(g: DataFrame) -> DataFrame:
    """Surface part rescaled from mg cm-2 day-1 to g cm-2 yr-1 (CLN-16)."""
    s = growth_part(g, fv.STANDARDIZATION_SURFACE)
    return s.withColumns({c: F.col(c) / 1000 * fv.YEAR_TO_DAY for c in ("rate_std", "std_error")})
