"""Data-cleaning operators (CLN-*): DataFrame -> DataFrame, usable with ``df.transform``.

All are row-local expressions or joins against small, fixed-size patch tables,
so they add no shuffle (except the positional patch, which needs an order
within its target keys) and they accept streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions.lookup import canonical, classify, convert, lookup
from reefline.functions.numeric import as_number
from reefline.functions.predicates import is_in, ne_all, nonnegative, not_contains
from reefline.functions.text import binomial, fill_missing, genus_of, missing_if
from reefline.operators.joins import join_null_safe
from reefline.operators.ranking import row_numbers


def classify_methods(df: DataFrame, families: Mapping[str, list[str]] = fv.METHOD_FAMILIES,
                     dropped: Sequence[str] = fv.DROPPED_METHODS, method: str = "method",
                     family: str = "method_family") -> DataFrame:
    """CLN-1 + CLN-2 + FIL-2: family from the method spelling, missing values as the
    text sentinel ``'NA'`` in both columns, then drop the listed methods."""
    return (df.withColumn(family, classify(method, families))
              .withColumn(method, fill_missing(method))
              .withColumn(family, fill_missing(family))
              .where(ne_all(method, dropped)))


def unfill(df: DataFrame, columns: Iterable[str], text: str = fv.NA_TEXT) -> DataFrame:
    """CLN-3: the ``'NA'`` text sentinel back to NULL."""
    return df.withColumns({c: missing_if(c, text) for c in columns})


def canonicalise(df: DataFrame, spellings: Iterable[str], canonical_value: str, unit: str = "unit") -> DataFrame:
    """CLN-4: fold listed spellings into one canonical spelling."""
    return df.withColumn(unit, canonical(unit, spellings, canonical_value))


def convert_units(df: DataFrame, rules: Iterable[tuple[str, float]], out: str, value: str = "rate",
                  unit: str = "unit") -> DataFrame:
    """CLN-5/6/8: ``out = value * factor(unit)``; NULL where no rule matches."""
    return df.withColumn(out, convert(value, unit, rules))


def convert_targets(df: DataFrame, targets: Mapping[str, Iterable[tuple[str, float]]], value: str = "rate",
                    unit: str = "unit") -> DataFrame:
    """CLN-9: one column per target, each NULL unless its rules match."""
    return df.withColumns({out: convert(value, unit, rules) for out, rules in targets.items()})


def convert_error(df: DataFrame, rules: Iterable[tuple[str, float]] = fv.ERROR_RULES, error: str = "error",
                  unit: str = "unit", out: str = "std_error") -> DataFrame:
    """CLN-10: error text to number (non-numbers become NULL), then the unit factor."""
    return df.withColumn(out, convert(as_number(error), unit, rules))


def add_taxon(df: DataFrame, species: str = "species", genus: str = "genus") -> DataFrame:
    """CLN-17: genus = first word; species rebuilt as ``Genus_species`` (``NA`` text if missing)."""
    return df.withColumn(genus, genus_of(species)).withColumn(species, binomial(species))


def patch_values(df: DataFrame, patches: Iterable[tuple[str, object, Sequence[str]]],
                 key: str = "paper_name") -> DataFrame:
    """CLN-11: keyed scalar patches ``(column, value, keys)`` applied in order.

    The patch list has a fixed size, so all patches of a column fold into one
    CASE on literal key sets (later patches first): no join, no shuffle.  The
    key column itself is never patched, so folding keeps the sequential result.
    """
    by_col: dict[str, list] = {}
    for column, value, keys in patches:
        by_col.setdefault(column, []).append((value, keys))
    out = {}
    for column, lst in by_col.items():
        dtype = df.schema[column].dataType if column in df.columns else None
        expr = None
        for value, keys in reversed(lst):            # the last patch for a key wins
            lit = F.lit(value) if dtype is None else F.lit(value).cast(dtype)
            expr = F.when(is_in(key, keys), lit) if expr is None else expr.when(is_in(key, keys), lit)
        out[column] = expr.otherwise(F.col(column)) if dtype is not None else expr
    return df.withColumns(out)


def patch_scale(df: DataFrame, keys: Sequence[str], column: str, divisor: float, key: str = "paper_name") -> DataFrame:
    """CLN-12: keyed arithmetic patch, ``column / divisor`` for the listed keys."""
    return df.withColumn(column, F.when(is_in(key, keys), F.col(column) / F.lit(float(divisor)))
                         .otherwise(F.col(column)))


def patch_positional(df: DataFrame, target_key: str, values: Mapping[str, Sequence], order: Sequence[str],
                     key: str = "paper_name", expected: int | None = None) -> DataFrame:
    """CLN-13: the n-th row (by ``order``) of ``target_key`` gets the n-th value.

    Values are recycled when the key has more rows than values (the n-th row
    gets value ``(n-1) mod k``), which is what an element-wise assignment of a
    shorter vector does.  Only rows of the target key are numbered, by ranges of
    ``order``; every other row passes through untouched and unshuffled.

    ``expected``: the number of rows that the correction was written for.  With another number
    the plan fails when it runs, rather than spread the values over other rows.
    """
    is_target = F.coalesce(F.col(key) == F.lit(target_key), F.lit(False))
    target = df.where(is_target)
    rest = df.where(~is_target)
    target = row_numbers(target, order, "__pos").withColumn("__pos", F.col("__pos") - 1)
    for column, vals in values.items():
        vals = list(vals)
        dtype = df.schema[column].dataType
        arr = F.array(*[F.lit(v).cast(dtype) for v in vals])
        target = target.withColumn(column, F.element_at(arr, (F.col("__pos") % len(vals) + 1).cast("int")))
    out = rest.unionByName(target.drop("__pos"))
    if expected is None:
        return out
    found = target.agg(F.count(F.lit(1)).alias("n")).scalar()
    message = F.concat(F.lit(f"{target_key}: {int(expected)} rows expected, found "), found.cast("string"))
    return out.where(F.when(found == F.lit(int(expected)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def exclude_keys(df: DataFrame, keys: Sequence[str], key: str = "paper_name") -> DataFrame:
    """CLN-14 (literal list): ANDed ``!=``; rows with a missing key are dropped too."""
    return df.where(ne_all(key, keys))


def exclude_by_table(df: DataFrame, excluded: DataFrame, key: str = "paper_name") -> DataFrame:
    """CLN-14 / JOI-3 (table): anti join on the key, NULL matching NULL."""
    return join_null_safe(df, excluded.select(key).distinct(), [key], "left_anti")


def recode(df: DataFrame, column: str, old: str, new: str, where: Column | None = None) -> DataFrame:
    """CLN-15: replace one value (optionally only where a condition holds)."""
    cond = F.coalesce(F.col(column) == F.lit(old), F.lit(False))
    if where is not None:
        cond = cond & F.coalesce(where, F.lit(False))
    return df.withColumn(column, F.when(cond, F.lit(new)).otherwise(F.col(column)))


def set_where(df: DataFrame, column: str, value, where: Column) -> DataFrame:
    """Set ``column`` to ``value`` where a condition holds (missing condition = no change)."""
    return df.withColumn(column, F.when(F.coalesce(where, F.lit(False)), F.lit(value)).otherwise(F.col(column)))


def keep_nonnegative(df: DataFrame, column: str) -> DataFrame:
    """FIL-5: ``column >= 0``; NULL and NaN rows are dropped."""
    return df.where(nonnegative(column))


def drop_wet(df: DataFrame, unit: str = "unit") -> DataFrame:
    return df.where(not_contains(unit, "wet"))