"""Null-aware predicates as ``Column`` builders.

Spark (and SQL) use three-valued logic: ``NULL NOT IN (...)`` is NULL and the
row is dropped by a filter.  The analysed study used a membership test where a
missing value is simply "not a member", so its negation keeps missing rows.
These builders state which behaviour is wanted instead of relying on defaults.
All are plain JVM expressions (stay inside whole-stage codegen).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split_null(values: Iterable) -> tuple[list, bool]:
    vals = list(values)
    return [v for v in vals if v is not None], any(v is None for v in vals)


def is_in(c, values: Iterable) -> Column:
    """Membership that is never NULL; a ``None`` in ``values`` matches missing rows."""
    vals, has_null = _split_null(values)
    if isinstance(c, str) and vals and all(isinstance(v, str) for v in vals):      # one expression, not one JVM call per member
        listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in vals)
        cond = F.expr(f"coalesce(`{c}` IN ({listed}), false)")
    else:
        cond = F.coalesce(_col(c).isin(vals), F.lit(False)) if vals else F.lit(False)
    return (cond | _col(c).isNull()) if has_null else cond


def not_in(c, values: Iterable) -> Column:
    """Negated membership that keeps missing rows unless ``None`` is listed."""
    return ~is_in(c, values)


def contains_any(c, pattern: str, regex: bool = False) -> Column:
    """Substring (or regex) match that is FALSE, not NULL, on missing values."""
    c = _col(c)
    m = c.rlike(pattern) if regex else c.contains(pattern)
    return F.coalesce(m, F.lit(False))


def not_contains(c, pattern: str, regex: bool = False) -> Column:
    """Exclusion by pattern that keeps rows whose value is missing."""
    return ~contains_any(c, pattern, regex)


def ne_all(c, values: Iterable) -> Column:
    """AND of ``c != v``; a missing value gives NULL, so a filter drops it."""
    c = _col(c)
    return reduce(lambda a, b: a & b, [c != F.lit(v) for v in values])


def nonnegative(c) -> Column:
    """``c >= 0`` that also rejects NaN (Spark orders NaN above every number)."""
    c = _col(c)
    return (c >= 0) & ~F.isnan(c)


def in_range(c, lo, hi) -> Column:
    """Inclusive range; NULL on missing values, FALSE on NaN."""
    c = _col(c)
    return c.between(lo, hi) & ~F.isnan(c)


def censor(c, lo, hi) -> Column:
    """Out-of-limit values become NULL, in-limit values are kept (axis limits)."""
    c = _col(c)
    return F.when(in_range(c, lo, hi), c)
