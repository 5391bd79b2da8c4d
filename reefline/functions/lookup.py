"""Literal lookups for fixed vocabularies.

A vocabulary of fixed size is compiled into a literal map expression instead of
a join: the lookup is evaluated inside whole-stage codegen, needs no broadcast
exchange and works on streaming DataFrames.  A vocabulary held in a DataFrame
is a plain left join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=256)
def _map_expr(items: tuple, gateway: int) -> Column:
    args = []
    for k, v in items:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def literal_map(pairs: Iterable[tuple] | Mapping) -> Column:
    """A literal map expression (first rule wins, like a CASE chain).

    Built once per vocabulary and JVM gateway: an unresolved literal expression
    does not depend on the session, and building it costs one JVM call per
    literal."""
    items = list(pairs.items()) if isinstance(pairs, Mapping) else list(pairs)
    seen: dict = {}
    for k, v in items:
        if k is not None and k not in seen:
            seen[k] = v
    sc = SparkContext._active_spark_context
    gateway = id(sc._gateway) if sc is not None else 0
    return _map_expr(tuple(seen.items()), gateway)


def lookup(c, pairs: Iterable[tuple] | Mapping) -> Column:
    """Value for the key in ``c``; NULL when the key is missing or unmatched."""
    return F.try_element_at(literal_map(pairs), _col(c))


def canonical(c, spellings: Iterable[str], canonical_value: str) -> Column:
    """Fold listed spellings into one canonical spelling, others unchanged."""
    c = _col(c)
    vals = [s for s in spellings if s is not None]
    return F.when(F.coalesce(c.isin(vals), F.lit(False)), F.lit(canonical_value)).otherwise(c)


def classify(c, families: Mapping[str, list[str]]) -> Column:
    """Family for a spelling (spelling lists are checked in order, first wins)."""
    pairs = [(s, fam) for fam, spellings in families.items() for s in spellings]
    return lookup(c, pairs)


def convert(c_value, c_key, rules: Iterable[tuple[str, float]]) -> Column:
    """``value * factor(key)``; NULL where the key has no rule."""
    return _col(c_value) * lookup(c_key, [(k, float(f)) for k, f in rules])
