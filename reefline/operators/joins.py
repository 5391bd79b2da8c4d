"""Join helpers: null-safe key joins and grid completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.session import cut_lineage

def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (grouping semantics).

    ``<=>`` is still an equi-join key for Spark, so hash / sort-merge joins apply.
    The result carries the key columns once, from the left side.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"__rk{i}")
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"__rk{i}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    if how not in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        out = out.drop(*[f"__rk{i}" for i in range(len(keys))])
    return out


def complete(df: DataFrame, a: str, b: str, fill: dict | None = None) -> DataFrame:
    """All combinations of the values seen in ``a`` and ``b``; missing cells filled.

    The product of the two lists of distinct values (NULL is a value) is the
    feature itself and has no size limit.  ``df`` is written once, as the lists, the
    present cells and the result all read it.  Rows already present keep their
    values (and their multiplicity).
    """
    df = cut_lineage(df)
    keys = [a, b]
    grid = df.select(a).distinct().join(df.select(b).distinct(), how="cross")
    missing = join_null_safe(grid, df.select(*keys).distinct(), keys, "left_anti")
    for c in df.columns:
        if c not in keys:
            val = (fill or {}).get(c)
            missing = missing.withColumn(c, F.lit(val).cast(df.schema[c].dataType))
    return df.unionByName(missing.select(*df.columns))
