"""Multi-part and positional scans (SRC-3, SRC-4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_parts(parts: Sequence[DataFrame], columns: Sequence[str], drop_null_parts: Sequence[bool],
                rescale: dict[str, float] | None = None) -> DataFrame:
    """SRC-3: distinct each part on ``columns``, drop NULL rows only in flagged parts,
    append by name, then rescale columns (``{col: factor}``)."""
    cleaned = []
    for part, drop_nulls in zip(parts, drop_null_parts):
        p = part.select(*columns).distinct()
        if drop_nulls:
            p = p.na.drop(how="any")
        cleaned.append(p)
    out = reduce(lambda a, b: a.unionByName(b), cleaned)
    for c, factor in (rescale or {}).items():
        out = out.withColumn(c, F.col(c) * F.lit(float(factor)))
    return out


def positional_append(base: DataFrame, extra: DataFrame, take: int | None = None) -> DataFrame:
    """SRC-4 / PRJ-4: take the first ``take`` columns of ``extra`` by position, give them
    ``base``'s names, cast to ``base``'s types and append."""
    n = take if take is not None else len(base.columns)
    cols = extra.columns[:n]
    renamed = extra.select(*[F.col(c) for c in cols]).toDF(*base.columns[:n])
    renamed = renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema.fields[:n]])
    return base.select(*base.columns[:n]).unionByName(renamed)
