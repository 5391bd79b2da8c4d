"""Exact order statistics by bracketed selection (AGG-2, AGG-3, AGG-4, AGG-13).

1. One pass sketches each group's values (a mergeable quantile sketch, partial
   on every task) and reads a grid of approximate quantiles from it.
2. The wanted ranks, widened by a margin above the sketch's error, give one
   bracket of values per group and probability.
3. A second pass counts the rows below a bracket and keeps only the distinct
   values inside, with their multiplicity; the order statistics are found
   among them, so the result is exact.

Neither pass sorts or range-partitions the values: rows below a bracket collapse
to one count per task, and what is shuffled is the share that the margin lets in.
A bracket that is still wide is narrowed by sketching what lies inside it, until
few enough rows are left for one sort; a bracket that misses its order
statistics is widened and the pass repeated for those groups alone.  Both
depend on counts, never on the sketch being right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.operators.joins import join_null_safe
from reefline.session import cut_lineage

SKETCH = 1000           # size parameter of the sketch: a rank error of about 0.3 %
GRID = 256              # approximate quantiles read from a sketch
MARGIN = 0.01           # added to a wanted rank on both sides
INSIDE = 1 << 20        # rows of one bracket that are sorted together

def _grid(sketch: str, n: str) -> str:
    ranks = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    return f"CASE WHEN {n} > 0 THEN kll_sketch_get_quantile_double({sketch}, array({ranks})) END"


def _wanted(p: float, rows: str = "_rows") -> tuple[str, str]:
    """Type-7 quantile: numbers (from 0) of the two order statistics it lies between."""
    h = f"({rows} - 1) * {float(p)!r}D"
    return f"floor({h})", f"ceil({h})"


def _bracket(first: str, last: str, n: str, grid: str, margin: float, low: str, high: str) -> tuple[str, str]:
    """Bracket of the order statistics ``first`` to ``last`` of ``n`` values with that grid, within ``low`` and ``high``."""
    below = f"floor((({first}) / greatest({n}, 1) - {margin!r}D) * {GRID})"
    above = f"ceil((({last} + 1) / greatest({n}, 1) + {margin!r}D) * {GRID})"
    return (f"CASE WHEN {below} > 0 THEN get({grid}, int(least({below}, {GRID}))) ELSE {low} END",
            f"CASE WHEN {above} < {GRID} THEN get({grid}, int({above})) ELSE {high} END")


def _sketched(src: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: rows, rows that are numbers, and the grid of approximate quantiles."""
    number = "CASE WHEN NOT isnan(_x) THEN _x END"
    groups = src.groupBy(*keys).agg(F.expr("count(1) AS _rows"), F.expr(f"count({number}) AS _n"),
                                    F.expr(f"kll_sketch_agg_double({number}, {SKETCH}) AS _sketch"))
    return groups.select(*keys, "_rows", "_n", F.expr(_grid("_sketch", "_n")).alias("_grid"))


def _brackets(sketched: DataFrame, keys: list[str], probs: Sequence[float], margin: float) -> DataFrame:
    out = []
    for j, p in enumerate(probs):
        low, high = _bracket(*_wanted(p), "_n", "_grid", margin, "double('-Infinity')", "double('Infinity')")
        out += [F.expr(f"{low} AS _lo{j}"), F.expr(f"{high} AS _hi{j}")]
    return sketched.select(*keys, "_rows", "_n", *out)


def _placed(src: DataFrame, brackets: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """``keys + [_rows, _n, _j, _v]``: each row once per bracket that it lies in (``_v`` its value) or below (null)."""
    if keys:
        joined = join_null_safe(src, brackets, keys)
    else:
        only = brackets.select(F.struct(*brackets.columns).alias("s")).scalar()
        joined = src.withColumn("_s", only).select("_x", "_s.*")
    hits = ", ".join(f"CASE WHEN _x <= _hi{j} THEN named_struct('_j', {j}, '_v', CASE WHEN _x >= _lo{j} THEN _x END) END" for j in range(len(probs)))
    return joined.select(*keys, "_rows", "_n", F.expr(f"explode(array({hits})) AS _h")).where("_h IS NOT NULL").select(*keys, "_rows", "_n", "_h.*")


def _narrowed(src: DataFrame, brackets: DataFrame, keys: list[str], probs: Sequence[float], margin: float) -> DataFrame:
    """The same brackets after a sketch of what lies inside each, with the rows that lie inside the widest (``_most``)."""
    per = _placed(src, brackets, keys, probs).groupBy(*keys, "_j").agg(
        F.expr("count(CASE WHEN _v IS NULL THEN 1 END) AS _below"), F.expr("count(_v) AS _in"), F.expr(f"kll_sketch_agg_double(_v, {SKETCH}) AS _sketch"))
    grids = per.select(*keys, "_j", F.expr(f"named_struct('below', _below, 'n', _in, 'grid', {_grid('_sketch', '_in')}) AS _s"))
    wide = grids.groupBy(*keys).agg(*[F.expr(f"max_by(_s, CASE WHEN _j = {j} THEN 1 END) AS _s{j}") for j in range(len(probs))])
    joined = join_null_safe(brackets, wide, keys) if keys else brackets.withColumns({f"_s{j}": wide.select(f"_s{j}").scalar() for j in range(len(probs))})
    out, width = [], ["0"]
    for j, p in enumerate(probs):
        first, last = (f"({c} - _s{j}.below)" for c in _wanted(p))
        low, high = _bracket(first, last, f"_s{j}.n", f"_s{j}.grid", margin, f"_lo{j}", f"_hi{j}")
        hit = f"{first} >= 0 AND {last} < _s{j}.n"              # otherwise it has missed, and stays as it is
        out += [F.expr(f"CASE WHEN {hit} THEN {low} ELSE _lo{j} END AS _lo{j}"), F.expr(f"CASE WHEN {hit} THEN {high} ELSE _hi{j} END AS _hi{j}")]
        width.append(f"coalesce(_s{j}.n, 0)")
    return joined.select(*keys, "_rows", "_n", *out, F.expr(f"greatest({', '.join(width)}, 0) AS _most"))


def _picked(src: DataFrame, brackets: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The quantiles of each group, and whether a bracket has missed one of its order statistics."""
    counted = _placed(src, brackets, keys, probs).groupBy(*keys, "_rows", "_n", "_j", "_v").agg(F.expr("count(1) AS _cnt"))
    before = Window.partitionBy(*keys, "_j").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    at = counted.withColumn("_lt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    found = at.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _j = {j} AND _lt <= {i} AND {i} < _lt + _cnt THEN _v END) AS _{end}{j}")
                                    for j, p in enumerate(probs) for end, i in zip(("lo", "hi"), _wanted(p))])
    # groups without a number have no row in any bracket
    nothing = brackets.select(*keys, F.col("_rows").alias("_all"), F.col("_n").alias("_numbers"))
    if keys:
        whole = join_null_safe(nothing, found, keys, "left")
    else:
        whole = found.withColumns({c: nothing.select(c).scalar() for c in ("_all", "_numbers")})
    cols, missed = [], ["false"]
    for j, (p, name) in enumerate(zip(probs, names)):
        first, last = _wanted(p, "_all")
        lo, hi = (f"CASE WHEN {i} >= _numbers THEN double('NaN') ELSE _{end}{j} END" for end, i in (("lo", first), ("hi", last)))       # NaN comes last
        part = f"((_all - 1) * {float(p)!r}D - {first})"
        cols.append(F.expr(f"CASE WHEN {part} = 0 OR ({lo}) = ({hi}) THEN {lo} ELSE (1 - {part}) * ({lo}) + {part} * ({hi}) END").alias(name))
        missed += [f"({lo}) IS NULL", f"({hi}) IS NULL"]
    return whole.select(*keys, *cols, F.expr(f"({' OR '.join(missed)}) AND _all > 0 AS _missed"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    margin: float = MARGIN, inside: int = INSIDE) -> DataFrame:
    """Exact type-7 quantiles per group: one row per group, one column per probability.

    NULL values are left out (a group without others has no row), NULL keys form a
    group, and NaN counts as larger than any number.  ``keys=[]`` gives one row, of
    nulls without values.  ``df`` is read twice, so a costly one should be a
    written table.  Written are only tables of one row per group: the grids, as both
    passes read them, and the result, as the check for misses reads it."""
    keys, probs, names = list(keys), list(probs), list(names)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    return _select(src, cut_lineage(_sketched(src, keys)), keys, probs, names, margin, inside)


def _select(src: DataFrame, sketched: DataFrame, keys: list[str], probs: list[float], names: list[str], margin: float, inside: int) -> DataFrame:
    brackets = _brackets(sketched, keys, probs, margin)
    share = 2 * (margin + 1 / GRID)                     # of the rows of a bracket that the next one lets in, about
    rows = sketched.agg(F.max("_n")).first()[0] or 0
    most = rows * share if margin < 1 else rows
    while most > inside and share < 0.5:
        brackets = cut_lineage(_narrowed(src, brackets, keys, probs, margin))
        last, most = most, (brackets.agg(F.max("_most")).first()[0] or 0) * share
        if most >= last:                                # one value holds the bracket: it is one row of the last pass
            break
    result = cut_lineage(_picked(src, brackets, keys, probs, names))
    missed = result.where("_missed").select(*keys, "_missed")
    if not missed.take(1):
        return result.drop("_missed")
    if keys:
        src, sketched = (join_null_safe(d, missed, keys, "left_semi") for d in (src, sketched))
    again = _select(src, cut_lineage(sketched), keys, probs, names, margin * 8, inside)
    return result.where(~F.col("_missed")).drop("_missed").unionByName(again)
