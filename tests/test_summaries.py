"""Exact quantiles (both strategies), quantile of quantiles, box statistics, crosstab."""

import numpy as np
import pytest

from reefline.operators import summaries as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g in ("a", "b", "c") for v in np.round(rng.gamma(2, 3, 57 + ord(g)), 2)]
    rows += [("d", 5.0)] + [(None, 1.0), (None, 4.0)]          # one-row group, null key group
    return spark.createDataFrame(rows, "g string, v double"), rows


PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@pytest.mark.parametrize("partitions", [1, 7])
def test_group_quantiles_type7(spark, data, partitions):
    df, rows = data
    out = {r.g: r for r in S.group_quantiles(df.repartition(partitions), ["g"], "v", PROBS).collect()}
    for g in ("a", "b", "c", "d", None):
        vals = np.array([v for k, v in rows if k == g])
        exp = np.quantile(vals, PROBS)                          # numpy default = type 7
        got = [out[g][S.qname(p)] for p in PROBS]
        assert np.allclose(got, exp, rtol=0, atol=1e-12)


def test_positions_of_a_hot_group_over_many_ranges(spark):
    from reefline.operators.ranking import value_positions

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("if(id % 10 = 0, 'b', null) as g", "cast(id % 600 as double) as v")
        got = {(r.g, r.v): (r._lt, r._cnt, r._n) for r in value_positions(df, ["g"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for g in ("b", None):
        vals = np.array([i % 600 for i in range(4000) if (i % 10 == 0) == (g == "b")])
        assert {v: x for (k, v), x in got.items() if k == g} == {float(v): ((vals < v).sum(), (vals == v).sum(), len(vals)) for v in set(vals)}


def test_quantile_of_quantiles(spark, data):
    df, rows = data
    row = S.quantile_of_quantiles(df.where("g in ('a','b','c')"), ["g"], "v", PROBS, "g", "All").first()
    per = {g: np.quantile([v for k, v in rows if k == g], PROBS) for g in "abc"}
    for i, p in enumerate(PROBS):
        assert np.isclose(row[S.qname(p)], np.quantile([per[g][i] for g in "abc"], p), atol=1e-12)
    assert row.g == "All"


def test_box_stats(spark, data):
    df, rows = data
    out = {r.g: r for r in S.box_stats(df, ["g"], "v").collect()}
    vals = np.array([v for k, v in rows if k == "a"])
    q1, q2, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = vals[(vals >= lo) & (vals <= hi)]
    r = out["a"]
    assert np.isclose(r.middle, q2) and r.ymin == inside.min() and r.ymax == inside.max()
    assert r.n_outliers == len(vals) - len(inside)


def test_crosstab_fills_zero_cells(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "q")], "a string, b string")
    out = {(r.a, r.b): r.n for r in S.crosstab_long(df, "a", "b").collect()}
    assert out == {("x", "p"): 1, ("x", "q"): 1, ("y", "p"): 1, ("y", "q"): 0}


def test_strict_mean_sd(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    out = {r.g: (r.mean, r.sd) for r in S.group_mean_sd(df, ["g"], "v", strict=True).collect()}
    assert out == {"a": (None, None), "b": (2.0, None)}          # N7, N9
