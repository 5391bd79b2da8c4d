"""Bracketed selection against numpy's type-7 quantiles, with brackets that miss and brackets that must be narrowed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.operators import selection as SEL

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


@pytest.fixture(scope="module")
def values(spark):
    """A hot group, groups of ties, tiny groups and a null key."""
    rng = np.random.default_rng(5)
    data = {"hot": rng.lognormal(0, 2, 20000), "ties": np.round(rng.normal(size=3000), 1), "one": np.array([4.0]), "two": np.array([1.0, 9.0]),
            "same": np.full(500, 2.5), None: rng.uniform(-1, 1, 777)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("hot", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5), data


def _check(out, data):
    got = {r.g: [r[n] for n in NAMES] for r in out.collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert np.allclose(got[k], np.quantile(vs, PROBS), rtol=0, atol=1e-12), k


def test_matches_numpy(values):
    df, data = values
    _check(SEL.exact_quantiles(df, ["g"], "v", PROBS, NAMES), data)


def test_missed_brackets_are_widened(values, monkeypatch):
    df, data = values
    calls = []
    select = SEL._select
    monkeypatch.setattr(SEL, "_select", lambda *a: calls.append(a[5]) or select(*a))
    monkeypatch.setattr(SEL, "SKETCH", 8)                # a sketch of eight values: the brackets miss
    _check(SEL.exact_quantiles(df, ["g"], "v", PROBS, NAMES, margin=0.0001), data)
    assert len(calls) > 1 and calls[1] == 8 * calls[0]


def test_wide_brackets_are_narrowed(values, monkeypatch):
    df, data = values
    rounds = []
    narrowed = SEL._narrowed
    monkeypatch.setattr(SEL, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    _check(SEL.exact_quantiles(df, ["g"], "v", PROBS, NAMES, inside=40), data)
    whole = np.concatenate(list(data.values()))
    row = SEL.exact_quantiles(df, [], "v", PROBS, NAMES, inside=40).first()
    assert np.allclose(list(row), np.quantile(whole, PROBS), rtol=0, atol=1e-12)
    assert len(rounds) == 2
    _check(SEL.exact_quantiles(df.where("g = 'ties'"), ["g"], "v", PROBS, NAMES, inside=1), {"ties": data["ties"]})     # a tie can't be narrowed
    assert len(rounds) > 3


def test_nan_is_largest_and_infinities_are_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", float("nan")), ("c", float("-inf")), ("c", float("inf")), ("c", 3.0)],
                               "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in SEL.exact_quantiles(df, ["g"], "v", [0, 0.5, 1], ["lo", "mid", "hi"]).collect()}
    assert got["a"][:2] == (1.0, 2.0) and np.isnan(got["a"][2]) and np.isnan(got["b"]).all()
    assert got["c"] == (float("-inf"), 3.0, float("inf"))


def test_no_values(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert SEL.exact_quantiles(none, ["g"], "v", [0.5], ["m"]).count() == 0
    assert SEL.exact_quantiles(none, [], "v", [0.5], ["m"]).collect()[0].m is None
    assert SEL.exact_quantiles(spark.range(5).select(F.col("id").alias("v")), [], "v", [0.5], ["m"]).first().m == 2.0


def test_values_are_neither_sorted_nor_dealt_by_ranges(values):
    df, _ = values
    sketched = SEL._sketched(df.select("g", F.col("v").alias("_x")), ["g"])
    plan = SEL._picked(df.select("g", F.col("v").alias("_x")), SEL._brackets(sketched, ["g"], PROBS, 0.01), ["g"], PROBS, NAMES)
    text = plan._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text
