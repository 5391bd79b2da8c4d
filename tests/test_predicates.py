"""Null-semantics rules on literal rows."""

from pyspark.sql import functions as F

from reefline.functions import as_number, binomial, ceil_double, genus_of, is_in, nonnegative, not_contains, not_in, word
from reefline.functions.numeric import safe_div


def _rows(spark, values, ddl="x string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_not_in_keeps_missing(spark):                       # N1
    df = _rows(spark, ["a", "b", None])
    assert sorted(df.where(not_in("x", ["a"])).collect(), key=str) == sorted([("b",), (None,)], key=str)


def test_not_in_with_null_member_drops_missing(spark):      # N2
    df = _rows(spark, ["a", "b", None])
    assert df.where(not_in("x", ["a", None])).collect() == [("b",)]


def test_in_and_not_in_partition_all_rows(spark):
    df = _rows(spark, ["a", "b", None, "c"])
    assert df.where(is_in("x", ["a", "c"])).count() + df.where(not_in("x", ["a", "c"])).count() == 4


def test_not_contains_keeps_missing(spark):                 # N4
    df = _rows(spark, ["wet x", "dry", None])
    assert df.where(not_contains("x", "wet")).count() == 2


def test_nonnegative_rejects_nan_and_null(spark):           # N14
    df = _rows(spark, [1.0, -1.0, float("nan"), None, 0.0], "x double")
    assert sorted(r[0] for r in df.where(nonnegative("x")).collect()) == [0.0, 1.0]


def test_word_and_binomial(spark):                          # N11
    df = _rows(spark, ["Lithothamnion glaciale", "Porolithon", None, "A  b"])
    out = df.select(genus_of("x").alias("g"), binomial("x").alias("s"), word("x", 2).alias("w2")).collect()
    assert out[0] == ("Lithothamnion", "Lithothamnion_glaciale", "glaciale")
    assert out[1] == ("Porolithon", "Porolithon_NA", None)
    assert out[2] == (None, "NA_NA", None)
    assert out[3] == ("A", "A_", "")                          # empty token between two spaces counts


def test_as_number_guards_text(spark):                      # N12
    df = _rows(spark, ["0.5", "n/a", "1d", " 2 ", "3e-04", None, "NaN"])
    got = [r[0] for r in df.select(as_number("x")).collect()]
    assert got[:6] == [0.5, None, None, 2.0, 0.0003, None]
    assert got[6] != got[6]


def test_safe_div_and_ceil(spark):                          # N15, N16
    df = spark.createDataFrame([(1.0, 0.0, 49.2)], "a double, b double, c double")
    row = df.select(safe_div("a", "b").alias("d"), ceil_double("c").alias("e")).first()
    assert row.d is None and row.e == 50.0 and isinstance(row.e, float)


def test_grouping_label_vs_null_key(spark):                 # N18
    from reefline.operators.summaries import with_total
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    out = {r.g: r.mean for r in with_total(df, "g", "v", "All").collect()}
    assert out == {"a": 1.5, None: 3.0, "All": 2.0}


def test_count_distinct_with_null(spark):                   # N13
    from reefline.operators.summaries import distinct_count
    df = _rows(spark, ["a", None, "a", "b"])
    assert distinct_count(df, "x").first()[0] == 3
    assert F is not None


def test_members_with_quotes_and_backslashes(spark):
    odd = ["O'Leary", 'a "b"', "back\\slash", "%_", "umol g -1\x02", "x'); --"]
    df = spark.createDataFrame([(v,) for v in [*odd, "other", None]], "t string")
    assert [r[0] for r in df.select(is_in("t", odd)).collect()] == [True] * len(odd) + [False, False]
    assert [r[0] for r in df.select(is_in("t", [*odd, None])).collect()] == [True] * len(odd) + [False, True]
