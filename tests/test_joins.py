"""Join helpers: null-safe joins, completion."""

from reefline.operators.joins import complete, join_null_safe


def test_join_null_safe_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, w int")
    assert [(r.k, r.v, r.w) for r in join_null_safe(a, b, ["k"]).collect()] == [(None, 1, 10)]


def test_complete_keeps_null_level_and_existing_rows(spark):
    df = spark.createDataFrame([("m1", "B", 1.0), ("m1", "B", 2.0), ("m2", None, 3.0)], "a string, b string, v double")
    out = sorted(((r.a, r.b, r.v) for r in complete(df, "a", "b").collect()), key=str)
    assert out == sorted([("m1", "B", 1.0), ("m1", "B", 2.0), ("m2", None, 3.0), ("m1", None, None),
                          ("m2", "B", None)], key=str)


def test_complete_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame([(i, i % 7, 1.0) for i in range(50)], "a int, b int, v double").mapInPandas(count, "a int, b int, v double")
    assert complete(df, "a", "b", fill={"v": 0.0}).count() == 350 and seen.value == 50
