import random

import numpy as np
import pyarrow as pa

from reefline.llm import quality
from reefline.llm.tables import fold

from .cases import frame, odd_frame, odd_texts, texts


def _junk(n, seed):
    rng = random.Random(seed)
    out = []
    for t in texts(n, seed=seed, words=80):
        w = t.split()
        out.append(rng.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x for x in w[:3] for _ in range(20)), "### ".join(w) + "***"]))
    return out


def test_held_out_accuracy(spark, tmp_path):
    good, bad = texts(500, seed=1, words=80), _junk(300, 2)
    rows = [(i, t, "a") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _, _ in rows if i % 5] + [(None, 1, 0), (7, None, 0), (99999, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(frame(spark, rows, tmp_path / "d"), labels, fold("doc_id", 4) == 2).collect()
    assert len(out) == 800 and all(0 <= r["score"] <= 1 for r in out)
    unseen = [r for r in out if r["held_out"] or r["doc_id"] % 5 == 0]
    right = [(r["score"] >= quality.THRESHOLD) == (r["doc_id"] < 500) for r in unseen]
    assert np.mean(right) > 0.95
    again = quality.score_documents(frame(spark, rows, tmp_path / "e").repartition(5), labels, fold("doc_id", 4) == 2).collect()
    assert max(abs(a["score"] - b["score"]) for a, b in zip(sorted(out), sorted(again), strict=True)) < 1e-3


def test_statistics_do_not_depend_on_the_batch(monkeypatch):
    held = pa.array(odd_texts())
    whole = quality.statistics(held)
    monkeypatch.setattr(quality, "PIECE_BYTES", 10)
    assert np.allclose(whole, quality.statistics(held)) and np.isfinite(whole).all()
    at = {n: i for i, n in enumerate(quality.STATISTICS)}
    one = quality.statistics(pa.array(["Go go GO go.\ngo GO 12\ngo GO 12"]))[0]
    assert np.isclose(one[at["distinct_lines"]], 2 / 3) and np.isclose(one[at["capital_words"]], 3 / 10)
    assert np.isclose(one[at["log_lines"]], np.log1p(3)) and np.isclose(one[at["distinct_words"]], 5 / 10)


def test_long_lines_are_told_apart_by_their_ends():
    start = "word " * 500
    one = quality.statistics(pa.array([f"{start}a\n{start}b\n{start}c\n{start}a"]))[0]
    assert np.isclose(one[quality.STATISTICS.index("distinct_lines")], 3 / 4)


def test_isotonic_pools_violators():
    knots, levels = quality.isotonic(np.array([0.0, 1, 2, 3, 4]), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) > 0).all() and levels.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [0.0, 1.5, 3.5]


def test_tree_sum_of_many_partitions(spark):
    df = spark.range(500).selectExpr("id as part", "array(cast(id as double), 1.0D) as values")
    assert quality.tree_sum(df, fan=4).tolist() == [500 * 499 / 2, 500.0]


def test_odd_rows_and_nothing_to_learn(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(docs, none, fold("doc_id", 4) == 2).collect()
    assert len(out) == docs.count() and {r["score"] for r in out} == {0.5}
    same = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in quality.score_documents(docs, same, fold("doc_id", 4) == 2).collect())
    assert quality.score_documents(frame(spark, []), same, fold("doc_id", 4) == 2).count() == 0
