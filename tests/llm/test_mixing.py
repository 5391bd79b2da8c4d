from fractions import Fraction

import pytest

from reefline.llm import mixing

from .cases import frame, odd_frame, texts, words


def _targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, target = set(names), {}
    rest = Fraction(sum(sizes.values()))
    while left:
        total = sum(weight[s] for s in left)
        above = [s for s in left if rest * weight[s] / total > epochs * sizes[s]]
        if not above:
            target |= {s: rest * weight[s] / total for s in left}
            break
        for s in above:
            target[s] = Fraction(epochs * sizes[s])
        left -= set(above)
        rest -= sum(target[s] for s in above)
    return target


@pytest.mark.parametrize("sizes", [[10, 400, 90, 7], [1000, 1, 1, 1, 1, 50], [5], [0, 30, 0, 2]])
def test_targets_match_round_by_round_resharing(spark, sizes):
    held = {f"s{i}": n for i, n in enumerate(sizes)} | {None: 3}
    df = spark.createDataFrame(list(held.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, 3.0).collect()}
    want = _targets(held)
    assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 for s in want)


def test_mix_comes_near_targets_and_reruns_agree(spark, tmp_path):
    docs = frame(spark, [(i, t, ["a", "b", "c", None][i % 4 if i % 2 else 0]) for i, t in enumerate(texts(400, words=40))], tmp_path / "d")
    out = mixing.mix(docs).collect()
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        by.setdefault(r["source"], [r["target"], 0])[1] += r["size"] * r["copies"]
    assert all(abs(taken - target) <= 40 for target, taken in by.values())
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    counted = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert counted == {i: n for i, n in again.items() if n}


def test_odd_rows(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    out = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in out) == sorted(len(words(r["text"])) for r in docs.collect())


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["target"] for r in mixing.mix(frame(spark, [(1, None, "a")])).collect()] == [0.0]
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
