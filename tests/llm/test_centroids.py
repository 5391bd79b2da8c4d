import hashlib
import math
import random

import numpy as np
import pytest

from reefline.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance string, ids string"


def _rows(n, dims, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(middles)]) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def _brute(rows, k, rounds, dims):
    kept = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, cents)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    return out, cents


@pytest.mark.parametrize("dims,k,rounds", [(64, 7, 3), (3, 4, 5)])
def test_matches_brute_force(spark, monkeypatch, dims, k, rounds):
    rows = _rows(300, dims)
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (900, [1e30] * dims), (901, [-1e30] * dims)]
    bad = [(902, rows[0][1][:-1]), (903, [None, *rows[0][1][1:]]), (904, [math.nan, *rows[0][1][1:]]), (905, [math.inf, *rows[0][1][1:]]), (906, None), (907, [])]
    monkeypatch.setattr(centroids, "BLOCK", 50)
    want, cents = _brute(rows, k, rounds, dims)
    got = centroids.report(_frame(spark, rows + bad).repartition(7), k=k, rounds=rounds, dims=dims).collect()

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_fewer_vectors_than_centroids_ties_and_none(spark):
    same = [(i, [0.5] * 64) for i in range(10)]
    got = centroids.report(_frame(spark, same), k=40).collect()
    assert len(got) == 10 and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}
    assert centroids.report(_frame(spark, [])).count() == 0
    assert centroids.report(_frame(spark, [(1, None), (2, [1.0])])).count() == 0
