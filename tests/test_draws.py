"""Draw summaries against brute-force numpy versions of the published formulas."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.functions.stats import qnorm, with_qnorm
from reefline.operators import draws as D


def _ar1(rng, n, phi):
    x = np.empty(n)
    x[0] = rng.normal()
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


@pytest.fixture(scope="module")
def chains(spark):
    rng = np.random.default_rng(3)
    data = {("ds", "p"): np.stack([_ar1(rng, 301, 0.6) + 0.1 * c for c in range(4)])}
    rows = [(k[0], k[1], c, i + 1, float(v)) for k, arr in data.items() for c in range(arr.shape[0])
            for i, v in enumerate(arr[c])]
    df = spark.createDataFrame(rows, "dataset string, parameter string, chain int, iteration int, value double")
    return df, data[("ds", "p")]


def _split(arr):
    n = arr.shape[1]
    h = n // 2
    return np.concatenate([arr[:, :h], arr[:, n - h:]])


def _rhat_basic(x):
    n = x.shape[1]
    return np.sqrt((n * np.var(x.mean(axis=1), ddof=1) / np.mean(np.var(x, axis=1, ddof=1)) + n - 1) / n)



def _avg_rank(v):
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    sv = v[order]
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def _zscale(x):
    r = _avg_rank(x.ravel())
    s = x.size
    return np.array([NormalDist().inv_cdf(p) for p in (r - 0.375) / (s - 0.75 + 1)]).reshape(x.shape)


def _ess(x):
    m, n = x.shape
    acov = np.array([[np.sum((c - c.mean())[: n - t] * (c - c.mean())[t:]) / n for t in range(n)] for c in x])
    mean_var = acov[:, 0].mean() * n / (n - 1)
    var_plus = mean_var * (n - 1) / n + np.var(x.mean(axis=1), ddof=1)
    rho = 1 - (mean_var - acov.mean(axis=0)) / var_plus
    rho[0] = 1
    total, low, k = 0.0, np.inf, 0
    while 2 * k < n - 5 and rho[2 * k] + rho[2 * k + 1] > 0:
        low = min(low, rho[2 * k] + rho[2 * k + 1])
        total, k = total + low, k + 1
    if rho[2 * k] > 0 or rho[2 * k] + rho[2 * k + 1] >= 0:
        last = rho[2 * k]
    else:
        last = 0.0
    return m * n / max(-1 + 2 * total + last, 1 / np.log10(m * n))


def test_qnorm_matches_reference(spark):
    ps = [1e-12, 0.01, 0.3, 0.5, 0.8, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    a = [r[0] for r in df.select(qnorm("p")).collect()]
    b = [r[0] for r in with_qnorm(df, F.col("p"), "z").select("z").collect()]
    exp = [NormalDist().inv_cdf(p) for p in ps]
    assert a == exp and b == exp


def test_split_drops_middle_of_odd_chain(spark, chains):
    df, arr = chains
    s = D.split_chains(df)
    assert s.count() == 4 * 300 and s.where("iteration = 151").count() == 0
    assert s.select("split_chain").distinct().count() == 8


def test_rhat_split_and_rank(spark, chains):
    df, arr = chains
    sp = _split(arr)
    assert np.isclose(D.rhat_split(df).first().rhat, _rhat_basic(sp), rtol=1e-12)
    folded = _split(np.abs(arr - np.median(arr)))
    exp = max(_rhat_basic(_zscale(sp)), _rhat_basic(_zscale(folded)))
    assert np.isclose(D.rhat_rank(df).first().rhat, exp, rtol=1e-10)


def test_ess_bulk_matches_direct_sums(spark, chains):
    df, arr = chains
    exp = _ess(_zscale(_split(arr)))
    got = D.ess_bulk(df).first().ess_bulk
    assert np.isclose(got, exp, rtol=1e-8)


def _frame(spark, arr):
    return spark.createDataFrame([("d", "p", c, i + 1, float(v)) for c, row in enumerate(arr) for i, v in enumerate(row)],
                                 "dataset string, parameter string, chain int, iteration long, value double")


def test_fold_comes_before_the_split(spark):
    arr = np.arange(36.0).reshape(4, 9) % 7
    arr[:, 4] = 1000.0                                  # the middle draw, which the split drops
    sp = _split(arr)
    exp = max(_rhat_basic(_zscale(sp)), _rhat_basic(_zscale(_split(np.abs(arr - np.median(arr))))))
    assert np.isclose(D.rhat_rank(_frame(spark, arr)).first().rhat, exp, rtol=1e-10)


def test_ess_of_known_processes(spark):
    rng = np.random.default_rng(11)
    n, m = 4000, 4
    for phi, low, high in ((0.0, 0.85, 1.15), (0.8, 0.6, 1.6), (-0.6, 0.6, 2.0)):
        arr = np.stack([_ar1(rng, n, phi) for _ in range(m)])
        got = D.ess_bulk(_frame(spark, arr)).first().ess_bulk / (m * n)
        assert low < got / ((1 - phi) / (1 + phi)) < high


@pytest.mark.parametrize("lags, block", [(2, 8), (16, 16), (512, 64)])
def test_blocks_and_doubling_lags_change_nothing(spark, chains, lags, block):
    df, arr = chains
    exp = _ess(_split(arr))
    got = D.ess_of(D.split_chains(df), ["dataset", "parameter"], "value", first_lags=lags, block=block).first().ess
    assert np.isclose(got, exp, rtol=1e-8)


def test_slow_chains_need_many_blocks_of_fixed_size(spark, monkeypatch):
    from reefline.operators import autocovariance as AC

    rng = np.random.default_rng(2)
    slow = np.stack([_ar1(rng, 500, 0.95) + 40.0 * c for c in range(4)])          # pair sums stay positive to the end
    fast = rng.normal(size=(4, 500))
    rows = [(k, c, i + 1, float(v)) for k, arr in (("slow", slow), (None, fast)) for c, row in enumerate(arr) for i, v in enumerate(row)]
    df = spark.createDataFrame(rows, "parameter string, chain int, iteration long, value double")
    distances, sizes = [], []
    pair_sums, in_blocks = AC.pair_sums, AC.in_blocks
    monkeypatch.setattr(AC, "pair_sums", lambda *a, **k: distances.append(a[3:5]) or pair_sums(*a, **k))

    def measured(*a):
        blocks = in_blocks(*a)
        sizes.append(blocks.agg(F.max("_len")).first()[0])
        return blocks

    monkeypatch.setattr(AC, "in_blocks", measured)
    got = {r.parameter: r.ess for r in D.ess_of(D.split_chains(df, ["parameter"]), ["parameter"], "value", first_lags=8, block=16).collect()}
    assert np.isclose(got["slow"], _ess(_split(slow)), rtol=1e-8) and np.isclose(got[None], _ess(_split(fast)), rtol=1e-8)
    assert distances == [(0, 1), (0, 1), (2, 2), (3, 4), (5, 8), (9, 16)] and sizes == [16]


def test_running_minimum_over_chunks_of_lags(spark, monkeypatch):
    from reefline.operators import autocovariance as AC

    rng = np.random.default_rng(4)
    n = 60
    rho = np.concatenate([[1.0], np.abs(rng.normal(size=n - 1))])
    rho[41] = -5.0
    monkeypatch.setattr(AC, "CHUNK", 3)
    df = spark.createDataFrame([(n, i, float(x)) for i, x in enumerate(rho)], "n long, lag long, rho double")
    pairs = rho.reshape(-1, 2).sum(axis=1)
    want = -1 + 2 * np.minimum.accumulate(pairs[:20]).sum() + rho[40]
    assert np.isclose(AC.truncated_tau(df.withColumn("g", F.lit("a")), ["g"]).first().tau, want)
    assert AC.truncated_tau(df.where("lag < 40").withColumn("g", F.lit("a")), ["g"]).count() == 0


def test_constant_and_very_short_chains_have_no_ess(spark):
    rows = [("same", c, i, 1.0) for c in range(2) for i in range(1, 9)] + [("short", c, i, float(i)) for c in range(2) for i in range(1, 3)]
    df = spark.createDataFrame(rows, "parameter string, chain int, iteration long, value double")
    got = {r.parameter: r.ess for r in D.ess_of(df, ["parameter"], "value", chain="chain").collect()}
    assert set(got) == {"same", "short"} and all(np.isnan(v) for v in got.values())


def test_equal_length_keeps_the_first_draws(spark):
    df = spark.createDataFrame([("d", "p", c, i, 1.0) for c, n in ((0, 5), (1, 3)) for i in range(1, n + 1)],
                               "dataset string, parameter string, chain int, iteration long, value double")
    assert sorted((r.chain, r.iteration) for r in D.equal_length(df).collect()) == [(c, i) for c in (0, 1) for i in (1, 2, 3)]


def test_wide_and_long_with_any_parameters(spark):
    rows = [(1, i, f"r_X[{p}.events,Intercept]", float(i)) for p in "abcdefg" for i in (1, 2)]
    df = spark.createDataFrame(rows, "chain int, iteration long, name string, value double")
    back = D.wide_to_long(D.long_to_wide(df, ["chain", "iteration"]), ["chain", "iteration"])
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())


def test_draw_summary(spark, chains):
    df, arr = chains
    r = D.draw_summary(df).first()
    v = arr.ravel()
    assert np.isclose(r.mean, v.mean()) and np.isclose(r.sd, v.std(ddof=1))
    assert np.isclose(r.median, np.median(v)) and np.isclose(r.q5, np.quantile(v, 0.05))
    assert np.isclose(r.mad, 1.4826 * np.median(np.abs(v - np.median(v))))


def test_expand_normal_moments_and_determinism(spark):
    s = spark.createDataFrame([("B", "m1", 1.5, 2.0), ("E", "m2", -3.0, 0.5)],
                              "dataset string, methods string, mean double, sd double")
    e = D.expand_normal(s, 20000, ["dataset", "methods"])
    st = {r.methods: r for r in e.groupBy("methods").agg(F.avg("random_effect").alias("m"),
                                                        F.stddev("random_effect").alias("s")).collect()}
    assert abs(st["m1"].m - 1.5) < 4 * 2.0 / np.sqrt(20000) and abs(st["m1"].s - 2.0) < 0.05
    assert abs(st["m2"].m + 3.0) < 4 * 0.5 / np.sqrt(20000)
    a = sorted(e.collect())
    b = sorted(D.expand_normal(s.repartition(3), 20000, ["dataset", "methods"]).collect())
    assert a == b
