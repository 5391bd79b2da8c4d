"""Mixture curves and sweep: properties from the formulas."""

from pyspark.sql import functions as F

from reefline.operators.mixture import Rates, crossover_thresholds, mixture_curves, ratio_sweep
from reefline.sources.literals import cover_grid


def _rates():
    lit = F.lit
    return Rates(cca={"lwr": lit(2.0), "median": lit(3.0), "upr": lit(4.5)},
                 coral={"lwr": lit(5.0), "median": lit(8.0), "upr": lit(12.0)})


def test_grid_size_and_mirror(spark):
    g = cover_grid(spark)
    assert g.count() == 10001
    assert g.where(F.abs(F.col("cca_cover") + F.col("coral_cover") - 100) > 1e-9).count() == 0


def test_median_shares_sum_to_100(spark):
    out = mixture_curves(cover_grid(spark), _rates()).where("coral_cover between 1 and 99")
    bad = out.where(F.abs(F.col("g_percent_coral") + F.col("g_percent_cca") - 100) > 1e-9).count()
    assert bad == 0


def test_threshold_matches_first_match(spark):
    row = crossover_thresholds(cover_grid(spark), _rates()).first()
    cur = mixture_curves(cover_grid(spark), _rates()).select("coral_cover", "g_percent_coral").collect()
    cur.sort(key=lambda r: -r.coral_cover)                     # descending cover = the grid's row order
    first = next(r.coral_cover for r in cur if __import__("math").ceil(r.g_percent_coral) == 50)
    assert row.flat_threshold == first


def test_sweep_thresholds_fall_with_ratio(spark):
    rows = sorted(ratio_sweep(spark, _rates(), n_ratios=60).collect(), key=lambda r: r.r)
    assert len(rows) == 60 and rows[0].r == 0.01
    th = [r.threshold for r in rows if r.threshold is not None]
    assert all(a >= b for a, b in zip(th, th[1:]))


def _scan(q, n_ratios, step, of=lambda b: b):
    """Every cell of the sweep in plain doubles."""
    import math
    n = int(round(100 / step)) + 1
    out = []
    for k in range(1, n_ratios + 1):
        r, row = k / (1 / 0.01), []
        for b, (cca, coral) in {"lwr": ("lwr", "upr"), "median": ("median", "median"), "upr": ("upr", "lwr")}.items():
            best = None
            for j in range(n):
                c = 100.0 - j * step
                own = q[1][coral] * r * (c / 100)
                total = q[0][cca] * ((100.0 - c) / 100) + own
                if total != 0 and math.ceil(own / total * 100) == 50:
                    best = c
                    break
            row.append(best)
        out.append((r, *row))
    return out


def _sweep(spark, q, **options):
    rates = Rates(cca={k: F.lit(v) for k, v in q[0].items()}, coral={k: F.lit(v) for k, v in q[1].items()})
    df = ratio_sweep(spark, rates, **options)
    return sorted((r.r, r.threshold_lwr, r.threshold, r.threshold_upr) for r in df.collect()), df


def test_bisection_equals_the_scan(spark):
    q = ({"lwr": 2.0, "median": 3.0, "upr": 4.5}, {"lwr": 5.0, "median": 8.0, "upr": 12.0})
    assert _sweep(spark, q, n_ratios=40, cover_step=0.1)[0] == _scan(q, 40, 0.1)
    exact = ({"lwr": 1.0, "median": 1.0, "upr": 1.0}, {"lwr": 1.0, "median": 1.0, "upr": 1.0})       # shares of exactly 50 and 49 on the grid
    assert _sweep(spark, exact, n_ratios=120, cover_step=0.5)[0] == _scan(exact, 120, 0.5)


def test_rates_without_an_order_of_shares_are_scanned(spark):
    for bad in (0.0, -1.0):
        q = ({"lwr": bad, "median": 3.0, "upr": 4.5}, {"lwr": 5.0, "median": 8.0, "upr": 12.0})
        assert _sweep(spark, q, n_ratios=5, cover_step=0.5)[0] == _scan(q, 5, 0.5)


def test_a_fine_grid_costs_few_evaluations(spark):
    import math
    q = ({"lwr": 2.0, "median": 3.0, "upr": 4.5}, {"lwr": 5.0, "median": 8.0, "upr": 12.0})
    rows, df = _sweep(spark, q, n_ratios=3, cover_step=1e-5)
    assert len(rows) == 3 and math.ceil(math.log2(10 ** 7 + 2)) == 24
    for r, _, c, _ in rows:
        share = [8.0 * r * x / (8.0 * r * x + 3.0 * (100 - x)) * 100 for x in (c, min(c + 1e-5, 100))]
        assert share[0] <= 50 and (c == 100 or share[1] > 50 - 1e-6)
