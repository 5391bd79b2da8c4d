"""Nested survey roll-up semantics."""

from reefline.operators import survey as SV


def test_single_transect_habitat_makes_site_sd_missing(spark):
    rows = [
        (2005, "s1", "h1", "t1", "q1", 10.0), (2005, "s1", "h1", "t1", "q2", 20.0),
        (2005, "s1", "h1", "t2", "q1", 30.0),
        (2005, "s1", "h2", "t1", "q1", 50.0),                 # h2 has one transect -> sd missing
        (2005, "s2", "h1", "t1", "q1", 4.0), (2005, "s2", "h1", "t2", "q1", 8.0),
    ]
    df = spark.createDataFrame(rows, "year int, site string, habitat string, transect string, quadrat string, pc double")
    out = {r.site: r for r in SV.site_rollup(df, "pc").collect()}
    # s1: h1 transects (15, 30) -> mean 22.5, sd 10.6066; h2 -> 50, sd missing
    assert out["s1"].cover == (22.5 + 50.0) / 2 and out["s1"].sd_cover is None
    assert abs(out["s2"].sd_cover - 2.8284271247461903) < 1e-12 and out["s2"].cover == 6.0
    lax = {r.site: r for r in SV.site_rollup(df, "pc", strict=False).collect()}
    assert abs(lax["s1"].sd_cover - 10.606601717798213) < 1e-12


def test_contribution_matches_keys_not_positions(spark):
    a = spark.createDataFrame([(2005, "s1", 1.0), (2005, "s2", 3.0)], "year int, site string, cr double")
    b = spark.createDataFrame([(2005, "s2", 1.0), (2005, "s9", 5.0)], "year int, site string, cr_sc double")
    out = SV.contribution(a, b).collect()
    assert [(r.site, r.contribution) for r in out] == [("s2", 75.0)]
