"""Cleaning operators: vocabularies, conversions, patches."""

import math

from reefline import fixed_values as fv
from reefline.operators import cleaning as C


def test_conversion_factors_match_chained_arithmetic():
    # each factor is the product of the unit constants; chained evaluation differs by ulps only
    f = dict(fv.BIOMASS_RATE_RULES)
    rate = 3.7
    chained = rate / fv.MOLAR_MASS_CACO3 / fv.G_TO_MG / fv.DAY_TO_HOUR * fv.MOL_TO_UMOL
    assert math.isclose(rate * f["mgCaCO3 g-1 d-1"], chained, rel_tol=1e-14)
    s = dict(fv.SURFACE_RATE_RULES)
    assert math.isclose(s["µmol CaCO3/cm2/h"], 2.4024, rel_tol=1e-14)
    assert math.isclose(dict(fv.EXTENSION_RATE_RULES)["µm/day"], 0.36525, rel_tol=1e-14)
    # rescued mg/cm-2/year is not divided by 365.25 (kept as in the study)
    assert dict(fv.RESCUE_SURFACE_RULES)["mg/cm-2/year"] == 1.0


def test_byte_exact_spellings():
    assert "umol C h -1 g -1\x02" in fv.BIOMASS_UNITS
    assert any("μ" in u for u in fv.BIOMASS_UNITS) and any("µ" in u for u in fv.BIOMASS_UNITS)
    assert "mg g–1 d–1)" in fv.BIOMASS_UNITS


def test_classify_and_drop_methods(spark):
    df = spark.createDataFrame([("TA",), ("alizarin red",), (None,), ("Photo",), ("other",)], "method string")
    out = {r.method: r.method_family for r in C.classify_methods(df).collect()}
    assert out == {"TA": "TA anomaly", "alizarin red": "Staining", "NA": "NA", "other": "NA"}


def test_convert_units_null_without_rule(spark):
    df = spark.createDataFrame([("µmolC/g day", 48.0), ("unknown", 1.0), (None, 2.0)], "unit string, rate double")
    out = [r.r for r in C.convert_units(df, fv.BIOMASS_RATE_RULES, "r").collect()]
    assert out == [2.0, None, None]


def test_error_rules_missing_for_four_units(spark):
    df = spark.createDataFrame([("g CaCO3/g/h", "0.5"), ("umol_g_h", "0.5"), ("umol_g_h", "n/a")], "unit string, error string")
    out = [r.std_error for r in C.convert_error(df).collect()]
    assert out == [None, 0.5, None]


def test_patch_positional_recycles_and_leaves_others(spark):
    rows = [("P", i, 0.0) for i in range(5)] + [("Q", 0, 9.0)]
    df = spark.createDataFrame(rows, "paper_name string, o int, rate double")
    out = C.patch_positional(df, "P", {"rate": [1.0, 2.0]}, ["o"])
    got = sorted((r.paper_name, r.o, r.rate) for r in out.collect())
    assert got == [("P", 0, 1.0), ("P", 1, 2.0), ("P", 2, 1.0), ("P", 3, 2.0), ("P", 4, 1.0), ("Q", 0, 9.0)]


def test_patch_values_in_order_last_wins(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "y"), (None, "z")], "paper_name string, climate string")
    out = C.patch_values(df, [("climate", "c1", ["A", "B"]), ("climate", "c2", ["B"])])
    assert {r.paper_name: r.climate for r in out.collect()} == {"A": "c1", "B": "c2", None: "z"}


def test_taxon(spark):
    df = spark.createDataFrame([("Hydrolithon onkodes",), ("Amphiroa",)], "species string")
    out = [(r.genus, r.species) for r in C.add_taxon(df).collect()]
    assert out == [("Hydrolithon", "Hydrolithon_onkodes"), ("Amphiroa", "Amphiroa_NA")]


def test_patch_positional_expects_a_number_of_rows(spark):
    import pytest

    df = spark.createDataFrame([(k, i, 0.0) for i, k in enumerate("PPQQRRR")], "paper_name string, o int, rate double")
    for key, n in (("P", 2), ("Q", 2), ("R", 3)):
        out = C.patch_positional(df, key, {"rate": [1.0, 2.0, 3.0][:n]}, ["o"], expected=n)
        assert out.count() == 7 and sorted(r.rate for r in out.where(f"paper_name = '{key}'").collect()) == [1.0, 2.0, 3.0][:n]
    with pytest.raises(Exception, match="P: 3 rows expected, found 2"):
        C.patch_positional(df, "P", {"rate": [1.0, 2.0, 3.0]}, ["o"], expected=3).collect()
    with pytest.raises(Exception, match="Z: 1 rows expected, found 0"):
        C.patch_positional(df, "Z", {"rate": [1.0]}, ["o"], expected=1).collect()
