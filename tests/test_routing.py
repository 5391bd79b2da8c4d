"""The row router against a plain restatement of its rules, the study audit, positional corrections and written tables."""

import pytest
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.operators.routing import Branch, branch_name, routed, to_targets
from reefline.plans import review as RV

COLUMNS = "paper_name string, method string, unit string, rate double, error string, species string, climate string, temperature double, row_ordinal long"


def _rates(spark, rows):
    base = {"paper_name": "P", "method": "TA", "unit": "mm_year", "rate": 1.0, "error": "0.5", "species": "Aus bus", "climate": "Tropical", "temperature": 20.0}
    return spark.createDataFrame([tuple({**base, **r}.values()) + (i,) for i, r in enumerate(rows)], COLUMNS)


BRANCHES = [
    Branch("a", units=["x", "wet x", "y"], spellings=["y"], unit="x", rules=[("x", 2.0), ("x", 9.0)], rejects="wet", divided=(["slow"], 4), excluded=["bad"],
           nonnegative=True, patches=[("climate", "First", ["slow"]), ("climate", "Last", ["slow"])]),
    Branch("b", units=["x", "v"], rules=[("v", 3.0)], family="Fixed", keeps=lambda: F.col("rate") != 7, early=[("species", "Cus dus", ["slow"])]),
    Branch("c", rules=[("m", 10.0)], takes=lambda: F.coalesce(F.col("unit") != "%", F.lit(False)))]


def test_rules_of_each_branch(spark):
    rows = [("x", 1.0, "p"), ("wet x", 1.0, "p"), ("y", 1.0, "slow"), ("x", -1.0, "p"), ("x", None, "p"), ("x", 1.0, "bad"), ("x", 1.0, None),
            ("v", -1.0, "slow"), ("v", 7.0, "p"), ("m", 1.0, None), ("other", 1.0, "p"), ("%", 1.0, "p"), (None, 1.0, "p")]
    df = spark.createDataFrame([(i, u, r, k, "Aus bus cus", "T", "NA", "NA") for i, (u, r, k) in enumerate(rows)],
                               "i int, unit string, rate double, paper_name string, species string, method string, method_family string, climate string")
    got = {r.i: (r.branch, r.unit, r.rate_std, r.method_family, r.climate, r.genus, r.species) for r in routed(df, BRANCHES).collect()}

    def spare(unit):
        return ("none", unit, None, "NA", "NA", None, "Aus bus cus")

    assert got[0] == ("a", "x", 2.0, None, None, "Aus", "Aus_bus")
    assert got[2] == ("a", "x", 0.5, None, "Last", "Aus", "Aus_bus")
    assert got[7] == ("b", "v", -3.0, "Fixed", "NA", "Cus", "Cus_dus")
    assert got[9] == ("c", "m", 10.0, None, None, "Aus", "Aus_bus") and got[10] == ("c", "other", None, None, None, "Aus", "Aus_bus")
    assert all(got[i] == spare(rows[i][0]) for i in (1, 3, 4, 5, 6, 8, 11, 12))
    names = {r.i: r.at for r in branch_name(df, BRANCHES, "at", "none").collect()}
    assert [names[i] for i in range(len(rows))] == ["a"] * 7 + ["b"] * 2 + ["c"] * 2 + ["none"] * 2


def test_constants_are_evaluated_when_planning_and_rows_once(spark):
    df = spark.createDataFrame([("x", 1.0, "p", "a b", "T", "F", "C")],
                               "unit string, rate double, paper_name string, species string, method string, method_family string, climate string")
    plan = routed(df, BRANCHES).where("branch = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan.lower() and "Join" not in plan and plan.count("Generate") == 1


def test_rows_go_to_every_target_they_have(spark):
    df = spark.createDataFrame([("r1", 1.0, None), ("r2", 2.0, 3.0), ("r3", None, None)], "k string, a double, b double")
    assert sorted(to_targets(df, {"a": "A", "b": "B"}, "at", "v").collect()) == [("r1", "A", 1.0), ("r2", "A", 2.0), ("r2", "B", 3.0)]


@pytest.fixture()
def written(monkeypatch):
    calls = []
    cut = RV.cut_lineage
    monkeypatch.setattr(RV, "cut_lineage", lambda df, **k: calls.append(df) or cut(df, **k))
    return calls


def test_growth_writes_two_tables_and_reads_rates_once(spark, written):
    rates = _rates(spark, [{"unit": u} for u in fv.BIOMASS_UNITS[:3] + fv.SURFACE_UNITS[:3] + [fv.VOLUME_UNIT, "mm/day"]])
    g = RV.growth(rates, ["row_ordinal"])
    assert g.count() == 8 and len(written) == 2
    assert "row_ordinal" not in g._jdf.queryExecution().optimizedPlan().toString()          # the result reads the written tables


def test_positional_corrections_by_order(spark):
    surface, values = fv.SURFACE_POSITIONAL
    study, errors = fv.RESCUE_POSITIONAL
    unit = next(u for u, _ in fv.SURFACE_RATE_RULES if u in fv.SURFACE_UNITS)
    rows = [{"paper_name": surface, "unit": unit, "species": "Hyd onk"} for _ in range(5)]
    rows += [{"paper_name": surface, "unit": unit, "species": "CCA"}]                      # not a row of the branch: keeps its values
    rows += [{"paper_name": study, "unit": None, "method": None, "error": "x"} for _ in range(4)]
    rows += [{"paper_name": study, "unit": None, "method": None, "temperature": fv.RESCUE_TEMPERATURE_EXCLUDED}]
    rates = _rates(spark, rows).repartition(4)
    r = RV.route_rates(rates, ["row_ordinal"])
    kept = sorted((x.rate, float(x.error)) for x in r.kept(RV.SURFACE).collect())
    assert kept == sorted((values["rate"][i % 2], values["error"][i % 2]) for i in range(5))
    assert [x.rate for x in r.rows.where("species = 'CCA'").collect()] == [1.0]
    rescued = RV.rescue_incomplete(r).select("error", "unit", "method_family").collect()
    assert sorted(float(x.error) for x in rescued) == sorted(errors["error"][i % 3] for i in range(4))


def test_a_study_that_a_branch_uses_is_not_rescued(spark):
    study, _ = fv.RESCUE_POSITIONAL
    rows = [{"paper_name": study, "unit": None, "method": None, "error": "x"}, {"paper_name": study, "unit": "mm/day", "method": None, "error": "0.25"},
            {"paper_name": "Q", "unit": None, "method": None}, {"paper_name": None, "unit": None, "method": None}, {"paper_name": "R", "unit": None, "method": "TA"}]
    r = RV.route_rates(_rates(spark, rows), ["row_ordinal"])
    audit = {a.paper_name: (a.branches, a.no_method) for a in RV.study_audit(r).collect()}
    assert audit == {study: (8, True), "Q": (0, True), None: (0, True), "R": (0, False)}
    assert {x.paper_name for x in RV.incomplete_studies(r).collect()} == {"Q", None}
    assert [x.error for x in r.kept(RV.EXTENSION).collect()] == ["0.25"]                     # the correction is for rescued rows
    plan = RV.study_audit(r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [paper_name") == 1 and "LeftAnti" not in plan


def test_rules_and_joins_are_not_one_stage(spark):
    """Fused with the joins below them, the rules make a method that the JVM does not compile."""
    import re

    from reefline.plans import review as RV
    from reefline.sources import bindings as B

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for harmonise in (RV.harmonise_extension, RV.harmonise_biomass_and_volume):
            df = harmonise(RV.prepare(B.study_rates(spark, "/root/testdata/sf0.001").select(*RV.RATE_COLUMNS)))
            plan = df._jdf.queryExecution().executedPlan().toString()
            stages = [set(re.findall(rf"\*\((\d+)\) {node}", plan)) for node in (r"\w*Join\b", "Generate inline")]
            assert stages[0] and stages[1] and not stages[0] & stages[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
