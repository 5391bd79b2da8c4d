"""Property tests (hypothesis): membership partitions rows, conversion is linear,
branch tags partition the rates table."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reefline import fixed_values as fv
from reefline.functions import convert, is_in, not_in
from reefline.plans import review as RV
from reefline.sources import bindings as B
from tests.conftest import SF_SMALL

WORDS = st.sampled_from(["a", "b", "c", "Tropical", None])


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(WORDS, min_size=1, max_size=12), members=st.lists(WORDS, min_size=1, max_size=4))
def test_in_and_not_in_partition_rows(spark, rows, members):
    df = spark.createDataFrame([(v,) for v in rows], "x string")
    got_in = df.where(is_in("x", members)).count()
    got_out = df.where(not_in("x", members)).count()
    exp_in = sum(1 for v in rows if v in members)         # Python: None in [None] is True, like the study
    assert (got_in, got_out) == (exp_in, len(rows) - exp_in)


UNITS = [u for u, _ in fv.BIOMASS_RATE_RULES] + ["no rule", None]


@settings(max_examples=10, deadline=None)
@given(data=st.lists(st.tuples(st.sampled_from(UNITS), st.integers(-50, 50)), min_size=1, max_size=10),
       k=st.integers(-5, 5))
def test_conversion_is_linear(spark, data, k):
    df = spark.createDataFrame([(u, float(r)) for u, r in data], "unit string, rate double")
    out = df.select(convert("rate", "unit", fv.BIOMASS_RATE_RULES).alias("a"),
                    convert(F.col("rate") * k, "unit", fv.BIOMASS_RATE_RULES).alias("b")).collect()
    for row in out:
        if row.a is None:
            assert row.b is None
        else:
            assert math.isclose(row.b, k * row.a, rel_tol=1e-12, abs_tol=1e-12)


def test_branch_tags_partition_the_table(spark):
    p = RV.prepare(B.study_rates(spark, SF_SMALL))
    counts = {r.branch: r.n for r in p.groupBy("branch").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == p.count() and set(counts) <= {"biomass", "volume", "surface", "extension", "none"}
    # the branch tag agrees with each branch's own unit filter
    assert p.where((F.col("branch") == "biomass") != is_in("unit", fv.BIOMASS_UNITS)).count() == 0
    assert p.where((F.col("branch") == "surface") != is_in("unit", fv.SURFACE_UNITS)).count() == 0


def test_growth_row_count_is_the_sum_of_its_parts(spark):
    from reefline.functions.predicates import nonnegative
    rates = B.study_rates(spark, SF_SMALL)
    routed = RV.route_rates(rates, B.LINEITEM_ORDER)
    rescued = RV.rescue_incomplete(routed)
    extra = B.extra_rates(spark, SF_SMALL)
    biom = routed.kept(RV.BIOMASS, RV.VOLUME).select("rate_std").unionByName(rescued.where("rate_biom is not null").select(F.col("rate_biom").alias("rate_std")))
    others = rescued.where("rate_surf is not null").count() + rescued.where("rate_ext is not null").count()
    expected = biom.where(nonnegative("rate_std")).count() + routed.kept(RV.SURFACE, RV.EXTENSION).count() + others + extra.count()
    assert routed.rows.count() == RV.prepare(rates).count()             # every prepared row once
    g = RV.growth(rates, B.LINEITEM_ORDER, extra=extra)
    assert g.count() == expected > 0
