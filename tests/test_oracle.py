"""Registered queries against their DuckDB oracle on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, digest

FAST = ["harmonise_biomass", "harmonise_surface", "rescue_incomplete", "growth_table", "quantile_summary",
        "group_quantiles_ranked", "box_stats", "crosstab_long", "ratio_sweep", "survey_rollup", "contribution",
        "draw_summary", "rhat_rank", "review_panels", "param_long", "draw_ess", "effect_summary", "effect_samples",
        "cell_statistics", "group_mean_sd_extension", "crosstab_long_surface", "box_stats_extension"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_name_match_and_most_have_oracles():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert not [n for n in q if n not in o and not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns)[0] == digest(drows, dcols)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "genus" in df.columns
