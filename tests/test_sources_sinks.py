"""Sources (multi-part, positional, grid, bindings) and sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reefline.session import ensure_checkpoint_dir
from reefline.sinks import part_numbers, write_figure_data, write_parts
from reefline.sources import bindings as B
from reefline.sources.literals import grid
from reefline.sources.multipart import positional_append, union_parts
from reefline.sources.tables import RATES_SCHEMA, SURVEY_SCHEMA
from tests.conftest import SF_SMALL


def test_union_parts_drops_nulls_in_flagged_part_only(spark):
    p1 = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "x double, y string")
    p2 = spark.createDataFrame([(2.0, "c"), (None, "d"), (None, "d")], "x double, y string")
    out = sorted(union_parts([p1, p2], ["x", "y"], [True, False], {"x": 10}).collect(), key=str)
    assert out == sorted([(10.0, "a"), (20.0, "c"), (None, "d")], key=str)


def test_positional_append_renames_and_casts(spark):
    base = spark.createDataFrame([(1, "r")], "k int, name string")
    extra = spark.createDataFrame([(7, "n", 99)], "a bigint, b string, c int")
    out = positional_append(base, extra)
    assert out.columns == ["k", "name"] and out.schema["k"].dataType.simpleString() == "int"
    assert sorted(out.collect()) == [(1, "r"), (7, "n")]


def test_grid_is_exact_multiples(spark):
    g = grid(spark, 0.0, 100.0, 0.01)
    assert g.count() == 10001
    assert g.where(F.col("x") != F.col("i") * 0.01).count() == 0


def test_bindings_cover_the_vocabulary(spark):
    r = B.study_rates(spark, SF_SMALL)
    assert r.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert r.where(F.col("unit").isNull()).count() > 0           # a missing unit exists
    assert r.where(F.col("climate") == "NA").count() > 0          # the text sentinel exists
    d = B.draws(spark, SF_SMALL)
    lens = d.groupBy("dataset", "parameter", "chain").agg(F.max("iteration").alias("m"), F.count("*").alias("n"))
    assert lens.where(F.col("m") != F.col("n")).count() == 0      # iterations are 1..N
    assert d.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()      # every event is a draw


def test_sinks_write_and_number_parts(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    numbered = {r.k: r.part for r in part_numbers(df, "k").select("k", "part").distinct().collect()}
    assert numbered == {"a": 1, "b": 2, None: 3}
    root = tempfile.mkdtemp(prefix="reefline-sink-")
    path = write_parts(df, "k", f"{root}/parts")
    assert spark.read.parquet(path).where("k = 'b'").count() == 2
    fig = write_figure_data(df, "fig", path=f"{root}/fig")
    assert spark.read.parquet(fig).count() == 4
    ordered = write_figure_data(spark.range(1000).repartition(7), "fig", path=f"{root}/ordered", fmt="csv", order=["id"])
    files = sorted(p for p in os.listdir(ordered) if p.startswith("part-"))
    assert [int(x) for p in files for x in open(f"{ordered}/{p}").read().split()] == list(range(1000))


def test_cut_lineage_and_drop_intermediate_tables(spark):
    import os

    from reefline.session import cut_lineage, drop_intermediate_tables, intermediate_root
    sc = spark.sparkContext
    old = sc.getCheckpointDir()
    own = tempfile.mkdtemp(prefix="reefline-ckpt-own-")
    sc.setCheckpointDir(own)
    try:
        t = cut_lineage(spark.range(10).withColumn("p", F.col("id") % 2), partition_by=["p"])
        assert t.columns == ["id", "p"] and t.count() == 10
        root = intermediate_root(spark)
        assert root.startswith(sc.getCheckpointDir()) and os.listdir(root.replace("file:", ""))
        assert drop_intermediate_tables(spark) and not os.path.exists(root.replace("file:", ""))
    finally:
        if old:
            sc.setCheckpointDir(old)


def test_loaders_read_parquet_and_csv_with_their_schema(spark, tmp_path):
    from reefline.sources import tables as T

    rates = B.study_rates(spark, SF_SMALL).withColumn("row_ordinal", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rates = rates.select(*[F.col(f.name).cast(f.dataType) for f in T.RATES_SCHEMA.fields]).where("row_ordinal < 3000")
    survey = spark.createDataFrame([], T.SURVEY_SCHEMA)
    draws = B.draws(spark, SF_SMALL).where("iteration <= 10")
    for name, df, load in (("rates", rates, T.load_rates), ("survey", survey, T.load_survey), ("draws", draws, T.load_draws)):
        df.write.parquet(str(tmp_path / name))
        back = load(spark, str(tmp_path / name))
        assert back.dtypes == df.dtypes and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    draws.coalesce(1).write.option("header", "true").csv(str(tmp_path / "csv"))
    back = T.load_draws(spark, str(tmp_path / "csv"), "csv")
    assert sorted(back.collect()) == sorted(draws.collect())


def test_no_folder_of_one_machine_off_local_mode(monkeypatch):
    import pytest

    from reefline import session

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(Session())


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A query with Python stages runs from another folder, where workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as E; from reefline.session import get_session; "
            f"s = get_session('local[2]', 4); assert E.queries()['draw_ess'](s, {SF_SMALL!r}).count() == 5")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300, capture_output=True)


def test_parts_are_rebalanced_by_size(spark):
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/rebalanced"
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:      # a hot part in 20 tasks, and twenty parts of ten rows that are in every task
        df = spark.range(0, 200_000, 1, 20).selectExpr("if(id % 1000 = 7, concat('k', id div 1000 % 20), 'hot') as k", "id", "hash(id) as v")
        path = write_parts(df, "k", root)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(path)
    files = [r[0] for r in back.select(F.input_file_name()).distinct().collect()]
    hot = [f for f in files if "/k=hot/" in f]
    small = len(files) - len(hot)
    assert back.count() == 200_000 and 2 <= len(hot) <= 20 and small <= 20 + 2 * len(hot)


def test_rows_that_do_not_fit_the_schema_are_kept_apart(spark, tmp_path):
    from reefline.sources.tables import read_checked

    lines = ["year,site,habitat,transect,quadrat,functional_group,percent_cover", "2005,a,b,c,d,Coral,1.5", "2005,a,b", "2005,a,b,c,d,Coral,1.5,more",
             "x,a,b,c,d,Coral,1.5", "2006,a,b,c,d,Coral,many", "2007,,,,,,"]
    (tmp_path / "survey.csv").write_text("\n".join(lines) + "\n")
    got = read_checked(spark, str(tmp_path / "survey.csv"), SURVEY_SCHEMA)
    assert (got.n_rows, got.n_rejected) == (2, 4)
    assert sorted(r.year for r in got.rows.collect()) == [2005, 2007] and got.rows.columns == SURVEY_SCHEMA.names
    assert sorted(r.record for r in got.rejected.collect()) == sorted(lines[i] for i in (2, 3, 4, 5))
    with pytest.raises(ValueError, match="4 of 6 rows"):
        read_checked(spark, str(tmp_path / "survey.csv"), SURVEY_SCHEMA, most_rejected=0.5)
    none = "row_ordinal,paper_name,method,unit,rate,error,species,climate,temperature\n,P,TA,u,1,2,s,c,3\n4,P,TA,u,1,2,s,c,3\n"
    (tmp_path / "rates.csv").write_text(none)
    rates = read_checked(spark, str(tmp_path / "rates.csv"), RATES_SCHEMA)
    assert [r.row_ordinal for r in rates.rows.collect()] == [4] and rates.n_rejected == 1
