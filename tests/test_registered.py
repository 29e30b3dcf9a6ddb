"""Registered queries beside their SQL on the smallest tables, and properties of results."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect
from checks.views import Views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the test tables")
#: The text operators are checked by tests of their own, in tests/llm.
TEXT = {name for name in queries() if name == "pipeline" or name.startswith("op")}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) - TEXT == set(oracle_sql()) - TEXT
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - TEXT | set(oracle_sql()) & TEXT))
def test_query(spark, con, name):
    frame = queries()[name](spark, FOLDER)
    good, note = compare(frame, con, oracle_sql()[name])
    assert good, note
    assert "TYPES" not in note, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_degree_day_properties(spark):
    # a day without a mean has no total and counts as `after`; it says nothing about the order
    rows = queries()["q02_bloom_table"](spark, FOLDER).where("gdd_cumulative IS NOT NULL")
    rows = rows.withColumn("year", F.year("date"))
    from pyspark.sql import Window

    upto = Window.partitionBy("station_id", "plant_id", "year").orderBy("date")
    stage = F.when(F.col("bloom_phase") == "before", 0).when(
        F.col("bloom_phase") == "blooming", 1).otherwise(2)
    checked = rows.select(
        "*", F.lag("gdd_cumulative").over(upto).alias("last_total"),
        F.lag(stage).over(upto).alias("last_stage"), stage.alias("stage"))
    assert checked.where("gdd_cumulative < last_total OR stage < last_stage").isEmpty()
    bloom = rows.where("bloom_day > 0").groupBy("station_id", "plant_id", "year").agg(
        F.count("*").alias("n"), F.max("bloom_day").alias("top"),
        F.count_distinct("bloom_day").alias("different"))
    assert bloom.where("n <> top OR n <> different").isEmpty()
    windows = queries()["w03_bloom_windows"](spark, FOLDER)
    assert windows.where("bloom_start_date > bloom_end_date").isEmpty()


def test_monthly_sums_add_up_to_the_year(spark):
    months = queries()["q09_monthly_summary"](spark, FOLDER)
    total = months.groupBy("station_id", "plant_id", "year").agg(
        F.sum("gdd_monthly").alias("sum"), F.max("gdd_max").alias("max"))
    assert total.where("abs(sum - max) > 1e-6").isEmpty()


def test_best_scene_has_the_least_score(spark):
    from bloomgrid.functions import scenes as S
    from bloomgrid.operators import scenes as sc

    linked = sc.with_links(Views(spark, FOLDER).scenes())
    nodata, cloud = S.score(F.col("nodata_pct"), F.col("cloud_cover"))
    scored = sc.in_region(sc.with_tile(linked)).select(
        "tile", F.struct(nodata.alias("n"), cloud.alias("c")).alias("score"))
    best = sc.best_per_tile(linked).select("tile", F.struct("nodata", "cloud").alias("best"))
    assert scored.join(best, "tile").where("score < best").isEmpty()
    assert best.count() == scored.select("tile").distinct().count()
