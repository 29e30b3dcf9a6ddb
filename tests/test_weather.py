"""Daily temperatures, degree days and windows on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomgrid.operators import gdd as gd
from bloomgrid.operators import weather
from bloomgrid.plans import weather as plans

D = dt.date
WILLOW = [("salix_caprea", "Wierzba iwa", "Salix caprea", 5.0, 100.0, 200.0, "wiosna")]
PLANT_SCHEMA = (
    "id STRING, name_pl STRING, name_latin STRING, base_temp_c DOUBLE, gdd_min DOUBLE, "
    "gdd_max DOUBLE, season STRING"
)
DAILY_SCHEMA = "station_id STRING, date DATE, t_min DOUBLE, t_max DOUBLE, t_mean DOUBLE"


@pytest.fixture
def plants(spark):
    return spark.createDataFrame(WILLOW, PLANT_SCHEMA)


def days(spark, rows):
    return spark.createDataFrame(
        [(s, d, t, t, t) for s, d, t in rows], DAILY_SCHEMA
    )


def run(start, means):
    return [("A", start + dt.timedelta(days=i), t) for i, t in enumerate(means)]


def table(spark, plants, rows):
    return gd.gdd_table(days(spark, rows), plants).orderBy("station_id", "date").collect()


def test_daily_extremes_skip_missing_values_and_keys(spark):
    readings = spark.createDataFrame([
        ("A", "2024-01-01T00:00:00Z", 0.25), ("A", "2024-01-01T12:00:00Z", 0.0),
        ("A", "2024-01-01T13:00:00Z", float("nan")), ("A", "2024-01-01T14:00:00Z", None),
        ("A", "2024-01-02T00:00:00Z", float("nan")), (None, "2024-01-01T00:00:00Z", 9.0),
        ("A", None, 9.0),
    ], "station_id STRING, measured_at STRING, air_temperature DOUBLE")
    rows = {r["date"]: tuple(r)[2:] for r in weather.daily_extremes(readings).collect()}
    assert rows == {D(2024, 1, 1): (0.0, 0.25, 0.12), D(2024, 1, 2): (None, None, None)}


def test_extraction_plan_ends_on_the_last_day(spark):
    stations = spark.createDataFrame([("B",), ("A",), ("A",)], "station_id STRING")
    rows = weather.extraction_plan(stations, D(2024, 1, 1), D(2025, 12, 31)).where(
        "station_id = 'A'").orderBy("chunk_start").collect()
    assert len(rows) == 9
    assert (rows[0]["chunk_start"], rows[0]["chunk_end"]) == (D(2024, 1, 1), D(2024, 3, 30))
    assert (rows[-1]["chunk_start"], rows[-1]["chunk_end"]) == (D(2025, 12, 21), D(2025, 12, 31))
    assert rows[0]["after"] == "2024-01-01T00:00:00Z"
    assert rows[-1]["before"] == "2025-12-31T23:59:59Z"


def test_keep_last_prefers_new_then_the_later_old_row(spark):
    schema = DAILY_SCHEMA + ", position LONG"
    old = spark.createDataFrame([
        ("A", D(2024, 1, 1), 1.0, 1.0, 1.0, 1), ("A", D(2024, 1, 1), 2.0, 2.0, 2.0, 2),
        ("A", D(2024, 1, 2), 3.0, 3.0, 3.0, 3), ("A", D(2024, 1, 2), None, 4.0, 4.0, 4),
    ], schema)
    new = spark.createDataFrame([("A", D(2024, 1, 1), 3.0, 3.0, 3.0)], DAILY_SCHEMA)
    merged = weather.keep_last(old, new)
    rows = {r["date"]: tuple(r)[2:] for r in merged.collect()}
    assert rows == {D(2024, 1, 1): (3.0, 3.0, 3.0), D(2024, 1, 2): (None, 4.0, 4.0)}
    again = weather.keep_last(merged.withColumn("position", F.lit(1)), new)
    assert {r["date"]: tuple(r)[2:] for r in again.collect()} == rows


def test_thresholds_are_three_different_rules(spark, plants):
    # cumulative 99.99, 100.0, 100.01, 200.0, 200.01
    rows = table(spark, plants, run(D(2025, 3, 1), [104.99, 5.01, 5.01, 104.99, 5.01]))
    assert [r["gdd_cumulative"] for r in rows] == [99.99, 100.0, 100.01, 200.0, 200.01]
    assert [r["bloom_phase"] for r in rows] == [
        "before", "blooming", "blooming", "blooming", "after"]
    assert [r["bloom_day"] for r in rows] == [0, 0, 1, 2, 0]
    daily = days(spark, run(D(2025, 3, 1), [104.99, 5.01, 5.01, 104.99, 5.01]))
    window = plans.bloom_windows(daily, plants).first()
    assert (window["bloom_start_date"], window["bloom_end_date"]) == (D(2025, 3, 2), D(2025, 3, 5))


def test_missing_day_keeps_the_sum_and_counts_as_after(spark, plants):
    rows = table(spark, plants, run(D(2025, 3, 1), [15.0, None, 15.0]))
    assert [r["gdd_daily"] for r in rows] == [10.0, None, 10.0]
    assert [r["gdd_cumulative"] for r in rows] == [10.0, None, 20.0]
    assert [r["bloom_phase"] for r in rows] == ["before", "after", "before"]


def test_sum_restarts_with_the_year(spark, plants):
    rows = table(spark, plants, run(D(2024, 12, 30), [15.0, 15.0, 15.0, 4.0]))
    assert [r["gdd_cumulative"] for r in rows] == [10.0, 20.0, 10.0, 10.0]


def test_bloom_days_count_rows_not_calendar_days(spark, plants):
    rows = [("A", D(2025, 3, 1), 110.0), ("A", D(2025, 3, 9), 15.0), ("A", D(2025, 4, 1), None),
            ("A", D(2025, 4, 20), 15.0)]
    assert [r["bloom_day"] for r in table(spark, plants, rows)] == [1, 2, 0, 3]


def test_windows_fall_back_to_the_latest_complete_year(spark, plants):
    rows = run(D(2023, 3, 1), [155.0, 155.0]) + run(D(2024, 3, 1), [155.0, 155.0])
    rows += run(D(2025, 3, 1), [155.0])
    cold = [("B", D(2025, 3, 1), 2.0)]
    daily = days(spark, rows + cold)
    windows = {r["station_id"]: r for r in plans.bloom_windows(daily, plants).collect()}
    assert list(windows) == ["A"]
    assert (windows["A"]["year"], windows["A"]["bloom_start_date"]) == (2024, D(2024, 3, 1))

    zones = spark.createDataFrame(
        [(1, "A"), (2, "A"), (3, "B")], "cell_id INT, station_id STRING")
    zoned = plans.zones_with_bloom(
        zones, plans.bloom_windows(daily, plants), plants, "salix_caprea")
    texts = {r["cell_id"]: r["bloom_tooltip"] for r in zoned.collect()}
    assert texts == {
        1: "Wierzba iwa: od 2024-03-01 do 2024-03-02",
        2: "Wierzba iwa: od 2024-03-01 do 2024-03-02",
        3: "Wierzba iwa: brak danych",
    }


def test_stored_table_gives_the_same_windows(spark, plants):
    daily = days(spark, run(D(2024, 3, 1), [60.0] * 8))
    direct = plans.bloom_windows(daily, plants).collect()
    stored = gd.gdd_table(daily, plants).drop("t_min", "t_max", "t_mean")
    assert plans.stored_windows(stored, plants).select(*direct[0].__fields__).collect() == direct


def test_plants_take_default_terms_and_plantings_limit_pairs(spark):
    plants = spark.createDataFrame(
        [("x", "X", "x", None, None, None, None), ("y", "Y", "y", 10.0, 1.0, 2.0, None)],
        PLANT_SCHEMA)
    daily = days(spark, [("A", D(2024, 1, 1), 15.0), ("B", D(2024, 1, 1), 15.0)])
    every = {(r["station_id"], r["plant_id"]): r["gdd_daily"]
             for r in gd.gdd_table(daily, plants).collect()}
    assert every == {("A", "x"): 10.0, ("A", "y"): 5.0, ("B", "x"): 10.0, ("B", "y"): 5.0}
    plantings = spark.createDataFrame([("A", "y"), ("A", "y"), ("B", "x")],
                                      "station_id STRING, plant_id STRING")
    some = {(r["station_id"], r["plant_id"]): r["gdd_daily"]
            for r in gd.gdd_table(daily, plants, plantings).collect()}
    assert some == {("A", "y"): 5.0, ("B", "x"): 10.0}


def test_a_large_dictionary_is_answered(spark, plants, monkeypatch):
    monkeypatch.setattr(gd, "PLANTS_PER_BLOCK", 7)
    many = spark.range(50).select(
        F.concat(F.lit("p"), "id").alias("id"), F.lit("n").alias("name_pl"),
        F.lit("l").alias("name_latin"), F.lit(5.0).alias("base_temp_c"),
        F.lit(1.0).alias("gdd_min"), F.lit(2.0).alias("gdd_max"),
        F.lit(None).cast("string").alias("season"))
    daily = days(spark, [("A", D(2024, 1, 1), 15.0)])
    rows = gd.gdd_table(daily, many).collect()
    assert len({r["plant_id"] for r in rows}) == len(rows) == 50


def test_degree_days_shuffle_daily_rows_once_before_plants(spark, plants):
    daily = days(spark, run(D(2024, 3, 1), [60.0] * 8))
    yearly = gd.yearly_windows(gd.growing_degree_days(daily, F.broadcast(plants)))
    plan = yearly._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(station_id") == 1
    assert "SortMergeJoin" not in plan


def test_monthly_totals_fall_back_only_when_nothing_is_stored(spark):
    months = spark.createDataFrame([
        ("A", 2024, "p", 1, 5.0, None), ("A", 2024, "p", 2, None, None),
        ("A", 2024, "p", 3, 7.0, None), ("B", 2024, "p", 1, 5.0, None),
        ("B", 2024, "p", 2, 3.0, 8.0),
    ], "station_id STRING, year INT, plant_id STRING, month INT, gdd_monthly DOUBLE, "
       "gdd_cumulative DOUBLE")
    rows = gd.monthly_totals(months).orderBy("station_id", "month").collect()
    assert [r["gdd_cumulative"] for r in rows] == [5.0, 5.0, 12.0, None, 8.0]


def test_frames_and_preview(spark, plants):
    daily = days(spark, run(D(2025, 3, 1), [105.0] * 2) + [("B", D(2025, 3, 1), 110.0)])
    gdd = gd.gdd_table(daily, plants)
    frames = plans.animation_frames(gdd, plants).collect()
    assert [(r["frame_date"], r["station_id"]) for r in frames] == [
        ("2025-03-01", "A"), ("2025-03-01", "B"), ("2025-03-02", "A")]
    assert frames[0]["phase_label"] == "2. Kwitnienie"
    preview = plans.bloom_preview(gdd, 1).collect()
    assert [(r["station_id"], r["date"]) for r in preview] == [("A", D(2025, 3, 2))]


def test_profile_years_and_thresholds(spark, plants):
    daily = days(spark, run(D(2024, 12, 31), [1.0, 2.0]) + [("B", D(2025, 3, 1), 1.0)])
    assert tuple(weather.history_profile(daily).first()) == (
        2, 3, D(2024, 12, 31), D(2025, 3, 1))
    assert weather.days_of_year(daily, 2024).count() == 1
    with pytest.raises(ValueError):
        weather.days_of_year(daily, 1999)
    assert [r["station_id"] for r in weather.station_ids(daily).collect()] == ["A", "B"]
    rows = gd.threshold_rows(plants.withColumn("gdd_max", F.lit(None).cast("double"))).collect()
    assert [(r["label"], r["y"]) for r in rows] == [("Próg kwitnienia od", 100.0)]


def test_searched_windows_equal_those_of_the_daily_table(spark):
    import random

    rng = random.Random(11)
    rows = []
    for station in "ABC":
        for year in (2021, 2022, 2024):
            for day in range(rng.choice([0, 1, 30, 365, 366])):
                mean = rng.choice([None, rng.uniform(-5, 25), 5.0])
                rows.append((station, D(year, 1, 1) + dt.timedelta(days=day), mean))
    rows.append(("D", D(2024, 5, 1), None))
    plants = spark.createDataFrame([
        (f"p{k}", "n", "l", rng.choice([None, 3.0, 5.0, 12.25]), rng.choice([None, 0.0, rng.uniform(0, 3000)]),
         rng.choice([None, rng.uniform(0, 3000)]), None) for k in range(40)], PLANT_SCHEMA)
    daily = days(spark, rows)
    plantings = spark.createDataFrame(
        [("A", "p1"), ("A", "p1"), ("A", "p30"), ("B", "p2"), ("Z", "p3"), ("C", "none")],
        "station_id STRING, plant_id STRING")
    for pairs in (None, plantings):
        yearly = gd.yearly_windows(gd.growing_degree_days(daily, plants, pairs))
        assert sorted(map(str, gd.searched_years(daily, plants, pairs).select(*yearly.columns).collect())) == sorted(
            map(str, yearly.collect()))
        latest = gd.latest_windows(yearly)
        assert sorted(map(str, gd.searched_windows(daily, plants, pairs).select(*latest.columns).collect())) == sorted(
            map(str, latest.collect()))


def test_a_large_dictionary_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(gd, "PLANTS_PER_BLOCK", 7)
    many = spark.createDataFrame(
        [(f"p{k}", "n", "l", 5.0, 1.0 + k, 2.0 + k, None) for k in range(50)], PLANT_SCHEMA)
    found = gd.searched_windows(days(spark, run(D(2024, 1, 1), [15.0] * 9)), many).collect()
    assert {r["plant_id"]: r["bloom_start_date"].day for r in found} == {
        f"p{k}": (k + 10) // 10 for k in range(50)}
    assert gd.searched_windows(days(spark, []), many).isEmpty()


def test_degree_days_list_days_without_sorting_them_in_a_window(spark, plants):
    daily = days(spark, run(D(2025, 3, 1), [None, 104.99, None, 5.02, 5.01, None, 104.0, None]))
    table = gd.gdd_table(daily, plants)
    assert [(r["gdd_cumulative"], r["bloom_day"]) for r in table.orderBy("date").collect()] == [
        (None, 0), (99.99, 0), (None, 0), (100.01, 1), (100.02, 2), (None, 0), (199.02, 3), (None, 0)]
    for frame in (table, gd.searched_years(daily, plants)):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()


def test_catalogue_windows_do_not_write_days_once_per_base(spark):
    many = spark.createDataFrame(
        [(f"p{k}", "n", "l", k / 4.0, 20.0 + k, 40.0 + k, None) for k in range(60)], PLANT_SCHEMA)
    rows = [r for s in "AB" for r in [(s, d, t) for _, d, t in run(D(2024, 1, 1), [9.0 + ord(s) % 3] * 30)]]
    daily = days(spark, rows)
    expected = gd.latest_windows(gd.yearly_windows(gd.growing_degree_days(daily, many)))
    found = gd.searched_windows(daily, many)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(*found.columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gd.searched_windows(daily, many)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(base_temp_c" not in plan and "CartesianProduct" in plan
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(*found.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plantings_of_a_station_share_lists_however_large_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(gd, "PLANTS_PER_BLOCK", 7)
    many = spark.createDataFrame(
        [(f"p{k}", "n", "l", k / 4.0, 1.0 + k, 2.0 + k, None) for k in range(50)], PLANT_SCHEMA)
    plantings = spark.createDataFrame(
        [("A", f"p{k}") for k in range(5, 11)] + [("B", f"p{k}") for k in range(20)],
        "station_id STRING, plant_id STRING")
    lists = gd._wanted(many, plantings).select("station_id", F.size("plants").alias("n")).collect()
    assert sorted((r["station_id"], r["n"]) for r in lists) == [("A", 6), ("B", 6), ("B", 7), ("B", 7)]
    daily = days(spark, run(D(2024, 1, 1), [15.0, None, 12.0, 14.0]))
    expected = gd.yearly_windows(gd.growing_degree_days(daily, many, plantings))
    found = gd.searched_years(daily, many, plantings)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(*found.columns).collect()))
