"""Station summaries, series, status, lists and quality rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomgrid import quality, schemas
from bloomgrid.operators import layers
from bloomgrid.operators.gdd import gdd_table, requested_degree_days
from bloomgrid.plans import stations as plans

D = dt.date


@pytest.fixture(scope="module")
def data(spark):
    plants = spark.createDataFrame(
        [("p", "Wierzba iwa", "Salix caprea", 5.0, 100.0, 200.0, None)], schemas.PLANT)
    daily = spark.createDataFrame(
        [("A", D(2024, 1, d), 1.0, 2.0, float(t)) for d, t in ((1, 65), (2, 65), (3, 5))]
        + [("A", D(2024, 3, 1), None, None, None), ("X", D(2024, 1, 1), 1.0, 1.0, 1.0)],
        schemas.DAILY)
    zones = spark.createDataFrame(
        [(2, "A", "second", 1.0), (1, "A", "first", 9.0), (3, "", "nameless", None),
         (4, "B", "", 2.0)],
        "cell_id INT, station_id STRING, station_name STRING, area_ha DOUBLE")
    rain = spark.createDataFrame(
        [("A", D(2024, 1, 1), 1.5), ("A", D(2024, 1, 9), 0.5), ("A", D(2024, 2, 1), 4.0)],
        "station_id STRING, date DATE, precip_mm DOUBLE")
    return {"plants": plants, "daily": daily, "zones": zones, "rain": rain,
            "gdd": gdd_table(daily, plants)}


def summaries(spark, data, plant="p", station="A", year=2024, stored=False):
    requests = plans.year_request(spark, station, year, plant)
    source = {"gdd": data["gdd"]} if stored else {"plants": data["plants"]}
    return plans.monthly_summaries(
        data["daily"], requests, data["zones"], data["rain"], **source)


def test_stored_and_computed_totals_agree(spark, data):
    for plant in ("p", "other"):
        computed, stored = (summaries(spark, data, plant, stored=x).collect() for x in (False, True))
        assert computed == stored


def test_table_requests_answer_every_year(spark, data):
    daily = spark.createDataFrame(
        [("A", D(1999, 5, 1), 10.0, 20.0, 15.0)],
        "station_id STRING, date DATE, t_min DOUBLE, t_max DOUBLE, t_mean DOUBLE")
    requests = spark.createDataFrame([("A", 1999, "p")], "station_id STRING, year INT, plant_id STRING")
    rows = plans.daily_rows(daily, requests, data["zones"], data["rain"], plants=data["plants"])
    assert [r["date"] for r in rows.collect()] == [D(1999, 5, 1)]
    assert quality.refused_years(requests).count() == 1


def test_requests_cut_daily_rows_before_the_windows(spark, data):
    requests = plans.year_request(spark, "A", 2024, "p")
    rows = plans.daily_rows(
        data["daily"], requests, data["zones"], data["rain"], plants=data["plants"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    window = max(i for i, line in enumerate(lines) if "Window" in line)
    assert any("Join" in line for line in lines[window + 1:])


def test_monthly_summary(spark, data):
    row = summaries(spark, data).first()
    assert (row["station_name"], row["day_count"], row["t_mean_annual"]) == ("first", 4, 45.0)
    # The annual sum holds February, which has no readings; March has no precipitation entry.
    assert (row["gdd_max"], row["precip_annual"]) == (120.0, 6.0)
    assert [tuple(m) for m in row["months"]] == [
        (1, 45.0, 120.0, 120.0, 2.0), (3, None, None, None, None)]
    flat = plans.summary_rows(summaries(spark, data)).orderBy("month").collect()
    assert [r["month_label"] for r in flat] == ["01. Sty", "03. Mar"]


def test_unknown_station_year_and_plant(spark, data):
    assert summaries(spark, data, station="X").count() == 0
    assert summaries(spark, data, year=2023).count() == 0
    with pytest.raises(ValueError):
        summaries(spark, data, year=1999)
    row = summaries(spark, data, plant="other").first()
    assert row["day_count"] == 4 and row["gdd_max"] is None
    chart = plans.gdd_chart(summaries(spark, data, plant="other")).orderBy("month").collect()
    assert [r["gdd_cumulative"] for r in chart] == [0.0, 0.0]


def test_annual_status(spark, data):
    row = plans.annual_statuses(summaries(spark, data), data["plants"]).first()
    assert (row["gdd_max"], row["status"]) == (120.0, "W okresie kwitnienia")


def test_daily_series(spark, data):
    requests = plans.year_request(spark, "A", 2024, "p")
    rows = plans.daily_rows(
        data["daily"], requests, data["zones"], data["rain"], gdd=data["gdd"])
    points = plans.daily_series(rows).first()["points"]
    assert [p["date"] for p in points] == [
        D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3), D(2024, 3, 1)]
    assert [p["precip_mm"] for p in points] == [1.5, None, None, None]
    assert [p["gdd_cumulative"] for p in points] == [60.0, 120.0, 120.0, None]


def test_bloom_status(spark, data):
    requests = spark.createDataFrame(
        [("A", D(2024, 1, 2), "p"), ("A", D(2024, 1, 2), "p"), ("X", D(2024, 1, 1), "p"),
         ("A", D(2024, 1, 2), "q"), ("A", D(2030, 1, 1), "p")],
        "station_id STRING, date DATE, plant_id STRING")
    rows = plans.bloom_status(data["plants"], data["zones"], requests, gdd=data["gdd"])
    computed = plans.bloom_status(data["plants"], data["zones"], requests, daily=data["daily"])
    assert sorted(map(str, rows.collect())) == sorted(map(str, computed.collect()))
    got = {r["station_id"]: r for r in rows.collect()}
    assert sorted(got) == ["A", "X"] and rows.count() == 2
    assert (got["A"]["station_name"], got["A"]["bloom_phase_label"], got["A"]["bloom_day_text"]) == (
        "first", "Kwitnie", "1")
    assert (got["X"]["station_name"], got["X"]["bloom_day_text"]) == (None, "-")


def test_lists_and_search(spark, data):
    names = [r["station_name"] for r in plans.station_list(data["zones"]).collect()]
    assert names == ["", "first", "nameless", "second"]

    def found(text):
        return [(r["station_id"], r["label"])
                for r in plans.station_search(data["zones"], text).collect()]

    assert found("") == [("A", "second"), ("B", "B")]
    assert found("  SECO ") == [("A", "second")]
    assert found("b") == [("B", "B")]
    assert found("%") == [] and found("_") == []
    assert [r["id"] for r in plans.plant_list(data["plants"]).collect()] == ["p"]
    choice = plans.plant_choices(data["plants"]).first()
    assert (choice["label"], choice["season"]) == ("Wierzba iwa (Salix caprea)", "—")
    labels = {r["label"] for r in plans.station_choices(data["zones"]).collect()}
    assert "first (A)" in labels
    assert [r["cell_id"] for r in layers.first_features(data["zones"], 2).collect()] == [1, 2]
    assert {r["station_id"]: r["station_name"] for r in
            layers.station_by_id(layers.stations(data["zones"])).collect()} == {
        "A": "second", "B": ""}


def test_quality_rules(spark, data):
    daily = data["daily"].unionByName(data["daily"].where("station_id = 'X'"))
    keys = quality.duplicate_keys(daily, quality.KEYS["station_daily"]).collect()
    assert [(r["station_id"], r["rows"]) for r in keys] == [("X", 2)]
    counts = {r["column"]: r["missing"] for r in
              quality.missing_values(daily, ("station_id", "t_mean")).collect()}
    assert counts == {"station_id": 0, "t_mean": 1}
    zones = data["zones"].withColumn(
        "station_id", F.when(F.col("station_id") != "", F.col("station_id")))
    rejected = quality.rejected_rows(zones, quality.REQUIRED["zone_features"]).collect()
    assert [(r["cell_id"], r["lacking"]) for r in rejected] == [(3, ["station_id"])]
    assert quality.complete_rows(zones, ("station_id",)).count() == 3
    assert tuple(quality.unknown_totals(data["gdd"]).first()) == ("p", 1, 5)
    empty = quality.all_missing(data["daily"], ("station_id",), "t_mean")
    assert {r["station_id"]: r["all_missing"] for r in empty.collect()} == {"A": False, "X": False}
    assert quality.check_year(2000) == 2000


def test_series_shuffle_no_row_per_request_and_day(spark, data):
    daily = spark.createDataFrame(
        [("A", D(2024, 1, 1) + dt.timedelta(days=k), 1.0, 2.0, (None, 7.25, 9.5, -3.0)[k % 4]) for k in range(40)]
        + [("B", D(2024, 1, 1), 1.0, 2.0, 8.0)], schemas.DAILY)
    plants = data["plants"].unionByName(data["plants"]).unionByName(
        data["plants"].selectExpr("'q' AS id", *(f"{c}" for c in data["plants"].columns if c != "id")))
    rain = data["rain"].unionByName(data["rain"].withColumn("precip_mm", F.lit(None).cast("double")))
    requests = spark.createDataFrame(
        [("A", 2024, p) for p in ("p", "q", "unknown", None)] + [("A", 2023, "p"), ("B", 2024, "q")],
        "station_id STRING, year INT, plant_id STRING")
    windows = requested_degree_days(daily, plants, requests.join(layers.first_zone(data["zones"]), "station_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plans.daily_rows(daily, requests, data["zones"], rain, plants=plants)
        expected = windows.join(rain, ["station_id", "date"], "left").select(*rows.columns)
        assert sorted(map(str, rows.collect())) == sorted(map(str, expected.collect()))
        plan = plans.daily_series(rows)._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffled and not any("station_name" in line for line in shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_totals_meet_the_requests_without_a_row_per_day_shuffled(spark, data):
    daily = spark.createDataFrame(
        [("A", D(2023, 12, 30) + dt.timedelta(days=k), 1.0, 2.0, (None, 7.25, 9.5, -3.0)[k % 4]) for k in range(40)]
        + [("B", D(2024, 1, 1), 1.0, 2.0, 8.0)], schemas.DAILY)
    plants = data["plants"].unionByName(data["plants"]).unionByName(
        data["plants"].selectExpr("'q' AS id", *(f"{c}" for c in data["plants"].columns if c != "id")))
    gdd = gdd_table(daily, F.broadcast(plants))
    rain = data["rain"].unionByName(data["rain"].withColumn("precip_mm", F.lit(None).cast("double")))
    requests = spark.createDataFrame(
        [("A", y, p) for y in (2023, 2024) for p in ("p", "q", "unknown", None)] + [("B", 2024, "q"), ("B", 2020, "q")],
        "station_id STRING, year INT, plant_id STRING")
    asked = daily.withColumn("year", F.year("date")).join(
        requests.join(layers.first_zone(data["zones"]), "station_id"), ["station_id", "year"])
    totals = gdd.select("station_id", "plant_id", "date", "gdd_daily", "gdd_cumulative").where("date <> '2024-01-05'")
    expected = asked.join(totals, ["station_id", "plant_id", "date"], "left").join(
        rain, ["station_id", "date"], "left")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plans.daily_rows(
            daily, requests, data["zones"], rain, gdd=gdd.where("date <> '2024-01-05'"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert sum("plant_id" in line.split("ENSURE")[0] for line in shuffled) == 1  # distinct requests
        assert sorted(map(str, rows.collect())) == sorted(map(str, expected.select(*rows.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
