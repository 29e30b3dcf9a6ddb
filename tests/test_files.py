"""Readers and writers on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bloomgrid import schemas
from bloomgrid.operators import layers, weather
from bloomgrid.operators import scenes as scenes_ops
from bloomgrid.plans import layers as layer_plans
from bloomgrid.plans import weather as weather_plans
from bloomgrid.sources import files, sinks

D = dt.date
SQUARE = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]


def feature(properties, kind="Polygon", coordinates=SQUARE):
    return {"type": "Feature", "properties": properties,
            "geometry": {"type": kind, "coordinates": coordinates}}


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_reading_pages(spark, tmp_path):
    put(tmp_path / "p" / "1.json", {"content": [
        {"stationId": "A", "measurementDate": "2024-01-01T01:00:00Z", "airTemperature": 1.5},
        {"stationId": "A", "measurementDate": "2024-01-01T02:00:00Z"}], "page": 0})
    put(tmp_path / "p" / "2.json", {"content": []})
    put(tmp_path / "p" / "3.json", {"status": "ok"})
    rows = files.read_reading_pages(spark, str(tmp_path / "p"))
    assert sorted(r["measured_at"] for r in rows.collect()) == [
        "2024-01-01T01:00:00Z", "2024-01-01T02:00:00Z"]
    assert [tuple(r) for r in weather.daily_extremes(rows).collect()] == [
        ("A", D(2024, 1, 1), 1.5, 1.5, 1.5)]


def test_broken_json_fails(spark, tmp_path):
    path = put(tmp_path / "broken.json", '{"content": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_reading_pages(spark, path).collect()


def test_daily_csv_by_column_name(spark, tmp_path):
    path = put(tmp_path / "h.csv", "data_dnia,extra,stationId,T_max,T_min,T_srednia\n"
                                   "2024-01-01,x,A,2.5,1.5,2.0\n2024-01-02,x,A,,NaN,\n")
    rows = files.read_daily_history(spark, path).orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("A", D(2024, 1, 1), 1.5, 2.5, 2.0), ("A", D(2024, 1, 2), None, None, None)]
    bad = put(tmp_path / "bad.csv", "stationId,data_dnia,T_min,T_max,T_srednia\nA,x,1,1,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_daily_history(spark, bad).collect()


def test_csv_round_trips(spark, tmp_path):
    daily = spark.createDataFrame(
        [("A", D(2024, 1, 1), 1.5, 2.5, 2.0), ("A", D(2024, 1, 2), None, 1.0, None)],
        schemas.DAILY)
    sinks.write_history_csv(daily, str(tmp_path / "history"))
    sinks.write_csv(daily, str(tmp_path / "daily"))
    expected = sorted(map(tuple, daily.collect()))
    for frame in (files.read_daily_history(spark, str(tmp_path / "history")).drop("position"),
                  files.read_station_daily(spark, str(tmp_path / "daily"))):
        assert sorted(map(tuple, frame.collect())) == expected
    gdd = spark.createDataFrame(
        [("A", "p", D(2024, 1, 1), 1.0, 2.0, 1.5, 0.5, 0.5, 0, "before")], schemas.GDD)
    sinks.write_csv(gdd, str(tmp_path / "gdd"))
    back = files.read_station_gdd(spark, str(tmp_path / "gdd"))
    assert [tuple(r) for r in back.collect()] == [
        ("A", "p", D(2024, 1, 1), 0.5, 0.5, 0, "before")]


def test_plants(spark, tmp_path):
    path = put(tmp_path / "plants.json", [
        {"id": "a", "name_pl": "A", "name_latin": "a", "base_temp_c": 5.0, "gdd_min": 100,
         "gdd_max": 200, "season": "wiosna"},
        {"id": "b", "name_pl": "B", "name_latin": "b", "base_temp_c": 4.5, "gdd_min": 1,
         "gdd_max": 2}])
    rows = {r["id"]: r for r in files.read_plants(spark, path).collect()}
    assert rows["a"]["gdd_min"] == 100.0 and rows["b"]["season"] is None


ZONES = {"type": "FeatureCollection", "features": [
    feature({"cell_id": 1, "station_id": "A", "station_name": "first", "latitude": None,
             "longitude": 0.5}),
    feature({"cell_id": 2, "station_id": "A", "station_name": "second", "area_ha": 2.5,
             "latitude": 0.5, "longitude": 0.25, "stationType": "PME"}),
    feature({"cell_id": 3, "station_id": "A", "station_name": "third", "latitude": 9.0,
             "longitude": 9.0}),
    feature({"cell_id": 4, "station_id": "B", "latitude": 1.0, "longitude": 1.0},
            "MultiPolygon", [SQUARE, SQUARE]),
    feature({"cell_id": 5, "station_id": "", "latitude": 1.0, "longitude": 1.0}),
]}


def test_zone_file_and_station_points(spark, tmp_path):
    path = put(tmp_path / "zones.geojson", ZONES)
    zones = files.read_zones(spark, path)
    rows = {r["cell_id"]: r for r in zones.collect()}
    assert rows[2]["polys"] == [SQUARE] and rows[4]["polys"] == [SQUARE, SQUARE]
    assert tuple(rows[4]["bbox"]) == (0.0, 0.0, 1.0, 1.0) and rows[2]["area_ha"] == 2.5
    points = {r["station_id"]: r for r in layers.station_points(zones).collect()}
    assert sorted(points) == ["A", "B"]
    assert (points["A"]["station_name"], points["A"]["lon"]) == ("second", 0.25)
    assert points["B"]["station_name"] == "B"
    found = layer_plans.station_point_features(zones).where("station_id = 'A'").first()["feature"]
    assert json.loads(found) == {
        "type": "Feature", "geometry": {"type": "Point", "coordinates": [0.25, 0.5]},
        "properties": {"station_id": "A", "station_name": "second", "station_type": "PME"}}


def test_layer_round_trip_as_lines_and_document(spark, tmp_path):
    zones = files.read_zones(spark, put(tmp_path / "zones.geojson", ZONES)).withColumn(
        "bloom_start_date", F.lit(D(2025, 4, 1))
    ).withColumn("bloom_end_date", F.lit(None).cast("date")).withColumn(
        "bloom_tooltip", F.lit("tip"))
    features = layer_plans.zone_layer(zones)
    sinks.write_feature_lines(features, str(tmp_path / "lines"))
    back = files.read_zone_lines(spark, str(tmp_path / "lines"))
    columns = ["cell_id", "station_id", "geom_type", "polys", "bbox"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(
        map(str, zones.select(columns).collect()))
    document = json.loads(sinks.feature_collection(features, limit=10).first()["document"])
    assert document["type"] == "FeatureCollection" and len(document["features"]) == 5
    assert document["features"][0]["properties"].keys() == {
        "cell_id", "station_id", "station_name", "area_ha", "bloom_start_date",
        "bloom_end_date", "bloom_tooltip"}
    with pytest.raises(Exception, match="too large"):
        sinks.feature_collection(features, limit=4).collect()
    slim = layer_plans.simplified_zone_layer(zones)
    assert slim.count() == 5


@pytest.mark.parametrize("form", ["collection", "feature", "geometry"])
def test_boundary_forms(spark, tmp_path, form):
    multi = feature({"nazwa": "x"}, "MultiPolygon", [SQUARE, SQUARE, []])
    document = {"collection": {"type": "FeatureCollection", "features": [
                    multi, feature({}), feature({}, "Point", [1.0, 2.0])]},
                "feature": multi, "geometry": multi["geometry"]}[form]
    rings = files.read_boundary(spark, put(tmp_path / f"{form}.json", document)).collect()
    assert [r["ring"] for r in rings] == [SQUARE[0]] * (3 if form == "collection" else 2)


def test_locations(spark, tmp_path):
    path = put(tmp_path / "places.geojson", {"type": "FeatureCollection", "features": [
        feature({"name": "Rynek", "category": "plac"}, "Point", [19.5, 50.25]),
        {**feature({"name": "B", "category": "c"}, "Point", [1.0, 2.0]), "id": 70}]})
    places = files.read_locations(spark, path)
    assert sorted(map(tuple, places.collect())) == [
        (1, "Rynek", "plac", 19.5, 50.25), (70, "B", "c", 1.0, 2.0)]
    text = sinks.location_features(places).where("id = 1").first()["feature"]
    assert json.loads(text)["properties"] == {"name": "Rynek", "category": "plac"}
    assert layer_plans.locations_in_bbox(places, 19.0, 50.0, 20.0, 51.0).count() == 1


def test_precipitation_files(spark, tmp_path):
    put(tmp_path / "rain" / "A_B_2024.json", {"2024-01-01": 1.5, "2024-01-02": 0.5,
                                              "2024-03-01": 2.0})
    put(tmp_path / "rain" / "C_2024.json", {})
    rain = files.read_precipitation(spark, str(tmp_path / "rain"))
    monthly = weather.monthly_precipitation(rain)
    assert sorted(map(tuple, monthly.collect())) == [("A_B", 2024, 1, 2.0), ("A_B", 2024, 3, 2.0)]
    assert [tuple(r) for r in weather.annual_precipitation(monthly).collect()] == [
        ("A_B", 2024, 4.0)]


def test_catalogue_files(spark, tmp_path):
    items = put(tmp_path / "items.json", [{
        "type": "Feature", "id": "dem-1", "collection": "dem", "bbox": [21.0, 50.0, 22.0, 51.0],
        "properties": {"datetime": "2021-01-01T00:00:00Z", "eo:cloud_cover": 12.5},
        "assets": {"visual": {"href": "h", "roles": ["visual", "data"]}}}])
    row = files.read_scenes(spark, items).first()
    assert (row["id"], row["acquired_at"], row["maxy"], row["cloud_cover"]) == (
        "dem-1", dt.datetime(2021, 1, 1), 51.0, 12.5)
    assert row["assets"]["visual"]["href"] == "h" and row["grid_code"] is None
    collection = put(tmp_path / "collection.json", {
        "type": "Collection", "id": "dem", "stac_version": "1.0.0", "license": "proprietary",
        "extent": {"spatial": {"bbox": [[21.0, 50.0, 24.5, 52.0]]},
                   "temporal": {"interval": [["2021-01-01T00:00:00Z", None]]}}})
    row = files.read_stac_collections(spark, collection).first()
    assert row["id"] == "dem" and row["extent"]["temporal"]["interval"][0][1] is None


def test_daily_table_refresh_prunes_years(spark, tmp_path):
    path = str(tmp_path / "daily")
    days = spark.createDataFrame(
        [("A", D(2024, 1, 1), 1.0, 1.0, 1.0), ("A", D(2025, 1, 1), 2.0, 2.0, 2.0)], schemas.DAILY)
    sinks.refresh_daily_table(days, path)
    sinks.refresh_daily_table(days, path)
    stored = files.read_table(spark, path)
    assert stored.count() == 2
    plan = stored.where("year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_catalogue_write_replaces_only_its_collections(spark, tmp_path):
    path = str(tmp_path / "catalogue")

    def rows(*pairs):
        return spark.createDataFrame(
            [(i, c, dt.datetime(2024, 1, 1)) for i, c in pairs],
            "id STRING, collection STRING, acquired_at TIMESTAMP_NTZ")

    sinks.write_catalogue(rows(("a", "x"), ("b", "x"), ("c", "y")), path)
    sinks.write_catalogue(rows(("d", "x")), path)
    assert sorted((r["collection"], r["id"]) for r in spark.read.parquet(path).collect()) == [
        ("x", "d"), ("y", "c")]


def test_documents(spark, tmp_path):
    frame = spark.createDataFrame([("A", [(1, None)])], "s STRING, m ARRAY<STRUCT<a: INT, b: INT>>")
    sinks.write_documents(frame, str(tmp_path / "docs"))
    sinks.refresh_table(frame, str(tmp_path / "table"))
    assert spark.read.text(str(tmp_path / "docs")).first()[0] == '{"s":"A","m":[{"a":1,"b":null}]}'
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


DAILY_COLUMNS = ["station_id", "date", "t_min", "t_max", "t_mean"]


def test_daily_job_runs_again_on_its_own_output(spark, tmp_path):
    def readings(rows):
        return spark.createDataFrame(rows, "station_id STRING, measured_at STRING, air_temperature DOUBLE")

    first = weather_plans.daily_temperatures(readings([("A", "2024-01-01T10:00:00Z", 1.0),
                                                       ("A", "2024-01-02T10:00:00Z", 2.0)]))
    sinks.write_history_csv(first, str(tmp_path / "one"))
    fresh = readings([("A", "2024-01-02T10:00:00Z", 5.0), ("B", "2024-01-02T10:00:00Z", 6.0)])
    second = weather_plans.daily_temperatures(
        fresh, files.read_daily_history(spark, str(tmp_path / "one")))
    sinks.write_history_csv(second, str(tmp_path / "two"))
    third = weather_plans.daily_temperatures(
        readings([]), files.read_daily_history(spark, str(tmp_path / "two")))
    got = sorted((r["station_id"], r["date"], r["t_mean"]) for r in third.collect())
    assert got == [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 5.0), ("B", D(2024, 1, 2), 6.0)]


def test_last_row_of_the_history_files_counts(spark, tmp_path):
    head = "stationId,data_dnia,T_min,T_max,T_srednia\n"
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text(head + "A,2024-01-01,1,1,1\nA,2024-01-01,2,2,2\n")
    (tmp_path / "h" / "b.csv").write_text(head + "A,2024-01-02,3,3,3\nA,2024-01-01,4,4,4\n")
    history = files.read_daily_history(spark, str(tmp_path / "h"))
    none = spark.createDataFrame([], "station_id STRING, date DATE, t_min DOUBLE, t_max DOUBLE, t_mean DOUBLE")
    rows = {r["date"]: r["t_mean"] for r in weather.keep_last(history, none).collect()}
    assert rows == {D(2024, 1, 1): 4.0, D(2024, 1, 2): 3.0}


def test_catalogue_load_from_files(spark, tmp_path):
    def item(name, href, stamp="2024-01-01T10:00:00Z"):
        return {"type": "Feature", "id": name, "collection": "c", "bbox": [0.0, 0.0, 1.0, 1.0],
                "properties": {"datetime": stamp}, "assets": {"visual": {"href": href}}}

    old = files.read_scenes(spark, put(tmp_path / "old.json", [item("gone", "x"), item("a", "y")]))
    load = files.read_scenes(spark, put(tmp_path / "new.json", [
        item("a", "first"), item("a", "last", "2024-01-01T23:30:00-03:00")]))
    rows = scenes_ops.replace_collections(old.drop("position"), load).collect()
    assert [(r["id"], r["assets"]["visual"]["href"]) for r in rows] == [("a", "last")]
    assert str(rows[0]["acquired_at"]) == "2024-01-02 02:30:00"
    documents = files.read_stac_collections(
        spark, put(tmp_path / "c.json", {"id": "c", "title": "new"}))
    stored = documents.drop("position").withColumn("title", F.lit("old"))
    assert [r["title"] for r in scenes_ops.upsert_by_id(stored, documents).collect()] == ["new"]


@pytest.mark.parametrize(("parse", "text"), [
    (files.parse_reading_pages, '{"content": ['),
    (files.parse_plants, '[{"id": '),
    (files.parse_zone_collections, '{"features": [1'),
    (files.parse_boundaries, "{"),
    (files.parse_scenes, "[{"),
])
def test_broken_documents_fail_and_are_named(spark, parse, text):
    documents = spark.createDataFrame([(text,)], "document STRING")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        parse(documents).collect()
    good = '{"content": []}'
    some = spark.createDataFrame([(1, text), (2, good), (3, None)], "k INT, document STRING")
    assert [r["k"] for r in files.rejected_documents(some, schemas.READING_PAGE).collect()] == [1]


def test_precipitation_of_overlapping_and_misnamed_files(spark):
    schema = "file_name STRING, document STRING"
    rows = spark.createDataFrame([
        ("A_2023.json", '{"2024-01-01": 9.0}'), ("A_2024.json", '{"2024-01-01": 1.0, "2024-01-02": 2.0}'),
    ], schema)
    got = sorted(tuple(r) for r in files.precipitation_rows(rows).collect())
    assert got == [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0)]
    wrong = spark.createDataFrame([("rain.json", '{"2024-01-01": 9.0}')], schema)
    with pytest.raises(Exception, match="not a precipitation file"):
        files.precipitation_rows(wrong).collect()


def test_compressed_csv_reads_back_the_same(spark, tmp_path):
    days = spark.range(2_000).selectExpr(
        "concat('S', id % 7) AS station_id", "'p' AS plant_id", "date_add(DATE'2024-01-01', CAST(id DIV 7 AS INT)) AS date",
        "0.5D AS gdd_daily", "IF(id % 5 = 0, NULL, 0.5D * id) AS gdd_cumulative", "0 AS bloom_day", "'before' AS bloom_phase")
    sizes, read = [], []
    for name, kind in (("plain", "none"), ("packed", "gzip")):
        sinks.write_csv(days, str(tmp_path / name), compression=kind)
        parts = [f for f in (tmp_path / name).iterdir() if f.name.startswith("part-")]
        sizes.append(sum(f.stat().st_size for f in parts))
        read.append(sorted(map(str, files.read_station_gdd(spark, str(tmp_path / name)).collect())))
    assert sizes[1] * 3 < sizes[0] and read[0] == read[1] and len(read[0]) == 2_000
