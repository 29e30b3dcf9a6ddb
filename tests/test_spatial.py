"""Spatial joins against brute force, including crowded and copied places."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.operators import spatial

STATION = "station_id STRING, station_name STRING, lon DOUBLE, lat DOUBLE, position LONG"
POINT = "point_id LONG, lon DOUBLE, lat DOUBLE"


def stations_of(spark, rows):
    return spark.createDataFrame(
        [(f"S{i}", f"name {i}", float(x), float(y), i) for i, (x, y) in enumerate(rows)], STATION)


def points_of(spark, rows):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], POINT)


def nearest(points, stations, **options):
    rows = spatial.nearest_stations(points, stations, **options).collect()
    return {r["point_id"]: r["station_id"] for r in rows}


def brute_nearest(points, stations, radius=0.03):
    found = {}
    places = np.array(stations, dtype=float)
    for i, (x, y) in enumerate(points):
        distance = (places[:, 0] - x) ** 2 + (places[:, 1] - y) ** 2
        k = int(np.argmin(distance))
        if distance[k] < radius * radius:
            found[i] = f"S{k}"
    return found


def test_nearest_ties_edge_and_none(spark):
    tied = stations_of(spark, [(0.015625, 0.0), (-0.015625, 0.0)])
    assert nearest(points_of(spark, [(0.0, 0.0)]), tied) == {0: "S0"}
    assert nearest(points_of(spark, [(0.0, 0.0)]), stations_of(spark, [(0.03, 0.0)])) == {}
    assert nearest(points_of(spark, [(0.0, 0.0)]), stations_of(spark, [(9.0, 9.0)])) == {}
    assert nearest(points_of(spark, [(0.0, 0.0)]), stations_of(spark, [])) == {}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    stations = [(rng.uniform(21, 21.5), rng.uniform(50, 50.5)) for _ in range(300)]
    points = [(rng.uniform(20.9, 21.6), rng.uniform(49.9, 50.6)) for _ in range(400)]
    got = nearest(points_of(spark, points), stations_of(spark, stations))
    assert got == brute_nearest(points, stations)


def test_nearest_in_a_crowd_equals_brute_force(spark):
    rng = random.Random(2)
    crowd = [(21.1 + rng.gauss(0, 0.001), 50.1 + rng.gauss(0, 0.001)) for _ in range(150)]
    copies = [(21.105, 50.105)] * 150
    spread = [(rng.uniform(21, 21.3), rng.uniform(50, 50.3)) for _ in range(100)]
    stations = copies + crowd + spread
    points = [(21.1 + rng.gauss(0, 0.01), 50.1 + rng.gauss(0, 0.01)) for _ in range(200)]
    points += [(rng.uniform(21, 21.3), rng.uniform(50, 50.3)) for _ in range(100)]
    stations_frame = stations_of(spark, stations)
    places = spatial._first_per_place(stations_frame)
    assert spatial._census(places, 2.0**-5, 8)[1] > 0
    got = nearest(points_of(spark, points), stations_frame, most=8)
    assert got == brute_nearest(points, stations)


def zones_of(spark, boxes, schema_first="cell_id INT"):
    rows = [(i, f"S{i}", f"zone {i}", 1.0, *map(float, box)) for i, box in enumerate(boxes)]
    frame = spark.createDataFrame(
        rows, f"{schema_first}, station_id STRING, station_name STRING, area_ha DOUBLE, "
              "minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    polys = G.rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return frame.withColumn("polys", polys).withColumn("bbox", G.bbox_of(F.col("polys")))


def at_points(points, zones):
    return {r["point_id"]: r["cell_id"] for r in spatial.zones_at_points(points, zones).collect()}


def brute_zones(points, boxes):
    found = {}
    for i, (x, y) in enumerate(points):
        for k, (x1, y1, x2, y2) in enumerate(boxes):
            if x1 < x < x2 and y1 < y < y2:
                found[i] = k
                break
    return found


def test_zone_edges_and_corners_belong_to_no_zone(spark):
    zones = zones_of(spark, [(0, 0, 0.25, 0.25), (0.25, 0, 0.5, 0.25)])
    points = points_of(spark, [(0.25, 0.1), (0.0, 0.0), (0.1, 0.1), (0.3, 0.1), (0.3, 0.25)])
    assert at_points(points, zones) == {2: 0, 3: 1}


def test_no_zones_or_no_points(spark):
    zones = zones_of(spark, [(0, 0, 0.25, 0.25)])
    assert at_points(points_of(spark, [(0.1, 0.1)]), zones.where("cell_id > 5")) == {}
    assert at_points(points_of(spark, []), zones) == {}


def test_large_sides_are_merged_not_broadcast(spark):
    zones = zones_of(spark, [(0, 0, 0.25, 0.25)])
    points = points_of(spark, [(0.1, 0.1)])
    small = spatial.zones_at_points(points, zones)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small
    large = points.join(spatial._sized(zones.withColumnRenamed("minx", "lon"), 10**12), "lon")
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_zones_of_very_unequal_size(spark):
    rng = random.Random(3)
    boxes = []
    for _ in range(120):
        size = 2 ** rng.uniform(-12, 5)
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        boxes.append((x, y, x + size, y + size * rng.uniform(0.2, 1)))
    points = [(rng.uniform(-3, 6), rng.uniform(-3, 6)) for _ in range(400)]
    assert at_points(points_of(spark, points), zones_of(spark, boxes)) == brute_zones(points, boxes)


def test_crowded_zones_are_split_and_still_exact(spark):
    rng = random.Random(4)
    boxes = []
    for _ in range(150):
        x, y = rng.uniform(0, 0.02), rng.uniform(0, 0.02)
        boxes.append((x, y, x + rng.uniform(0.05, 0.12), y + rng.uniform(0.05, 0.12)))
    boxes += [(0.01, 0.01, 0.1, 0.1)] * 60
    boxes += [(rng.uniform(0, 1), rng.uniform(0, 1), 2.0, 2.0) for _ in range(20)]
    zones = zones_of(spark, boxes)
    cells = spatial.zone_cells(zones)
    relieved = spatial.relieve_cells(cells, 20)
    peak = [f.groupBy("level", "gx", "gy").count().agg(F.max("count")).first()[0]
            for f in (cells, relieved)]
    assert peak[0] > 100 and peak[1] <= 20
    points = [(rng.uniform(-0.01, 0.15), rng.uniform(-0.01, 0.15)) for _ in range(500)]
    got = at_points(points_of(spark, points), zones)
    assert got == brute_zones(points, boxes)


def test_holes_and_parts_in_the_join(spark):
    outer = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    part = [[7.0, 7.0], [8.0, 7.0], [8.0, 8.0], [7.0, 7.0]]
    zones = spark.createDataFrame(
        [(5, "A", "a", 1.0, [[outer, hole], [part]]), (9, "B", "b", 1.0, [[outer]])],
        "cell_id INT, station_id STRING, station_name STRING, area_ha DOUBLE, "
        "polys ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>").withColumn("bbox", G.bbox_of(F.col("polys")))
    points = points_of(spark, [(0.5, 0.5), (1.5, 1.5), (7.8, 7.2), (7.2, 7.8), (1.0, 1.5)])
    assert at_points(points, zones) == {0: 5, 1: 9, 2: 5, 4: 9}


def test_a_crowd_of_slanted_outlines(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(90):
        cx, cy, r = rng.uniform(0, 0.3), rng.uniform(0, 0.3), rng.uniform(0.4, 0.9)
        corners = [[cx + r * np.cos(a), cy + r * np.sin(a)]
                   for a in np.sort(np.array([rng.uniform(0, 2 * np.pi) for _ in range(7)]))]
        ring = [[float(a), float(b)] for a, b in corners]
        shapes.append((i, f"S{i}", f"z{i}", 1.0, [[ring + [ring[0]]]]))
    zones = spark.createDataFrame(
        shapes, "cell_id INT, station_id STRING, station_name STRING, area_ha DOUBLE, "
                "polys ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    ).withColumn("bbox", G.bbox_of(F.col("polys")))
    points = points_of(spark, [(rng.uniform(-1, 1.3), rng.uniform(-1, 1.3)) for _ in range(200)])
    pairs = points.crossJoin(zones).where(
        G.contains(F.col("polys"), F.col("bbox"), F.col("lon"), F.col("lat")))
    expected = {r["point_id"]: r["c"] for r in
                pairs.groupBy("point_id").agg(F.min("cell_id").alias("c")).collect()}
    assert at_points(points, zones) == expected


def test_click_resolution_cascade(spark):
    zones = zones_of(spark, [(0, 0, 1, 1)])
    pins = stations_of(spark, [(0.5, 0.5)])
    clicks = spark.createDataFrame([
        (1, 0.5, 0.51, "X", None), (2, 0.5, 0.51, None, None), (3, 0.9, 0.9, None, None),
        (4, 5.0, 5.0, None, None), (5, 5.0, 5.0, "Y", "named"),
    ], "click_id INT, lon DOUBLE, lat DOUBLE, station_id STRING, station_name STRING")
    rows = spatial.resolve_stations(clicks, pins, zones).collect()
    assert {r["click_id"]: (r["station_id"], r["station_name"]) for r in rows} == {
        1: ("X", "X"), 2: ("S0", "name 0"), 3: ("S0", "zone 0"), 5: ("Y", "named")}


@pytest.mark.parametrize("part", ["minute", "hour", "day"])
def test_changed_clicks_do_not_depend_on_the_time_parts(spark, part):
    rng = random.Random(6)
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        session = 1 if i % 3 else rng.randint(2, 4)
        rows.append((session, start + dt.timedelta(minutes=7 * i), rng.choice([1.0, 2.0]), 0.0))
    rows += rows[:50]
    clicks = spark.createDataFrame(rows, "session INT, ts TIMESTAMP_NTZ, lon DOUBLE, lat DOUBLE")
    expected, last = [], {}
    for session, ts, lon, _ in sorted(set(rows)):
        if last.get(session) != lon:
            expected.append((session, ts, f"0.00000,{lon:.5f}"))
        last[session] = lon
    got = [tuple(r) for r in spatial.changed_clicks(clicks, part).orderBy("session", "ts").collect()]
    assert got == expected


def test_bbox_edges_are_outside(spark):
    points = points_of(spark, [(0, 0), (1, 0.5), (0.5, 0.5), (2, 2)])
    rows = spatial.within_bbox(points, 0, 0, 1, 1).collect()
    assert [r["point_id"] for r in rows] == [2]


def test_session_changes_beside_brute_force(spark):
    rng = random.Random(6)
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(1500):
        session = 1 if i % 9 else rng.choice([2, 3, None])
        rows.append((session, start + dt.timedelta(minutes=rng.randrange(900)), rng.choice([1.0, 2.0]), 0.0))
    rows += rows[:50] + [(1, None, 1.0, 0.0), (4, start, None, 0.0)]
    clicks = spark.createDataFrame(rows, "session INT, ts TIMESTAMP_NTZ, lon DOUBLE, lat DOUBLE")
    expected, last = [], {}
    whole = {r for r in rows if r[2] is not None}
    for session, ts, lon, _ in sorted(whole, key=lambda r: (r[0] or 0, r[1] or dt.datetime.min, r[2])):
        if last.get(session, 0) != lon:
            expected.append((session, ts, f"0.00000,{lon:.5f}"))
        last[session] = lon
    found = spatial.session_changes(clicks)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    # one session that holds all rows is cut over the ranges
    one = clicks.where("session = 1 AND ts IS NOT NULL")
    spread = one.repartitionByRange(4, "session", "ts").groupBy(F.spark_partition_id()).count()
    assert spread.count() == 4
    want = sorted(map(str, map(tuple, spatial.changed_clicks(one).collect())))
    assert sorted(map(str, map(tuple, spatial.session_changes(one).collect()))) == want
    assert spatial.session_changes(clicks.limit(0)).isEmpty()
