"""The stored zone index beside brute force, over several batches and after changes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.operators import spatial, zone_index
from bloomgrid.schemas import POLYGONS
from bloomgrid.sources import tables


def turned(rng, x, y, size):
    """A slanted quadrilateral around (x, y)."""
    return [(x - size, y - size * rng.uniform(0, 0.5)), (x + size * rng.uniform(0, 0.5), y - size),
            (x + size, y + size * rng.uniform(0, 0.5)), (x - size * rng.uniform(0, 0.5), y + size)]


def closed(points):
    return [list(p) for p in [*points, points[0]]]


def zone(rng, cell_id, x, y, size):
    hole = [(x - size / 8, y), (x, y + size / 8), (x + size / 8, y), (x, y - size / 8)]
    second = turned(rng, x + 3 * size, y, size / 2)
    return cell_id, f"S{cell_id}", f"zone {cell_id}", 1.0, [
        [closed(turned(rng, x, y, size)), closed(hole)], [closed(second)]]


def frame(spark, zones):
    rows = [(*z[:4], json.dumps(z[4])) for z in zones]
    made = spark.createDataFrame(
        rows, "cell_id INT, station_id STRING, station_name STRING, area_ha DOUBLE, text STRING")
    polys = F.from_json("text", POLYGONS)
    return made.withColumn("polys", polys).drop("text").withColumn("bbox", G.bbox_of(F.col("polys")))


def inside(polys, x, y):
    odd = False
    for ring in (r for poly in polys for r in poly):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def brute(zones, points):
    return {
        i: min(hits) for i, x, y in points
        for hits in [[z[0] for z in zones if inside(z[4], x, y)]] if hits
    }


@pytest.fixture(scope="module")
def layer():
    rng = random.Random(3)
    zones = [zone(rng, i, rng.uniform(20, 24), rng.uniform(49, 52), rng.choice([0.02, 0.1, 0.4, 1.5]))
             for i in range(120)]
    # a crowd in one place, so that cells are halved
    return zones + [zone(rng, 200 + i, 21.3 + i / 5000, 50.2, 0.01) for i in range(90)]


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    rows = [(i, rng.uniform(19, 26), rng.uniform(48, 53)) for i in range(500)]
    return rows + [(1000 + i, rng.uniform(21.28, 21.34), rng.uniform(50.18, 50.22)) for i in range(400)]


def answers(spark, path, points, whole=False):
    batch = spark.createDataFrame(points, "point_id LONG, lon DOUBLE, lat DOUBLE")
    index = zone_index.opened(spark, path, None if whole else batch)
    return {r["point_id"]: r["cell_id"] for r in spatial.zones_at_points(batch, index).collect()}


def test_batches_changes_and_brute_force(spark, tmp_path, layer, points, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_CELL_ROWS", 16)
    path = str(tmp_path / "index")
    zone_index.store(frame(spark, layer), path)
    want = brute(layer, points)
    first = tables.current(spark, f"{path}/cells")
    assert answers(spark, path, points[:300]) | answers(spark, path, points[300:]) == want
    assert answers(spark, path, points, whole=True) == want
    assert tables.current(spark, f"{path}/cells") == first  # built once
    assert zone_index.update(frame(spark, layer), path) == []

    # one zone moves, one goes, one is renamed, one is new
    rng = random.Random(6)
    moved = [z for z in layer if z[0] not in (5, 7, 9, 201)]
    moved += [zone(rng, 5, 20.5, 49.5, 0.1), zone(rng, 300, 23.5, 51.5, 0.02), zone(rng, 201, 21.31, 50.2, 0.01)]
    seven = next(z for z in layer if z[0] == 7)
    moved.append((7, "S7", "another name", 1.0, seven[4]))
    written = zone_index.update(frame(spark, moved), path)
    after = tables.current(spark, f"{path}/cells")
    differing = {p for p in first.folders.keys() | after.folders.keys()
                 if first.folders.get(p) != after.folders.get(p)}
    assert differing <= set(map(str, written)) and 0 < len(written) < len(first.folders)
    assert answers(spark, path, points) == brute(moved, points)
    batch = spark.createDataFrame([(1, *seven[4][1][0][0])], "point_id LONG, lon DOUBLE, lat DOUBLE")
    fresh = spatial.indexed(frame(spark, moved))
    stored = zone_index.opened(spark, path, batch)
    assert spatial.zones_at_points(batch, fresh).collect() == spatial.zones_at_points(batch, stored).collect()


def test_an_index_of_nothing(spark, tmp_path, layer, points):
    path = str(tmp_path / "index")
    zone_index.store(frame(spark, []), path)
    assert answers(spark, path, points) == {}
    zone_index.update(frame(spark, layer[:3]), path)
    assert answers(spark, path, points) == brute(layer[:3], points)
    zone_index.update(frame(spark, []), path)
    assert answers(spark, path, points, whole=True) == {}
