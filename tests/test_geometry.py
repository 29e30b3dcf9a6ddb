"""Geometry expressions, quadkeys and outline simplification."""

import json

import pytest
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.operators import layers

HOLED = [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]],
          [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]]]
PARTS = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]],
         [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 6.0], [5.0, 5.0]]]]
POLYS = "polys ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"


def inside(spark, polys, points):
    frame = spark.createDataFrame([(polys, float(x), float(y)) for x, y in points], f"{POLYS}, x DOUBLE, y DOUBLE")
    frame = frame.withColumn("bbox", G.bbox_of(F.col("polys")))
    test = G.contains(F.col("polys"), F.col("bbox"), F.col("x"), F.col("y"))
    return [r[0] for r in frame.select(test).collect()]


def test_edges_corners_and_holes_are_outside(spark):
    points = [(5, 0), (0, 5), (10, 10), (0, 0), (5, 5), (4, 5), (4, 4), (2, 2), (7, 4), (11, 5)]
    assert inside(spark, HOLED, points) == [False] * 7 + [True, True, False]


def test_every_part_counts(spark):
    points = [(0.7, 0.3), (0.3, 0.7), (0.5, 0.5), (5.5, 5.5), (3.0, 3.0)]
    assert inside(spark, PARTS, points) == [True, False, False, True, False]


def test_ray_through_a_corner(spark):
    diamond = [[[[0.0, -1.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]]]
    assert inside(spark, diamond, [(0, 0), (-2, 0), (-0.5, 0.0), (2, 0)]) == [
        True, False, True, False]


def test_exterior_rings_and_extent(spark):
    frame = spark.createDataFrame([(PARTS,), (HOLED,)], POLYS)
    rows = frame.select(
        F.size(G.exterior_rings(F.col("polys"))).alias("n"), G.bbox_of(F.col("polys")).alias("b")
    ).collect()
    assert [(r["n"], tuple(r["b"])) for r in rows] == [(2, (0, 0, 6, 6)), (1, (0, 0, 10, 10))]


def test_edges_meet_a_rectangle(spark):
    frame = spark.createDataFrame([(PARTS,)], POLYS)
    edges = G.edges(F.col("polys"))

    def meets(*box):
        return frame.select(G.edges_meet(edges, *[F.lit(float(v)) for v in box])).first()[0]

    assert meets(0.4, 0.4, 0.6, 0.6)          # the slanted edge runs through it
    assert meets(1.0, -1.0, 2.0, 0.5)         # touches along a side
    assert not meets(0.1, 0.6, 0.3, 0.9)      # within the extent, on one side of the slant
    assert not meets(5.2, 5.2, 5.8, 5.8)      # wholly inside a part
    assert not meets(2.0, 2.0, 3.0, 3.0)


def test_geojson_both_ways(spark):
    texts = [("Polygon", json.dumps(HOLED[0])), ("MultiPolygon", json.dumps(PARTS)),
             ("Point", "[1.0,2.0]")]
    frame = spark.createDataFrame(texts, "t STRING, c STRING")
    polys = G.polygons(F.col("t"), F.col("c"))
    rows = frame.select(polys.alias("polys"), G.layer_geojson(F.col("t"), polys).alias("g")).collect()
    assert rows[0]["polys"] == HOLED
    assert rows[1]["polys"] == PARTS
    assert rows[2]["polys"] is None
    assert json.loads(rows[0]["g"]) == {"type": "Polygon", "coordinates": HOLED[0]}
    assert json.loads(rows[1]["g"]) == {"type": "MultiPolygon", "coordinates": PARTS}


def quadkeys(spark, box, zoom=7):
    struct = F.struct(*[F.lit(float(v)).alias(n)
                        for v, n in zip(box, ("minx", "miny", "maxx", "maxy"))])
    return sorted(spark.range(1).select(G.quadkeys(struct, zoom)).first()[0])


def test_quadkeys(spark):
    assert quadkeys(spark, (20.999712, 50.453523, 22.579544, 51.451182)) == [
        "1202131", "1202133", "1203020", "1203022"]
    assert quadkeys(spark, (-180, -90, 180, 90), 1) == ["0", "1", "2", "3"]
    # An edge exactly on a tile border adds no tile; a point has one.
    assert quadkeys(spark, (0, 0, 180, 80), 1) == ["1"]
    assert quadkeys(spark, (10, 10, 10, 10), 2) == ["12"]


def test_simplify_keeps_ends_and_small_rings(spark):
    simplify = layers.ring_simplifier(0.02)
    ring = [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    assert simplify(ring) == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    tiny = [[0.0, 0.0], [0.001, 0.0], [0.001, 0.001], [0.0, 0.001], [0.0, 0.0]]
    assert simplify(tiny) == tiny


def test_simplified_layer_stays_within_the_tolerance(spark):
    import math

    ring = [[math.cos(k * math.pi / 180), math.sin(k * math.pi / 180)] for k in range(360)]
    ring.append(ring[0])
    zones = spark.createDataFrame(
        [(1, [[ring]]), (2, None), (3, [])], f"cell_id INT, {POLYS}")
    zones = zones.withColumn("bbox", G.bbox_of(F.col("polys")))
    rows = {r["cell_id"]: r for r in layers.simplify(zones, 0.02).collect()}
    slim = rows[1]["polys"][0][0]
    assert 8 < len(slim) < 60
    assert slim[0] == slim[-1]

    def off(p):
        best = 9.0
        for a, b in zip(slim, slim[1:]):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy))
        return best

    assert max(off(p) for p in ring) <= 0.02 + 1e-12
    assert rows[2]["polys"] is None and rows[2]["bbox"] is None
    assert rows[3]["polys"] == []


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_simplify_keeps_other_columns(spark, tolerance):
    zones = spark.createDataFrame([(7, "S1", HOLED)], f"cell_id INT, station_id STRING, {POLYS}")
    row = layers.simplify(zones, tolerance).first()
    assert (row["cell_id"], row["station_id"], row["polys"]) == (7, "S1", HOLED)
