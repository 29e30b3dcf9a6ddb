"""Geometry as nested arrays: GeoJSON in and out, extents, containment, quadkeys.

A polygon layer holds `polys` (polygons > rings > points > [lon, lat]); a Polygon is a
one-element MultiPolygon. A point is two columns. Everything here is a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from bloomgrid.schemas import POLYGON, POLYGONS

#: Coordinates that do not parse fail the job.
STRICT = {"mode": "FAILFAST"}
MAX_LATITUDE = 85.0511287798066


def polygons(geom_type: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text -> `polys`; other geometry types give NULL."""
    return (
        F.when(geom_type == "Polygon", F.array(F.from_json(coordinates, POLYGON, STRICT)))
        .when(geom_type == "MultiPolygon", F.from_json(coordinates, POLYGONS, STRICT))
    )


def point_xy(coordinates: Column) -> Column:
    """GeoJSON point text -> [lon, lat]."""
    return F.from_json(coordinates, "ARRAY<DOUBLE>", STRICT)


def exterior_rings(polys: Column) -> Column:
    """First ring of every polygon that has one."""
    return F.transform(F.filter(polys, lambda p: F.size(p) > 0), lambda p: F.get(p, F.lit(0)))


def bbox_of(polys: Column) -> Column:
    """Extent of all points."""
    points = F.flatten(F.flatten(polys))
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """`polys` of an axis-parallel rectangle."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(F.array(F.array(*[F.array(x, y) for x, y in corners])))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def layer_geojson(geom_type: Column, polys: Column) -> Column:
    """GeoJSON text of a polygon layer's geometry, in its own type."""
    return F.when(
        geom_type == "Polygon",
        F.to_json(F.struct(geom_type.alias("type"), polys[0].alias("coordinates"))),
    ).otherwise(F.to_json(F.struct(geom_type.alias("type"), polys.alias("coordinates"))))


def edges(polys: Column) -> Column:
    """All ring edges of a layer row as (x1, y1, x2, y2) structs, holes included."""

    def ring_edges(ring: Column) -> Column:
        steps = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(
            F.slice(ring, F.lit(1), steps),
            F.slice(ring, F.lit(2), steps),
            lambda a, b: F.struct(
                a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
            ),
        )

    return F.flatten(F.transform(F.flatten(polys), ring_edges))


def strictly_inside(minx: Column, miny: Column, maxx: Column, maxy: Column,
                    lon: Column, lat: Column) -> Column:
    """Point within a rectangle; a point on its edge is not within."""
    return (lon > minx) & (lon < maxx) & (lat > miny) & (lat < maxy)


def edges_meet(edge_list: Column, minx: Column, miny: Column, maxx: Column, maxy: Column,
               ) -> Column:
    """Whether any edge meets a closed rectangle: extents overlap and its corners do not all
    lie on one side of the edge's line."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum(
            (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        )

    def meets(e: Column) -> Column:
        corners = [side(e, x, y) for x in (minx, maxx) for y in (miny, maxy)]
        return (
            (F.least(e["x1"], e["x2"]) <= maxx)
            & (F.greatest(e["x1"], e["x2"]) >= minx)
            & (F.least(e["y1"], e["y2"]) <= maxy)
            & (F.greatest(e["y1"], e["y2"]) >= miny)
            & (F.abs(corners[0] + corners[1] + corners[2] + corners[3]) < 4.0)
        )

    return F.exists(edge_list, meets)


def edges_contain(edge_list: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test over all edges; a point on an edge is outside.

    The turn of an edge about the point is zero only on the edge's line, so the same
    product decides both the edge case and the side on which a crossing lies.
    """

    def turn(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (lat - e["y1"]) - (lon - e["x1"]) * (e["y2"] - e["y1"])

    def on_edge(e: Column) -> Column:
        return (
            (turn(e) == 0.0)
            & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        return spans & ((turn(e) > 0) == (e["y2"] > e["y1"]))

    crossings = F.size(F.filter(edge_list, crosses))
    return ((crossings % 2) == 1) & ~F.exists(edge_list, on_edge)


def contains(polys: Column, bbox: Column, lon: Column, lat: Column) -> Column:
    """Containment with the extent tested first."""
    near = strictly_inside(bbox["minx"], bbox["miny"], bbox["maxx"], bbox["maxy"], lon, lat)
    return F.when(near, edges_contain(edges(polys), lon, lat)).otherwise(F.lit(False))


def _tile_x(lon: Column, zoom: int) -> Column:
    return (lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom))


def _tile_y(lat: Column, zoom: int) -> Column:
    clamped = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    sine = F.sin(F.radians(clamped))
    merc = F.log((F.lit(1.0) + sine) / (F.lit(1.0) - sine)) / F.lit(4.0 * math.pi)
    return (F.lit(0.5) - merc) * F.lit(float(2**zoom))


def _tile_range(low: Column, high: Column, zoom: int) -> Column:
    """Tile numbers met by [low, high]; a high edge exactly on a border adds no tile."""
    last = 2**zoom - 1
    first = F.least(F.greatest(F.floor(low), F.lit(0)), F.lit(last))
    final = F.least(F.greatest(F.ceil(high) - 1, first), F.lit(last))
    return F.sequence(first.cast("int"), final.cast("int"))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Quadkey of a Web-Mercator tile: one base-4 digit per level."""
    digits = []
    for level in range(zoom - 1, -1, -1):
        bit_x = F.shiftright(x, level).bitwiseAND(F.lit(1))
        bit_y = F.shiftright(y, level).bitwiseAND(F.lit(1))
        digits.append((bit_x + bit_y * 2).cast("string"))
    return F.concat(*digits)


def quadkeys(bbox: Column, zoom: int) -> Column:
    """Quadkeys of all tiles a (minx, miny, maxx, maxy) struct meets at one zoom."""
    xs = _tile_range(_tile_x(bbox["minx"], zoom), _tile_x(bbox["maxx"], zoom), zoom)
    ys = _tile_range(_tile_y(bbox["maxy"], zoom), _tile_y(bbox["miny"], zoom), zoom)
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: quadkey(x, y, zoom))))


def interleaved(x: Column, y: Column, bits: int) -> Column:
    """Place on the Z-order curve: the bits of both whole numbers (0 to 2**bits - 1) in turn."""
    code = F.lit(0).cast("long")
    for bit in range(bits):
        for shift, value in enumerate((x, y)):
            taken = F.shiftright(value.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(taken, 2 * bit + shift))
    return code
