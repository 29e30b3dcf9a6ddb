"""Points against zones and stations.

Both joins turn space into an equality key, so Spark hashes, sorts or broadcasts them as it
does any join; the exact test then runs on the few rows that share a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bloomgrid.functions import geometry as G
from bloomgrid.functions.values import click_key, squared_distance
from bloomgrid.operators.sizing import BROADCAST_BYTES, placed
from bloomgrid.session import cut_lineage

# Power-of-two cell sides divide without rounding, so a floor never lands one cell off.
FINEST_SIDE = 2.0**-10
COARSEST_LEVEL = 20
PIN_RADIUS = 0.03
MAX_CELL_ROWS = 64
DEEPEST_SPLIT = 24
ROW_BYTES = 256
EDGE_BYTES = 32


def _sized(frame: DataFrame, counted_bytes: int) -> DataFrame:
    return placed(frame, counted_bytes <= BROADCAST_BYTES)


# point in zone ----------------------------------------------------------------------------


def _side(level: Column) -> Column:
    return F.lit(FINEST_SIDE) * F.pow(F.lit(2.0), level)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / _side(level)).cast("bigint")


def cell_of(column: str, level: int) -> Column:
    """Number of the cell of a level along one axis."""
    return _cell(F.col(column), F.lit(level))


def _halves(column: str) -> Column:
    return F.explode(F.array(F.col(column) * 2, F.col(column) * 2 + 1))


def zone_shapes(zones: DataFrame) -> DataFrame:
    """Distinct geometries (zone, bbox, polys) with the digest of what a lookup answers from them.

    Copies of one geometry keep the lowest cell_id, which is the one that answers anyway.
    """
    whole = F.struct("cell_id", "station_id", "station_name", "area_ha")
    # a digest stands for the geometry, so that no nested arrays are sorted
    shape = F.sha2(F.to_json("polys"), 256).alias("shape")
    unique = zones.where(F.col("polys").isNotNull()).groupBy(shape).agg(
        F.min(whole).alias("zone"), F.any_value("bbox").alias("bbox"),
        F.any_value("polys").alias("polys"),
    )
    answer = F.concat_ws("|", "shape", F.to_json("zone"))
    return unique.withColumn("digest", F.sha2(answer, 256)).drop("shape")


def shape_roots(shapes: DataFrame) -> DataFrame:
    """Shapes once per grid cell of about their own size that they meet: at most four each.

    Large zones sit on coarse levels and small ones on fine levels, so the number of zones in a
    cell follows how many really overlap there and not how unequal their sizes are.
    """
    box = F.col("bbox")
    reach = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"], F.lit(FINEST_SIDE))
    level = F.least(F.ceil(F.log2(reach / F.lit(FINEST_SIDE))), F.lit(COARSEST_LEVEL)).cast("int")

    def along(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(_cell(low, F.col("level")), _cell(high, F.col("level"))))

    return (
        shapes.withColumn("level", level)
        .withColumn("gx", along(box["minx"], box["maxx"]))
        .withColumn("gy", along(box["miny"], box["maxy"]))
    )


def root_cells(roots: DataFrame) -> DataFrame:
    """Index rows of the roots: zone, bbox and edges by cell."""
    return roots.withColumn("edges", G.edges(F.col("polys"))).drop("polys").withColumn(
        "whole", F.lit(False)
    )


def zone_cells(zones: DataFrame) -> DataFrame:
    """Zones spread over grid cells of about their own size: at most four cells each."""
    return root_cells(shape_roots(zone_shapes(zones).drop("digest")))


#: What tells cells apart. A stored index keeps cells of different roots apart, too.
CELL = ("level", "gx", "gy")


def _halved(crowded: DataFrame, cell: tuple[str, ...]) -> DataFrame:
    """Quarters of crowded cells, with only the zones that can still answer in them.

    A zone whose edges miss a quarter either covers it whole or not at all. Of those that cover
    it whole the lowest cell_id answers, so every zone behind it is left out there.
    """
    quarters = (
        crowded.withColumn("level", F.col("level") - 1)
        .withColumn("gx", _halves("gx"))
        .withColumn("gy", _halves("gy"))
    )
    side = _side(F.col("level"))
    x, y = F.col("gx") * side, F.col("gy") * side
    cut = G.edges_meet(F.col("edges"), x, y, x + side, y + side)
    holds = G.edges_contain(F.col("edges"), x + side / 2.0, y + side / 2.0)
    # A zone that covers the larger cell whole covers its quarters too.
    tested = quarters.withColumn("cut", ~F.col("whole") & cut).withColumn(
        "whole", F.col("whole") | (~F.col("cut") & holds)
    ).where(F.col("cut") | F.col("whole"))
    none = F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")
    slim = tested.withColumn("edges", F.when(F.col("whole"), none).otherwise(F.col("edges")))
    cover = slim.where("whole").groupBy(*cell).agg(F.min("zone.cell_id").alias("cover"))
    kept = slim.join(cover, [*cell], "left").where(
        F.col("cover").isNull() | (F.col("zone.cell_id") <= F.col("cover"))
    )
    return kept.select(*crowded.columns)


def relieve_cells(cells: DataFrame, most: int = MAX_CELL_ROWS, cell: tuple[str, ...] = CELL,
                  ) -> DataFrame:
    """Halve cells until none holds more than `most` zones, as far as halving helps.

    Each round reads one yes or no to the driver.
    """
    for _ in range(DEEPEST_SPLIT):
        crowded = cells.groupBy(*cell).count().where(F.col("count") > most).select(*cell)
        if crowded.isEmpty():
            break
        calm = cells.join(crowded, [*cell], "left_anti")
        split = _halved(cells.join(crowded, [*cell], "left_semi").select(*cells.columns), cell)
        cells = cut_lineage(calm.select(*cells.columns).unionByName(split))
    return cells


def cell_bytes() -> Column:
    return F.lit(ROW_BYTES) + F.size("edges") * F.lit(EDGE_BYTES)


def _index_census(cells: DataFrame) -> Row:
    """Levels in use, size in bytes and zones in the fullest cell, in one job on the zone side."""
    size = cell_bytes()
    per_cell = cells.groupBy("level", "gx", "gy").agg(
        F.count("*").alias("zones"), F.sum(size).alias("bytes")
    )
    return per_cell.agg(
        F.array_sort(F.collect_set("level")).alias("levels"),
        F.sum("bytes").alias("bytes"),
        F.max("zones").alias("peak"),
    ).first()


@dataclass(frozen=True)
class ZoneIndex:
    """Cells to look points up in, the grid levels in use and the size of the cells in bytes."""

    cells: DataFrame
    levels: list[int]
    bytes: int


def indexed(zones: DataFrame) -> ZoneIndex:
    """An index for one lookup; `zone_index` keeps one beside the layer."""
    cells = zone_cells(zones)
    census = _index_census(cells)
    if (census["peak"] or 0) > MAX_CELL_ROWS:
        cells = relieve_cells(cells)
        census = _index_census(cells)
    return ZoneIndex(cells, census["levels"], census["bytes"] or 0)


def zones_at_points(points: DataFrame, zones: DataFrame | ZoneIndex, key: str = "point_id",
                    ) -> DataFrame:
    """The containing zone with the lowest cell_id per point; points in no zone have no row.

    `points`: key, lon, lat. `zones`: a layer, or an index of one. A point is looked up once per
    grid level in use (a short list, one per power of two of cell size), lies in exactly one cell
    of each, and so never meets a zone twice.
    """
    index = zones if isinstance(zones, ZoneIndex) else indexed(zones)
    levels = F.array(*[F.lit(level) for level in index.levels]).cast("array<int>")
    probes = (
        points.select(key, "lon", "lat", F.explode(levels).alias("level"))
        .withColumn("gx", _cell(F.col("lon"), F.col("level")))
        .withColumn("gy", _cell(F.col("lat"), F.col("level")))
    )
    near = G.strictly_inside(
        F.col("bbox.minx"), F.col("bbox.miny"), F.col("bbox.maxx"), F.col("bbox.maxy"),
        F.col("lon"), F.col("lat"),
    )
    inside = F.when(F.col("whole"), True).when(
        near, G.edges_contain(F.col("edges"), F.col("lon"), F.col("lat"))
    )
    held = _sized(index.cells, index.bytes)
    hits = probes.join(held, ["level", "gx", "gy"]).where(inside)
    return hits.groupBy(key).agg(F.min("zone").alias("zone")).select(key, "zone.*")


# nearest station --------------------------------------------------------------------------


def _grid(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side)).cast("bigint")


def _first_per_place(stations: DataFrame) -> DataFrame:
    """Stations at one place collapse to the first in file order, which wins the tie."""
    chosen = F.min(F.struct(F.col("position").alias("seq"), "station_id", "station_name"))
    return (
        stations.select("lon", "lat", "position", "station_id", "station_name")
        .groupBy(F.col("lon").alias("slon"), F.col("lat").alias("slat"))
        .agg(chosen.alias("station"))
    )


def _fullest_cells(places: DataFrame, side: float, first: int, last: int) -> list[tuple[int, int]]:
    """(places, places in the fullest cell) for each level from `first` to `last`."""
    levels = places.select(
        "slon", "slat", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")
    )
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    counts = levels.groupBy(
        "level",
        F.floor(F.col("slon") / size).alias("gx"),
        F.floor(F.col("slat") / size).alias("gy"),
    ).count()
    peaks = counts.groupBy("level").agg(F.sum("count").alias("all"), F.max("count").alias("peak"))
    return [(row["all"], row["peak"]) for row in peaks.orderBy("level").collect()]


def _census(places: DataFrame, side: float, most: int) -> tuple[int, int]:
    """Number of places, and how often cells must be halved until none holds more than `most`.

    Reads two numbers per level to the driver; finer levels only when the first is too full.
    """
    top = _fullest_cells(places, side, 0, 0)
    if not top:
        return 0, 0
    total, peak = top[0]
    if peak <= most:
        return total, 0
    finer = _fullest_cells(places, side, 1, DEEPEST_SPLIT)
    calm = [depth for depth, (_, n) in enumerate(finer, start=1) if n <= most]
    return total, min(calm, default=DEEPEST_SPLIT)


def _neighbours(column: str) -> Column:
    return F.explode(F.sequence(F.col(column) - 1, F.col(column) + 1))


def _extents(places: DataFrame, side: float) -> DataFrame:
    """Occupied cells of one level with the extent of the stations in them."""
    return places.groupBy(
        _grid(F.col("slon"), side).alias("gx"), _grid(F.col("slat"), side).alias("gy")
    ).agg(
        F.min("slon").alias("minx"), F.max("slon").alias("maxx"),
        F.min("slat").alias("miny"), F.max("slat").alias("maxy"),
    )


def _narrow(candidates: DataFrame, extents: DataFrame, key: str, reach: float) -> DataFrame:
    """Keep the cells that may hold a point's nearest station.

    A cell is out when even its nearest corner is farther than the farthest corner of another
    candidate, or not within the radius. A point has at most nine candidates at first and four
    children per kept one later, so the window groups stay small.
    """
    joined = candidates.join(extents, ["gx", "gy"])
    zero = F.lit(0.0)
    lon, lat = F.col("lon"), F.col("lat")
    low_x = F.greatest(F.col("minx") - lon, lon - F.col("maxx"), zero)
    low_y = F.greatest(F.col("miny") - lat, lat - F.col("maxy"), zero)
    high_x = F.greatest(F.abs(F.col("minx") - lon), F.abs(F.col("maxx") - lon))
    high_y = F.greatest(F.abs(F.col("miny") - lat), F.abs(F.col("maxy") - lat))
    bound = F.min("high").over(Window.partitionBy(key))
    return (
        joined.withColumn("low", low_x * low_x + low_y * low_y)
        .where(F.col("low") < reach)
        .withColumn("high", high_x * high_x + high_y * high_y)
        .withColumn("bound", bound)
        .where(F.col("low") <= F.col("bound"))
        .select(key, "lon", "lat", "gx", "gy")
    )


def nearest_stations(points: DataFrame, stations: DataFrame, key: str = "point_id",
                     radius: float = PIN_RADIUS, most: int = MAX_CELL_ROWS) -> DataFrame:
    """Nearest station nearer than `radius` degrees per point; the first in file order wins ties.

    `points`: key (unique), lon, lat. `stations`: station_id, station_name, lon, lat, position.
    Cells are a little wider than the radius, so a point's candidates lie in its own cell and
    the eight around it. Where stations crowd into one cell, cells are halved and candidates
    narrowed level by level, so that no point is compared with a whole crowd.
    """
    reach = radius * radius
    side = 2.0 ** math.ceil(math.log2(radius))
    places = _first_per_place(stations)
    total, depth = _census(places, side, most)

    probes = (
        points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .select(key, "lon", "lat")
        .withColumn("gx", _grid(F.col("lon"), side))
        .withColumn("gy", _grid(F.col("lat"), side))
    )
    if depth == 0:
        # The smaller side is spread over the neighbouring cells; points stay one row each.
        held = (
            places.withColumn("gx", _grid(F.col("slon"), side))
            .withColumn("gy", _grid(F.col("slat"), side))
            .withColumn("gx", _neighbours("gx"))
            .withColumn("gy", _neighbours("gy"))
        )
        pairs = probes.join(_sized(held, 9 * total * ROW_BYTES), ["gx", "gy"])
    else:
        small = total * ROW_BYTES
        candidates = probes.withColumn("gx", _neighbours("gx")).withColumn(
            "gy", _neighbours("gy")
        )
        candidates = _narrow(candidates, _sized(_extents(places, side), small), key, reach)
        for _ in range(depth):
            side /= 2.0
            quarters = candidates.withColumn("gx", _halves("gx")).withColumn("gy", _halves("gy"))
            candidates = _narrow(quarters, _sized(_extents(places, side), small), key, reach)
        held = places.withColumn("gx", _grid(F.col("slon"), side)).withColumn(
            "gy", _grid(F.col("slat"), side)
        )
        pairs = candidates.join(_sized(held, small), ["gx", "gy"])

    distance = squared_distance(F.col("slon"), F.col("slat"), F.col("lon"), F.col("lat"))
    best = F.min(F.struct(F.col("distance"), F.col("station"))).alias("best")
    return (
        pairs.withColumn("distance", distance)
        .where(F.col("distance") < F.lit(reach))
        .groupBy(key)
        .agg(best)
        .select(
            key,
            F.col("best.station.station_id").alias("station_id"),
            F.col("best.station.station_name").alias("station_name"),
            F.col("best.distance").alias("distance2"),
        )
    )


# resolving and filtering ------------------------------------------------------------------


def resolve_stations(clicks: DataFrame, stations: DataFrame, zones: DataFrame,
                     key: str = "click_id") -> DataFrame:
    """Station of each click: the one it names, else the nearest pin, else the zone around it.

    Only clicks that name no station are searched. Both searches return one row per click, and
    the two left joins share one partitioning by the click's key.
    """
    open_clicks = clicks.where(F.col("station_id").isNull())

    def found(frame: DataFrame, name: str) -> DataFrame:
        hit = F.struct("station_id", "station_name").alias(name)
        return frame.select(key, hit)

    pins = found(nearest_stations(open_clicks, stations, key), "pin")
    areas = found(zones_at_points(open_clicks, zones, key), "area")
    named = F.when(
        F.col("station_id").isNotNull(),
        F.struct(
            F.col("station_id"),
            F.coalesce("station_name", "station_id").alias("station_name"),
        ),
    )
    joined = clicks.join(pins, key, "left").join(areas, key, "left")
    hit = F.coalesce(named, F.col("pin"), F.col("area"))
    return (
        joined.withColumn("hit", hit)
        .where(F.col("hit").isNotNull())
        .drop("pin", "area", "station_id", "station_name")
        .select("*", "hit.station_id", "hit.station_name")
        .drop("hit")
    )


def within_bbox(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float,
                ) -> DataFrame:
    """Points strictly inside the rectangle; plain comparisons, so they reach the scan."""
    corners = [F.lit(float(v)) for v in (minx, miny, maxx, maxy)]
    return points.where(G.strictly_inside(*corners, F.col("lon"), F.col("lat")))


def changed_clicks(clicks: DataFrame, part: str = "minute") -> DataFrame:
    """Clicks whose place differs from the one before in their session.

    `clicks`: session, ts, lon, lat. Equal clicks of one instant are one click, so they are
    merged first, before the shuffle. A session may hold any share of the rows: each is cut
    into time parts, the last place of every part is one small row, and a part's first click is
    compared with the last place of the session's previous part.
    """
    placed = clicks.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    distinct = placed.select(
        "session", "ts", click_key(F.col("lon"), F.col("lat")).alias("place")
    ).distinct()
    parts = distinct.withColumn("part", F.date_trunc(part, "ts"))
    in_part = Window.partitionBy("session", "part").orderBy("ts", "place")
    rows = parts.withColumn("before", F.lag("place").over(in_part)).withColumn(
        "nth", F.row_number().over(in_part)
    )
    ends = parts.groupBy("session", "part").agg(
        F.max(F.struct("ts", "place"))["place"].alias("end")
    )
    by_session = Window.partitionBy("session").orderBy("part")
    carried = ends.select("session", "part", F.lag("end").over(by_session).alias("carried"))
    joined = rows.join(carried, ["session", "part"], "left")
    previous = F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("before"))
    return joined.where(~F.col("place").eqNullSafe(previous)).select("session", "ts", "place")


def session_changes(clicks: DataFrame) -> DataFrame:
    """As `changed_clicks`, by ranges of (session, ts, place) instead of time parts.

    Ranges are of like size whatever the sessions, so one that holds all rows is cut over all
    tasks. A task compares neighbours as they stand; its first row waits for the last one of the
    range before, and these two rows per range are the memory that is carried on.
    """
    placed = clicks.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "session", "ts", click_key(F.col("lon"), F.col("lat")).alias("place")
    )
    keys = ("session", "ts", "place")
    told = F.to_json(F.struct("session", "place"), {"ignoreNullFields": "false"})
    width = int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        placed.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
        .withColumn("told", told).withColumn("range", F.spark_partition_id())
    )

    names = [*ranged.columns, "place_in_range"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("told")
            before = pa.concat_arrays([
                pa.array([None if last is None else last.column("told")[0].as_py()], own.type),
                own.slice(0, len(own) - 1),
            ])
            changed = pc.fill_null(pc.not_equal(own, before), True)
            places = pa.repeat("inner", batch.num_rows)
            if last is None:
                places = pa.concat_arrays([pa.array(["first"]), places.slice(1)])
            rows = pa.record_batch([*batch.columns, places], names=names)
            yield rows.filter(changed)
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield pa.record_batch([*last.columns, pa.array(["last"])], names=names)

    schema = StructType([*ranged.schema.fields, StructField("place_in_range", StringType())])
    marked = cut_lineage(ranged.mapInArrow(run, schema))
    # two rows per range: the one window without a key sees no more than these
    ends = marked.where("place_in_range <> 'inner'").withColumn(
        "before", F.lag("told").over(Window.orderBy("range", "place_in_range"))
    )
    begun = ends.where("place_in_range = 'first'").where(~F.col("told").eqNullSafe(F.col("before")))
    inner = marked.where("place_in_range = 'inner'")
    return inner.select(*keys).unionByName(begun.select(*keys))
