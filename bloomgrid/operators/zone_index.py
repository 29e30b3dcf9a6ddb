"""The zone index stored beside a layer: built once, looked up by any number of batches of points.

Every zone belongs to a few root cells, grid cells of about its size; crowded ones are halved inside
themselves, so what the index holds for a root follows from the zones of that root alone. Roots are
kept in parts by the region of space they begin in, numbered along a Z-order curve, and rows of
a part are sorted along it, too.

When zones change, the digests of stored and new ones name the roots that differ. Only those are
built again, and only the parts they lie in are written; the change is one step (see `tables`).
Beside the cells, in `roots`, lies the list of digests by root, from which changes are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.operators import spatial
from bloomgrid.session import cut_lineage
from bloomgrid.sources import tables

#: Regions are squares of one degree.
REGION_LEVEL = 10
#: Region numbers run from 0 to 2**9 - 1 along either axis.
REGION_BITS, REGION_SHIFT = 9, 180
ROOT = ["root_level", "root_x", "root_y"]
ORDER = ("level", "code")


def _region(level: Column, gx: Column, gy: Column) -> Column:
    """Number of the region in which a root cell begins."""
    side = F.lit(spatial.FINEST_SIDE) * F.pow(F.lit(2.0), level)
    wide = F.lit(spatial.FINEST_SIDE * 2.0**REGION_LEVEL)

    def along(cell: Column) -> Column:
        place = F.floor(cell * side / wide) + REGION_SHIFT
        return F.greatest(F.least(place, F.lit(2**REGION_BITS - 1)), F.lit(0))

    return G.interleaved(along(gx), along(gy), REGION_BITS)


def _part() -> Column:
    return _region(*map(F.col, ROOT))


def _roots(zones: DataFrame) -> DataFrame:
    found = spatial.shape_roots(spatial.zone_shapes(zones))
    cell = dict(zip(ROOT, ("level", "gx", "gy"), strict=True))
    return found.select("*", *[F.col(old).alias(new) for new, old in cell.items()])


def _cells(roots: DataFrame) -> DataFrame:
    """Index rows of roots, crowded cells halved, with their place on the curve and their size."""
    cells = spatial.relieve_cells(
        spatial.root_cells(roots.drop("digest")), cell=(*ROOT, *spatial.CELL)
    )
    steps = F.lit(2**20)  # cells of either sign, as whole numbers from 0
    code = G.interleaved(F.col("gx") + steps, F.col("gy") + steps, 21)
    return cells.withColumn("code", code).withColumn("bytes", spatial.cell_bytes())


def _paths(path: str) -> tuple[str, str]:
    return f"{path}/cells", f"{path}/roots"


def store(zones: DataFrame, path: str) -> None:
    """Build the index of a layer anew."""
    cells_path, roots_path = _paths(path)
    roots = cut_lineage(_roots(zones))
    tables.refresh(_cells(roots), cells_path, _part(), ORDER)
    tables.refresh(roots.select("digest", *ROOT), roots_path, _part())


def update(zones: DataFrame, path: str) -> list[int]:
    """Bring the index up to the layer's present state; returns the parts that were written.

    The digests by root of both sides are compared in one join, without outlines. The cells change
    before the list, so a run that broke off between the two is simply repeated.
    """
    spark, (cells_path, roots_path) = zones.sparkSession, _paths(path)
    listed, held = tables.current(spark, roots_path), tables.current(spark, cells_path)
    if listed is None or held is None:
        raise ValueError(f"no zone index at {path}; store one first")
    fresh = _roots(zones)
    now = fresh.select("digest", *ROOT, F.lit(True).alias("now"))
    before = tables.read(spark, roots_path, listed).withColumn("before", F.lit(True))
    differing = now.join(before, ["digest", *ROOT], "full").where("now IS NULL OR before IS NULL")
    changed = cut_lineage(differing.select(*ROOT, _part().alias("part")).distinct())
    parts = sorted(row[0] for row in changed.select("part").distinct().collect())
    if not parts:
        return []
    made = _cells(fresh.join(changed.select(*ROOT), ROOT, "left_semi").select(*fresh.columns))
    stored = tables.read(spark, cells_path, held, parts)
    kept = stored.join(changed.select(*ROOT), ROOT, "left_anti").select(*stored.columns)
    whole = kept.unionByName(made.select(*stored.columns))
    tables.replace_parts(whole, cells_path, _part(), parts, held, ORDER)
    present = now.drop("now").where(_part().isin(parts))
    tables.replace_parts(present, roots_path, _part(), parts, listed)
    return parts


def opened(spark: SparkSession, path: str, points: DataFrame | None = None) -> spatial.ZoneIndex:
    """The stored index. With `points` (lon, lat) only the parts in which they can lie are read."""
    cells_path, roots_path = _paths(path)
    parts = None
    if points is not None:
        roots = tables.read(spark, roots_path, tables.current(spark, roots_path))
        levels = [row[0] for row in roots.select("root_level").distinct().collect()]
        places = points.select(F.explode(F.array(*[
            _region(F.lit(n), spatial.cell_of("lon", n), spatial.cell_of("lat", n)) for n in levels
        ]).cast("array<long>")).alias("part"))
        parts = [row[0] for row in places.distinct().collect()]
    cells = tables.read(spark, cells_path, tables.current(spark, cells_path), parts)
    census = cells.agg(
        F.array_sort(F.collect_set("level")).alias("levels"), F.sum("bytes").alias("bytes")
    ).first()
    held = cells.select("zone", "bbox", "edges", "whole", "level", "gx", "gy")
    return spatial.ZoneIndex(held, census["levels"], census["bytes"] or 0)
