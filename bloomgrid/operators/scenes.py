"""Scene search, best scene per tile and the state of the catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.functions import scenes as S
from bloomgrid.functions.values import iso_day


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_interval(interval: str) -> Column:
    """`start/end` with both ends included; `..` or nothing leaves a side open."""
    start, _, end = interval.partition("/")
    if "/" not in interval:
        end = start
    acquired = F.col("acquired_at")
    test = acquired.isNotNull()
    if start not in ("", ".."):
        test = test & (acquired >= _stamp(start))
    if end not in ("", ".."):
        test = test & (acquired <= _stamp(end))
    return test


def search_scenes(
    scenes: DataFrame,
    first: dt.date,
    last: dt.date,
    max_cloud: float,
    bbox: tuple[float, float, float, float] = S.REGION_BBOX,
    limit: int | None = None,
) -> DataFrame:
    """Scenes that match and have an image link; their rank is by (cloud_cover, id).

    All of them, unless the caller asks for one page: then the `limit` clearest are taken before
    the link test. Every other filter is a comparison on a stored column and reaches the scan.
    """
    if last < first:
        last = first
    found = scenes.where(
        (F.col("collection") == S.SCENE_COLLECTION)
        & S.overlaps(bbox)
        & in_interval(f"{first.isoformat()}T00:00:00Z/{last.isoformat()}T23:59:59Z")
        & (F.col("cloud_cover") < F.lit(float(max_cloud)))
    )
    if limit is not None:
        found = found.orderBy("cloud_cover", "id").limit(limit)
    return with_links(found)


def with_links(scenes: DataFrame) -> DataFrame:
    """Scenes of the collection that have an image link."""
    href = S.visual_href(F.col("assets"))
    return scenes.where(
        (F.col("collection") == S.SCENE_COLLECTION) & href.isNotNull()
    ).withColumn("href", href)


def with_tile(scenes: DataFrame) -> DataFrame:
    return scenes.withColumn("tile", S.tile_id(F.col("grid_code"), F.col("id")))


def in_region(tiled: DataFrame) -> DataFrame:
    """Scenes on the region's tiles."""
    return tiled.where(F.col("tile").isin(*S.REGION_TILES))


def best_per_tile(scenes: DataFrame, order: tuple[str, ...] = ("cloud_cover", "id")) -> DataFrame:
    """Best scene of each region tile: fewest empty pixels, then fewest clouds, then rank.

    `order` names the columns of the search order. The least struct is an aggregate that
    combines before the shuffle, so at most one row per tile and task moves.
    """
    tiled = in_region(with_tile(scenes))
    nodata, cloud = S.score(F.col("nodata_pct"), F.col("cloud_cover"))
    payload = [c for c in scenes.columns if c not in (*order, "assets")]
    ranked = F.struct(
        nodata.alias("nodata"), cloud.alias("cloud"),
        *[F.col(c).alias(f"by_{c}") for c in order],
        F.struct(*[F.col(c) for c in order], *payload).alias("scene"),
    )
    best = tiled.groupBy("tile").agg(F.min(ranked).alias("best"))
    return best.select("tile", "best.nodata", "best.cloud", "best.scene.*")


def tile_details(best: DataFrame) -> DataFrame:
    """One line per covered tile, in tile order."""
    return best.select(
        S.short_tile(F.col("tile")).alias("tile"),
        iso_day(F.coalesce("datetime", F.lit(""))).alias("day"),
        S.scene_platform(F.col("id"), F.col("platform")).alias("platform"),
        F.col("cloud").alias("cloud"),
        F.col("nodata").alias("nodata"),
    ).orderBy("tile")


def region_tiles(best: DataFrame) -> DataFrame:
    """The region's fixed tile list."""
    tiles = F.array(*[F.lit(t) for t in S.REGION_TILES])
    return best.sparkSession.range(1).select(F.explode(tiles).alias("tile"))


def missing_tiles(best: DataFrame) -> DataFrame:
    """Region tiles without a scene, by short name."""
    missing = region_tiles(best).join(best.select("tile"), "tile", "left_anti")
    return missing.select(S.short_tile(F.col("tile")).alias("tile")).orderBy("tile")


def partial_tiles(best: DataFrame) -> DataFrame:
    """Tiles whose best scene has many empty pixels."""
    return best.where(F.col("nodata") > S.PARTIAL_NODATA_PCT).select(
        S.short_tile(F.col("tile")).alias("tile"), "nodata"
    ).orderBy("tile")


def coverage(best: DataFrame) -> DataFrame:
    """One-row report over the best scenes; every list is bounded by the region's tiles."""
    day = iso_day(F.coalesce("datetime", F.lit("")))
    platform = S.scene_platform(F.col("id"), F.col("platform"))
    short = S.short_tile(F.col("tile"))
    partial = F.when(F.col("nodata") > S.PARTIAL_NODATA_PCT, short)
    all_short = F.array(*[F.lit(t.removeprefix(S.TILE_PREFIX)) for t in S.REGION_TILES])
    report = best.agg(
        F.count("*").cast("int").alias("covered"),
        F.avg("cloud").alias("avg_cloud"),
        F.max("cloud").alias("max_cloud"),
        F.max("nodata").alias("max_nodata"),
        F.count_distinct(day).cast("int").alias("dates"),
        F.array_sort(F.collect_set(platform)).alias("platforms"),
        F.array_sort(F.collect_set(partial)).alias("partial"),
        F.collect_set(short).alias("found"),
    )
    return report.select(
        "covered",
        F.lit(len(S.REGION_TILES)).alias("wanted"),
        F.array_sort(F.array_except(all_short, F.col("found"))).alias("missing"),
        "avg_cloud", "max_cloud", "max_nodata", "dates", "platforms", "partial",
    )


def ordered_links(best: DataFrame) -> DataFrame:
    """The chosen image links in order, one per region tile at most."""
    return best.agg(F.array_sort(F.collect_list("href")).alias("urls"))


# catalogue --------------------------------------------------------------------------------


def search_catalogue(items: DataFrame, bbox: tuple[float, float, float, float], interval: str,
                     ) -> DataFrame:
    """Items that meet the rectangle and the interval."""
    return items.where(S.overlaps(bbox) & in_interval(interval))


def item_summary(items: DataFrame) -> DataFrame:
    return items.select(
        "id", "minx", "miny", "maxx", "maxy", "datetime",
        F.map_keys("assets").alias("asset_keys"),
    )


def items_per_collection(items: DataFrame) -> DataFrame:
    return items.groupBy("collection").agg(F.count("*").alias("items"))


def replace_collections(stored: DataFrame, load: DataFrame,
                        collections: DataFrame | None = None, order: str = "position",
                        ) -> DataFrame:
    """Catalogue after a load: its collections' old items go, its items come, last id wins.

    `collections` names them when a load may hold no item of one; it is the catalogue's own list
    of collections, or the load's. The planner sends a short list to the stored items, and splits
    a long one's join where one collection holds much of the catalogue.
    """
    values = [c for c in stored.columns if c not in ("id", "collection")]
    last = load.groupBy("collection", "id").agg(
        F.max_by(F.struct(*values), F.col(order)).alias("v")
    )
    names = (last if collections is None else collections).select("collection").distinct()
    kept = stored.join(names, "collection", "left_anti")
    return kept.unionByName(last.select("id", "collection", *[f"v.{c}" for c in values]))


def upsert_by_id(stored: DataFrame, load: DataFrame, order: str = "position") -> DataFrame:
    """Collection documents after a load: a loaded id replaces the stored one, last wins.

    One grouped pick over both sides, which combines before the shuffle.
    """
    values = [c for c in stored.columns if c != "id"]
    rank = F.struct(F.lit(1).alias("loaded"), F.col(order).alias("at"))
    none = F.struct(
        F.lit(0).alias("loaded"), F.lit(None).cast(load.schema[order].dataType).alias("at")
    )
    both = stored.select("id", F.struct(*values).alias("v"), none.alias("rank")).unionByName(
        load.select("id", F.struct(*values).alias("v"), rank.alias("rank"))
    )
    return both.groupBy("id").agg(F.max_by("v", "rank").alias("v")).select("id", "v.*")
