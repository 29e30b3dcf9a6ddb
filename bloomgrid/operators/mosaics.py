"""Mosaic manifests: which images cover which map tile, for sets of image links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G

QUADKEY_ZOOM = 7
MAX_ZOOM = 13


def url_set(urls: Column) -> Column:
    return F.array_sort(F.array_distinct(urls))


def set_digest(urls: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the ordered distinct links, joined by `|`."""
    return F.substring(F.sha2(F.array_join(url_set(urls), "|"), 256), 1, 16)


def link_lists(request_urls: DataFrame) -> DataFrame:
    """Requests as (request_id, urls), links distinct and ordered, however many there are.

    `request_urls`: request_id, url, one row per listed link. Repeated links of a request are
    merged before the only shuffle. Whoever wants to refuse a request for its number of links asks
    `quality.refused_requests` first.
    """
    listed = request_urls.where(F.col("url").isNotNull())
    return listed.groupBy("request_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def request_digests(requests: DataFrame) -> DataFrame:
    """Digest and number of links per request."""
    return requests.select(
        "request_id",
        set_digest(F.col("urls")).alias("digest"),
        F.size(url_set(F.col("urls"))).alias("tile_count"),
    )


def distinct_sets(requests: DataFrame) -> DataFrame:
    """One row per link set, however many requests ask for it."""
    return requests.select(
        set_digest(F.col("urls")).alias("digest"), url_set(F.col("urls")).alias("urls")
    ).distinct()


def new_manifests(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Those whose digest is not stored yet."""
    return candidates.join(stored.select("digest"), "digest", "left_anti")


def _links(sets: DataFrame, footprints: DataFrame) -> DataFrame:
    links = sets.select("digest", F.size("urls").alias("links"), F.explode("urls").alias("url"))
    return links.join(footprints.select("url", "bbox"), "url", "left")


def incomplete_sets(sets: DataFrame, footprints: DataFrame) -> DataFrame:
    """Sets with links of unknown footprint, and these links in order."""
    unknown = _links(sets, footprints).where(F.col("bbox").isNull())
    return unknown.groupBy("digest", "links").agg(
        F.array_sort(F.collect_list("url")).alias("missing")
    )


def placed_sets(sets: DataFrame, footprints: DataFrame) -> DataFrame:
    """(digest, links, places) of complete sets: their (url, bbox) pairs in one list.

    `footprints` has one row per link. A set that lacks a footprint has no row at all, so that
    neither its index nor its extent is built from a part of it.
    """
    listed = _links(sets, footprints).groupBy("digest").agg(
        F.max("links").alias("links"),
        F.collect_list(F.struct("url", "bbox")).alias("places"),
        F.min(F.col("bbox").isNotNull()).alias("complete"),
    )
    return listed.where("complete").drop("complete")


def placed_links(sets: DataFrame, footprints: DataFrame) -> DataFrame:
    """(digest, links, url, bbox) rows of `placed_sets`."""
    return placed_sets(sets, footprints).select("digest", "links", F.inline("places"))


def quadkey_index(placed: DataFrame, zoom: int = QUADKEY_ZOOM) -> DataFrame:
    """Ordered links per set and quadkey; a list is at most as long as its set's."""
    tiles = placed.select("digest", "url", F.explode(G.quadkeys(F.col("bbox"), zoom)).alias("quadkey"))
    return tiles.groupBy("digest", "quadkey").agg(
        F.array_sort(F.collect_set("url")).alias("urls")
    )


def mosaic_extent(placed: DataFrame) -> DataFrame:
    """Union of the footprints of each set, and its centre."""
    box = F.col("bbox")
    extent = placed.groupBy("digest").agg(
        F.min(box["minx"]).alias("minx"), F.min(box["miny"]).alias("miny"),
        F.max(box["maxx"]).alias("maxx"), F.max(box["maxy"]).alias("maxy"),
    )
    return extent.withColumn("center_lon", (F.col("minx") + F.col("maxx")) / 2.0).withColumn(
        "center_lat", (F.col("miny") + F.col("maxy")) / 2.0
    )


def _with_tiles(placed: DataFrame, zoom: int) -> DataFrame:
    """`tiles`, a map from quadkey to ordered links, of rows of `placed_sets`.

    A footprint meets one tile at least. Ordered (quadkey, link) pairs are cut where the quadkey
    changes, so the work on a set follows the length of its lists, not links times tiles.
    """
    pairs = F.flatten(F.transform("places", lambda place: F.transform(
        G.quadkeys(place["bbox"], zoom),
        lambda key: F.struct(key.alias("quadkey"), place["url"].alias("url")))))
    entry = lambda i: F.get(F.col("pairs"), i)
    once = F.filter("pairs", lambda pair, i: ~pair.eqNullSafe(entry(i - 1)))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("pairs") - 1),
        lambda i: ~entry(i)["quadkey"].eqNullSafe(entry(i - 1)["quadkey"]),
    )

    def tile(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("pairs")) - 1
        urls = F.transform(F.sequence(start, end), lambda i: entry(i)["url"])
        return F.struct(entry(start)["quadkey"].alias("quadkey"), urls.alias("urls"))

    return (
        placed.withColumn("pairs", F.sort_array(pairs)).withColumn("pairs", once)
        .withColumn("starts", starts)
        .withColumn("tiles", F.map_from_entries(F.transform("starts", tile)))
        .drop("pairs", "starts")
    )


def manifests(sets: DataFrame, footprints: DataFrame, zoom: int = QUADKEY_ZOOM,
              max_zoom: int = MAX_ZOOM) -> DataFrame:
    """Full manifest per link set.

    A set's links meet their footprints in one row, and tile lists and extent are made inside it:
    no row per link and tile is sorted or shuffled. Sets with a link of unknown footprint are named
    by `incomplete_sets` and have no manifest.
    """
    box = F.col("places")["bbox"]
    per_set = _with_tiles(placed_sets(sets, footprints), zoom).select(
        "digest", "tiles",
        F.array_min(box["minx"]).alias("minx"), F.array_min(box["miny"]).alias("miny"),
        F.array_max(box["maxx"]).alias("maxx"), F.array_max(box["maxy"]).alias("maxy"),
    )
    return per_set.select(
        "digest",
        F.lit(zoom).alias("minzoom"),
        F.lit(max_zoom).alias("maxzoom"),
        F.lit(zoom).alias("quadkey_zoom"),
        F.array("minx", "miny", "maxx", "maxy").alias("bounds"),
        F.array(
            (F.col("minx") + F.col("maxx")) / 2.0,
            (F.col("miny") + F.col("maxy")) / 2.0,
            F.lit(float(zoom)),
        ).alias("center"),
        "tiles",
    )
