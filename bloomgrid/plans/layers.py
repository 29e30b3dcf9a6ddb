"""Layer exchange and point questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.functions import labels as L
from bloomgrid.operators import layers, spatial
from bloomgrid.sources import sinks


def station_point_features(zones: DataFrame) -> DataFrame:
    """Station points layer as features."""
    return sinks.station_features(layers.station_points(zones))


def zone_layer(zones: DataFrame) -> DataFrame:
    """Zone layer as features."""
    return sinks.zone_features(zones)


def simplified_zone_layer(zones: DataFrame, tolerance: float = layers.SIMPLIFY_TOLERANCE,
                          ) -> DataFrame:
    """Zone layer as features with simplified outlines."""
    return sinks.zone_features(layers.simplify(zones, tolerance))


def zone_tips(zones: DataFrame) -> DataFrame:
    """The texts a map shows for a zone."""
    c = F.col
    dates = (c("bloom_start_date"), c("bloom_end_date"))
    return zones.select(
        "cell_id",
        L.zone_tip(c("station_name"), c("station_id"), *dates, c("bloom_tooltip")).alias("tip"),
        L.zone_hover(c("station_name"), *dates).alias("hover"),
        L.zone_popup(*dates, c("bloom_tooltip")).alias("popup"),
    )


def zone_at_point(points: DataFrame, zones: DataFrame, key: str = "point_id") -> DataFrame:
    """Station of the zone that contains each point."""
    hit = spatial.zones_at_points(points, zones, key)
    return hit.select(key, "station_id", "station_name", "area_ha")


def locations_in_bbox(locations: DataFrame, minx: float, miny: float, maxx: float, maxy: float,
                      ) -> DataFrame:
    return spatial.within_bbox(locations, minx, miny, maxx, maxy)


def locations_by_id(locations: DataFrame, ids: DataFrame) -> DataFrame:
    """Locations whose id is asked for."""
    return locations.join(ids.select("id").distinct(), "id", "left_semi")
