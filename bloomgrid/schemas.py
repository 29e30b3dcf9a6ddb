"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

READING_PAGE = (
    "content ARRAY<STRUCT<stationId: STRING, measurementDate: STRING, airTemperature: DOUBLE>>"
)

DAILY = "station_id STRING, date DATE, t_min DOUBLE, t_max DOUBLE, t_mean DOUBLE"

GDD = (
    "station_id STRING, plant_id STRING, date DATE, t_min DOUBLE, t_max DOUBLE, t_mean DOUBLE, "
    "gdd_daily DOUBLE, gdd_cumulative DOUBLE, bloom_day INT, bloom_phase STRING"
)

PLANT = (
    "id STRING, name_pl STRING, name_latin STRING, base_temp_c DOUBLE, gdd_min DOUBLE, "
    "gdd_max DOUBLE, season STRING"
)

# `coordinates` nests to a different depth per geometry type, so it is read as text first.
GEOMETRY_TEXT = "STRUCT<type: STRING, coordinates: STRING>"

ZONE_PROPERTIES = (
    "STRUCT<cell_id: INT, station_id: STRING, station_name: STRING, area_ha: DOUBLE, "
    "latitude: DOUBLE, longitude: DOUBLE, stationType: STRING>"
)

ZONE_FEATURE = f"type STRING, geometry {GEOMETRY_TEXT}, properties {ZONE_PROPERTIES}"

ZONE_COLLECTION = (
    f"type STRING, features ARRAY<STRUCT<type: STRING, geometry: {GEOMETRY_TEXT}, "
    f"properties: {ZONE_PROPERTIES}>>"
)

# One document may be a FeatureCollection, a Feature or a bare geometry.
BOUNDARY = (
    f"type STRING, coordinates STRING, geometry {GEOMETRY_TEXT}, "
    f"features ARRAY<STRUCT<type: STRING, geometry: {GEOMETRY_TEXT}>>"
)

LOCATION_COLLECTION = (
    f"type STRING, features ARRAY<STRUCT<type: STRING, id: BIGINT, geometry: {GEOMETRY_TEXT}, "
    "properties: STRUCT<name: STRING, category: STRING>>>"
)

POLYGONS = "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
POLYGON = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
BBOX = "STRUCT<minx: DOUBLE, miny: DOUBLE, maxx: DOUBLE, maxy: DOUBLE>"

STAC_COLLECTION = (
    "id STRING, stac_version STRING, title STRING, description STRING, license STRING, "
    "extent STRUCT<spatial: STRUCT<bbox: ARRAY<ARRAY<DOUBLE>>>, "
    "temporal: STRUCT<interval: ARRAY<ARRAY<STRING>>>>"
)

ASSETS = "MAP<STRING, STRUCT<href: STRING, type: STRING, title: STRING, roles: ARRAY<STRING>>>"

STAC_ITEM = (
    "id STRING, collection STRING, bbox ARRAY<DOUBLE>, "
    "properties STRUCT<`datetime`: STRING, `grid:code`: STRING, `eo:cloud_cover`: DOUBLE, "
    "`s2:nodata_pixel_percentage`: DOUBLE, platform: STRING>, "
    f"assets {ASSETS}"
)

# Items as stored: flat columns, so that bbox, time and cloud filters reach the Parquet scan.
SCENE = (
    "id STRING, collection STRING, acquired_at TIMESTAMP_NTZ, datetime STRING, "
    "minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE, grid_code STRING, "
    f"cloud_cover DOUBLE, nodata_pct DOUBLE, platform STRING, assets {ASSETS}"
)
