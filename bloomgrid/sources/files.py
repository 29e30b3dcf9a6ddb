"""Readers for the landed files. Each returns a typed DataFrame; bad input fails the read.

The `*_rows` functions take documents that are already a column, so the same shaping runs on
files, tables and queries alike.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid import schemas
from bloomgrid.functions import geometry as G
from bloomgrid.functions.values import nan_to_null
from bloomgrid.sources import features, tables

#: A document that does not parse fails the job; `rejected_documents` finds it beforehand.
STRICT = {"mode": "FAILFAST"}


def _json(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", whole_file).json(path)


def _csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]],
         ordered: bool = False) -> DataFrame:
    """CSV with header; columns are taken by name, so their order and extra ones do not matter.

    `position` orders the rows as they stand in the files.
    """
    raw = spark.read.csv(path, header=True, nullValue="", mode="FAILFAST")
    picked = [_file_order().alias("position")] if ordered else []
    for name, (source, kind) in columns.items():
        value = F.col(source).cast(kind)
        picked.append((nan_to_null(value) if kind == "double" else value).alias(name))
    return raw.select(*picked)


def rejected_documents(documents: DataFrame, schema: str, text: str = "document") -> DataFrame:
    """Documents of a text column that do not parse with the schema, so that a job can go on.

    Rows without a document are no documents and not listed.
    """
    found = F.from_json(
        text, f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}
    )
    return documents.where(F.col(text).isNotNull() & found["_broken"].isNotNull())


def _file_order() -> Column:
    """Where a row stands: its file, the block of the file, and its place in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


# readings ---------------------------------------------------------------------------------


def reading_rows(pages: DataFrame) -> DataFrame:
    """All readings of all landed pages; a page without content adds none."""
    return pages.select(F.explode("content").alias("r")).select(
        F.col("r.stationId").alias("station_id"),
        F.col("r.measurementDate").alias("measured_at"),
        nan_to_null(F.col("r.airTemperature")).alias("air_temperature"),
    )


def read_reading_pages(spark: SparkSession, path: str) -> DataFrame:
    return reading_rows(_json(spark, path, schemas.READING_PAGE))


def parse_reading_pages(documents: DataFrame, text: str = "document") -> DataFrame:
    """As `read_reading_pages`, for pages held as a text column."""
    pages = documents.select(F.from_json(text, schemas.READING_PAGE, STRICT).alias("page"))
    return reading_rows(pages.select("page.content"))


def read_daily_history(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV in the collector's own column names."""
    return _csv(spark, path, {
        "station_id": ("stationId", "string"),
        "date": ("data_dnia", "date"),
        "t_min": ("T_min", "double"),
        "t_max": ("T_max", "double"),
        "t_mean": ("T_srednia", "double"),
    }, ordered=True)


def read_station_daily(spark: SparkSession, path: str) -> DataFrame:
    columns = {"station_id": "string", "date": "date", "t_min": "double", "t_max": "double",
               "t_mean": "double"}
    return _csv(spark, path, {name: (name, kind) for name, kind in columns.items()})


def read_station_gdd(spark: SparkSession, path: str) -> DataFrame:
    """Stored GDD rows; the temperature columns of the file are not loaded."""
    columns = {"station_id": "string", "plant_id": "string", "date": "date",
               "gdd_daily": "double", "gdd_cumulative": "double", "bloom_day": "int",
               "bloom_phase": "string"}
    return _csv(spark, path, {name: (name, kind) for name, kind in columns.items()})


# plants -----------------------------------------------------------------------------------


def read_plants(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.PLANT)


def parse_plants(documents: DataFrame, text: str = "document") -> DataFrame:
    """Plants of JSON arrays held as a text column."""
    return documents.select(F.inline(F.from_json(text, f"ARRAY<STRUCT<{schemas.PLANT}>>", STRICT)))


# layers -----------------------------------------------------------------------------------


def zone_rows(rows: DataFrame) -> DataFrame:
    """Zone layer from (position, feature) rows, geometry parsed and extent computed once."""
    polys = G.polygons(F.col("feature.geometry.type"), F.col("feature.geometry.coordinates"))
    flat = rows.select(
        F.col("position"),
        F.col("feature.properties.*"),
        F.col("feature.geometry.type").alias("geom_type"),
        polys.alias("polys"),
    ).withColumnRenamed("stationType", "station_type")
    return flat.withColumn("bbox", F.when(F.col("polys").isNotNull(), G.bbox_of(F.col("polys"))))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones from FeatureCollection files; `position` is the file and the place in it."""
    collections = _json(spark, path, schemas.ZONE_COLLECTION)
    rows = collections.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("at", "feature")
    )
    return zone_rows(rows.select(F.struct("file", "at").alias("position"), "feature"))


def read_large_zones(spark: SparkSession, path: str) -> DataFrame:
    """As `read_zones`, for collections of any size: every file is read by many tasks."""
    texts = features.read_feature_texts(spark, path)
    kind = F.from_json("text", "type STRING", STRICT)["type"]
    parsed = texts.where(kind == "Feature").select(
        "position", F.from_json("text", schemas.ZONE_FEATURE, STRICT).alias("feature")
    )
    return zone_rows(parsed)


def read_zone_lines(spark: SparkSession, path: str) -> DataFrame:
    """Zones from files with one feature per line, which split across tasks."""
    lines = _json(spark, path, schemas.ZONE_FEATURE, whole_file=False)
    return zone_rows(lines.select(
        _file_order().alias("position"),
        F.struct("type", "geometry", "properties").alias("feature"),
    ))


def parse_zone_collections(documents: DataFrame, text: str = "document") -> DataFrame:
    parsed = documents.select(F.from_json(text, schemas.ZONE_COLLECTION, STRICT).alias("fc"))
    return zone_rows(parsed.select(F.posexplode("fc.features").alias("position", "feature")))


def boundary_rings(documents: DataFrame) -> DataFrame:
    """Exterior rings of boundary documents, whichever of the three forms they take."""
    bare = F.array(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("type").alias("type"), F.col("coordinates").alias("coordinates"))
        .alias("geometry"),
    ))
    features = (
        F.when(F.col("type") == "FeatureCollection", F.col("features"))
        .when(F.col("type") == "Feature", F.array(F.struct("type", "geometry")))
        .otherwise(bare)
    )
    geometries = documents.select(F.explode(features).alias("f")).select("f.geometry.*")
    polys = G.polygons(F.col("type"), F.col("coordinates"))
    return geometries.select(F.explode(G.exterior_rings(polys)).alias("ring"))


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    return boundary_rings(_json(spark, path, schemas.BOUNDARY))


def parse_boundaries(documents: DataFrame, text: str = "document") -> DataFrame:
    return boundary_rings(
        documents.select(F.from_json(text, schemas.BOUNDARY, STRICT).alias("b")).select("b.*")
    )


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Named points; a feature without id takes its place in the file, from 1."""
    collections = _json(spark, path, schemas.LOCATION_COLLECTION)
    rows = collections.select(F.posexplode("features").alias("position", "f"))
    xy = G.point_xy(F.col("f.geometry.coordinates"))
    return rows.select(
        F.coalesce(F.col("f.id"), F.col("position").cast("bigint") + 1).alias("id"),
        F.col("f.properties.name").alias("name"),
        F.col("f.properties.category").alias("category"),
        xy[0].alias("lon"),
        xy[1].alias("lat"),
    )


# precipitation ----------------------------------------------------------------------------


def precipitation_rows(files: DataFrame) -> DataFrame:
    """(file_name, document) rows, one per station and year -> one row per station and day.

    A name that is not `<station>_<year>.json` is refused. Where several files give a day of a
    station, the last by name counts (of one name, the larger value).
    """
    name = r"^(.+)_(\d{4})\.json$"
    station = F.when(F.regexp_like("file_name", F.lit(name)), F.regexp_extract("file_name", name, 1))
    refused = F.raise_error(F.concat(F.lit("not a precipitation file: "), F.col("file_name")))
    days = files.select(
        F.coalesce(station, refused.cast("string")).alias("station_id"), "file_name",
        F.explode(F.from_json("document", "MAP<STRING, DOUBLE>", STRICT)).alias("day", "precip_mm"),
    )
    return days.groupBy("station_id", F.to_date("day").alias("date")).agg(
        F.max(F.struct("file_name", "precip_mm"))["precip_mm"].alias("precip_mm")
    )


def read_precipitation(spark: SparkSession, path: str) -> DataFrame:
    """Files named `<station>_<year>.json`, each a day -> mm object of at most 366 entries."""
    texts = spark.read.text(path, wholetext=True)
    return precipitation_rows(
        texts.select(F.col("_metadata.file_name").alias("file_name"),
                     F.col("value").alias("document"))
    )


# catalogue --------------------------------------------------------------------------------


def scene_rows(items: DataFrame, *others: str) -> DataFrame:
    """Flat scene table from STAC items, as it is stored and filtered."""
    props = F.col("properties")
    stamp = props["datetime"]
    # stamps are kept in UTC, whatever their offset and the session's zone
    utc = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), stamp.try_cast("timestamp").cast("timestamp_ntz")
    )
    return items.select(
        "id",
        "collection",
        utc.alias("acquired_at"),
        stamp.alias("datetime"),
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))],
        props["grid:code"].alias("grid_code"),
        nan_to_null(props["eo:cloud_cover"]).alias("cloud_cover"),
        nan_to_null(props["s2:nodata_pixel_percentage"]).alias("nodata_pct"),
        props["platform"].alias("platform"),
        "assets",
        *others,
    )


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of item files; `position` orders them as they stand in the files."""
    items = _json(spark, path, schemas.STAC_ITEM)
    return scene_rows(items.withColumn("position", _file_order()), "position")


def parse_scenes(documents: DataFrame, text: str = "document") -> DataFrame:
    """Scenes of JSON arrays of items held as a text column."""
    parsed = documents.select(F.inline(F.from_json(text, f"ARRAY<STRUCT<{schemas.STAC_ITEM}>>", STRICT)))
    return scene_rows(parsed)


def read_stac_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collection documents; `position` orders them as they stand in the files."""
    return _json(spark, path, schemas.STAC_COLLECTION).withColumn("position", _file_order())


def parse_stac_collections(documents: DataFrame, text: str = "document") -> DataFrame:
    """As `read_stac_collections`, for documents held as a text column."""
    parsed = documents.select(F.from_json(text, schemas.STAC_COLLECTION, STRICT).alias("c"))
    return parsed.select("c.*")


# requests ---------------------------------------------------------------------------------


def request_urls(requests: DataFrame) -> DataFrame:
    """URL lists of any length as (request_id, url) rows."""
    return requests.select("request_id", F.explode("urls").alias("url"))


def read_table(spark: SparkSession, path: str, parts: Iterable | None = None) -> DataFrame:
    """A stored table: the latest state where it has states (see `tables`), else plain Parquet.

    `parts` reads only these parts of a table that is kept in parts.
    """
    state = tables.current(spark, path)
    return spark.read.parquet(path) if state is None else tables.read(spark, path, state, parts)
