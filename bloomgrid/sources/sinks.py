"""Writers. Parquet is the stored form; CSV and GeoJSON lines are for exchange."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.sources import tables


def write_csv(frame: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header; with `compression="gzip"`, whose files readers know by name, a table of many
    days and plants takes a small part of its plain size."""
    frame.write.mode("overwrite").option("header", True).csv(path, compression=compression)


def write_history_csv(daily: DataFrame, path: str) -> None:
    """Daily table under the collector's column names, in station and day order."""
    names = {"station_id": "stationId", "date": "data_dnia", "t_min": "T_min", "t_max": "T_max",
             "t_mean": "T_srednia"}
    ordered = daily.orderBy("station_id", "date")
    write_csv(ordered.select(*[F.col(c).alias(n) for c, n in names.items()]), path)


def refresh_daily_table(frame: DataFrame, path: str) -> None:
    """Full refresh of a (station, date) table: one folder per year, files split by range.

    Range partitioning samples the keys, so a year or a station that holds much of the data
    is spread over several files, and each file's station range is narrow for pruning.
    """
    ordered = (
        frame.withColumn("year", F.year("date"))
        .repartitionByRange("year", "station_id", "date")
        .sortWithinPartitions("year", "station_id", "date")
    )
    _swap_in(ordered, path, "year")


def refresh_table(frame: DataFrame, path: str) -> None:
    """Full refresh of an undated table (zones, plants)."""
    _swap_in(frame, path)


def _swap_in(frame: DataFrame, path: str, *parts: str) -> None:
    """Write beside the stored table and swap the folders when all is written.

    A write that fails leaves the stored table as it was, and the frame may read from the same
    path. Folders take two renames; tables that others read or write meanwhile, or that change in
    part, belong into `tables`, where a change is one rename.
    """
    spark, mark = frame.sparkSession, uuid.uuid4().hex
    fresh, former = f"{path.rstrip('/')}.fresh-{mark}", f"{path.rstrip('/')}.former-{mark}"
    frame.write.partitionBy(*parts).parquet(fresh)
    files = tables.file_system(spark, path)
    place, aside = tables.hadoop_path(spark, path), tables.hadoop_path(spark, former)
    if files.exists(place) and not files.rename(place, aside):
        raise OSError(f"cannot move {path}")
    if not files.rename(tables.hadoop_path(spark, fresh), place):
        files.rename(aside, place)
        raise OSError(f"cannot replace {path}")
    files.delete(aside, True)
    spark.catalog.refreshByPath(path)


def write_catalogue(scenes: DataFrame, path: str) -> None:
    """Replace exactly the collections present in the load; other collections stay."""
    (
        scenes.repartitionByRange("collection", "acquired_at", "id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection")
        .parquet(path)
    )


def store_catalogue(scenes: DataFrame, path: str) -> None:
    """As `write_catalogue`, for a table of `tables`: all collections of a load change in one step.

    The names of the load's collections are read to the driver.
    """
    spark, part, order = scenes.sparkSession, F.col("collection"), ("acquired_at", "id")
    state = tables.current(spark, path)
    if state is None:
        tables.refresh(scenes, path, part, order)
        return
    touched = [row[0] for row in scenes.select("collection").distinct().collect()]
    tables.replace_parts(scenes, path, part, touched, state, order)


def zone_features(zones: DataFrame) -> DataFrame:
    """One GeoJSON feature text per zone, all seven properties always present."""
    properties = F.struct(
        "cell_id", "station_id", "station_name", "area_ha",
        F.col("bloom_start_date").cast("string").alias("bloom_start_date"),
        F.col("bloom_end_date").cast("string").alias("bloom_end_date"),
        "bloom_tooltip",
    )
    return zones.select(
        "*",
        _feature(G.layer_geojson(F.col("geom_type"), F.col("polys")), properties).alias("feature"),
    )


def station_features(stations: DataFrame) -> DataFrame:
    """One GeoJSON point feature text per station."""
    geometry = F.to_json(G.point_geojson(F.col("lon"), F.col("lat")))
    properties = F.struct("station_id", "station_name", "station_type")
    return stations.select("*", _feature(geometry, properties).alias("feature"))


def location_features(locations: DataFrame) -> DataFrame:
    geometry = F.to_json(G.point_geojson(F.col("lon"), F.col("lat")))
    return locations.select("*", _feature(geometry, F.struct("name", "category")).alias("feature"))


def _feature(geometry_text, properties):
    return F.concat(
        F.lit('{"type":"Feature","geometry":'),
        F.coalesce(geometry_text, F.lit("null")),
        F.lit(',"properties":'),
        F.to_json(properties, {"ignoreNullFields": "false"}),
        F.lit("}"),
    )


def write_feature_lines(features: DataFrame, path: str) -> None:
    """A layer as one feature per line; this is the form for layers of any size."""
    features.select("feature").write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, limit: int) -> DataFrame:
    """One FeatureCollection text for a small layer; fails, never cuts, beyond `limit`.

    The count is taken first, so a large layer stops before it is gathered.
    """
    counted = features.agg(F.count("*").alias("n"))
    within = counted.select(
        F.when(F.col("n") <= limit, F.col("n")).otherwise(
            F.raise_error(F.lit("layer too large for one document; write feature lines"))
        )
    )
    guarded = features.where(F.lit(0) <= within.scalar())
    return guarded.agg(F.array_join(F.collect_list("feature"), ",").alias("body")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}"))
        .alias("document")
    )


def feature_documents(features: DataFrame, lon: Column, lat: Column, zoom: int = 8,
                      most: int = 1_000) -> DataFrame:
    """FeatureCollection texts per map tile (quadkey, number, document), for layers of any size.

    A tile with many features has several documents of about `most` each, dealt by a hash of the
    feature, so no task gathers more than one document.
    """
    point = F.struct(lon.alias("minx"), lat.alias("miny"), lon.alias("maxx"), lat.alias("maxy"))
    # features without a place share the documents of an empty quadkey
    key = F.coalesce(F.get(G.quadkeys(point, zoom), F.lit(0)), F.lit("")).alias("quadkey")
    placed = features.select(key, "feature")
    counts = placed.groupBy("quadkey").agg(F.ceil(F.count("*") / F.lit(most)).alias("documents"))
    number = F.pmod(F.hash("feature"), F.col("documents")).alias("number")
    told = placed.join(counts, "quadkey").select("quadkey", "feature", number)
    body = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return told.groupBy("quadkey", "number").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("document")
    )


def append_new_manifests(spark: SparkSession, manifests: DataFrame, path: str) -> None:
    """Write-once store: a digest that is stored already is not written again."""
    from bloomgrid.operators.mosaics import new_manifests

    try:
        stored = spark.read.parquet(path).select("digest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], "digest STRING")
    new_manifests(manifests, stored).write.mode("append").parquet(path)


def store_manifests(manifests: DataFrame, path: str) -> None:
    """As `append_new_manifests`, for several writers at once (a table of `tables`).

    A writer that finds the store changed since it looked looks again, so a digest is kept once,
    as the first writer had it.
    """
    from bloomgrid.operators.mosaics import new_manifests

    spark = manifests.sparkSession
    while True:
        state = tables.current(spark, path)
        fresh = manifests
        if state is not None:
            fresh = new_manifests(manifests, tables.read(spark, path, state))
        try:
            tables.append(fresh, path, state)
            return
        except tables.ChangedMeanwhile:
            continue


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested documents, one JSON object per line."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)
