"""Data-quality rules: keys, required values, argument ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KEYS = {
    "station_daily": ("station_id", "date"),
    "station_gdd": ("station_id", "plant_id", "date"),
    "honey_plants": ("id",),
}
REQUIRED = {
    "weather_cells": ("station_id", "station_name"),
    "honey_plants": ("id", "name_pl", "name_latin", "base_temp_c", "gdd_min", "gdd_max"),
    "station_daily": ("station_id", "date"),
    "station_gdd": ("station_id", "plant_id", "date"),
    "zone_features": ("cell_id", "station_id", "station_name"),
    "bloom_status": (
        "station_id", "date", "plant_id", "plant_name", "gdd_cumulative", "bloom_day",
        "bloom_phase", "bloom_phase_label", "gdd_min", "gdd_max",
    ),
}
FIRST_YEAR, LAST_YEAR = 2000, 2100
MAX_URLS_PER_REQUEST = 32


def duplicate_keys(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once; empty when the key holds."""
    return frame.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def missing_values(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, missing) rows, counted in one pass."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns
    ])
    return counts.select(F.inline(pairs))


def missing_as_written(frame: DataFrame, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Write the frame; (column, missing) rows counted by that same run, not by a second one."""
    seen = Observation()
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    frame.observe(seen, F.count("*").alias("_rows"), *counts).write.mode("overwrite").parquet(path)
    rows = [(c, seen.get[c]) for c in columns]
    return frame.sparkSession.createDataFrame(rows, "column STRING, missing BIGINT")


def complete_rows(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows that have every required value."""
    return frame.where(_complete(columns))


def rejected_rows(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows that lack a required value, with the names of what they lack."""
    lacking = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    )
    return frame.where(~_complete(columns)).withColumn("lacking", lacking)


def _complete(columns: tuple[str, ...]):
    test = F.lit(True)
    for column in columns:
        test = test & F.col(column).isNotNull()
    return test


def unknown_totals(gdd: DataFrame) -> DataFrame:
    """Days per plant whose phase rests on a missing total."""
    return gdd.groupBy("plant_id").agg(
        F.count_if(F.col("gdd_cumulative").isNull()).alias("days_without_total"),
        F.count("*").alias("days"),
    )


def all_missing(frame: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Whether a column has no value at all in a group."""
    return frame.groupBy(*keys).agg((F.count(column) == 0).alias("all_missing"))


def check_year(year: int) -> int:
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"year must be {FIRST_YEAR} to {LAST_YEAR}")
    return year


def refused_requests(requests: DataFrame) -> DataFrame:
    """URL lists (request_id, urls) outside 1 to MAX_URLS_PER_REQUEST entries, with the reason."""
    links = F.coalesce(F.size("urls"), F.lit(0))
    reason = F.when(links < 1, "no links").when(links > MAX_URLS_PER_REQUEST, "too many links")
    return requests.select("request_id", links.alias("links"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def refused_years(requests: DataFrame) -> DataFrame:
    """Requests whose year a single request may not ask for (see check_year)."""
    return requests.where(
        F.col("year").isNull() | ~F.col("year").between(FIRST_YEAR, LAST_YEAR)
    ).distinct()
