"""Readings to daily temperatures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.functions.values import (
    end_of_day,
    in_year,
    nan_to_null,
    reading_day,
    round2,
    start_of_day,
)
from bloomgrid.quality import check_year

CHUNK_DAYS = 90


def extraction_plan(stations: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Fetch windows of 90 days per distinct station; the last one ends on `last`."""
    starts = F.sequence(F.lit(first), F.lit(last), F.expr(f"INTERVAL {CHUNK_DAYS} DAYS"))
    windows = stations.select("station_id").distinct().select(
        "station_id", F.explode(starts).alias("chunk_start")
    )
    end = F.least(F.date_add("chunk_start", CHUNK_DAYS - 1), F.lit(last))
    return windows.withColumn("chunk_end", end).select(
        "*",
        start_of_day(F.col("chunk_start")).alias("after"),
        end_of_day(F.col("chunk_end")).alias("before"),
    )


def daily_extremes(readings: DataFrame) -> DataFrame:
    """Minimum, maximum and their mean per station and day.

    `readings`: station_id, air_temperature and either `measured_at` (ISO text) or `date`.
    Rows without a key are left out, missing temperatures are skipped, and a day with none
    but missing ones stays with NULL values. Both aggregates combine before the shuffle.
    """
    if "date" not in readings.columns:
        readings = readings.withColumn("date", reading_day(F.col("measured_at")))
    temperature = nan_to_null(F.col("air_temperature"))
    extremes = (
        readings.where(F.col("station_id").isNotNull() & F.col("date").isNotNull())
        .groupBy("station_id", "date")
        .agg(F.min(temperature).alias("t_min"), F.max(temperature).alias("t_max"))
    )
    mean = round2((F.col("t_max") + F.col("t_min")) / F.lit(2.0))
    return extremes.withColumn("t_mean", mean)


def keep_last(old: DataFrame, new: DataFrame, order: str = "position") -> DataFrame:
    """History and fresh rows; of rows with the same station and day the last one stays.

    `order` tells how the old rows were stored (any sortable column). New rows (already one per
    key) come after all of them. `max_by` combines before the shuffle, so repeated keys do not
    pile up.
    """
    values = ["t_min", "t_max", "t_mean"]
    place = F.struct(F.lit(0).alias("fresh"), F.col(order).alias("at"))
    stored = old.select("station_id", "date", *values, place.alias("_seq"))
    kind = stored.schema["_seq"].dataType["at"].dataType
    last = F.struct(F.lit(1).alias("fresh"), F.lit(None).cast(kind).alias("at"))
    both = stored.unionByName(new.select("station_id", "date", *values, last.alias("_seq")))
    return both.groupBy("station_id", "date").agg(
        *[F.max_by(value, "_seq").alias(value) for value in values]
    )


def history_profile(daily: DataFrame) -> DataFrame:
    """Stations, rows, first and last day."""
    return daily.agg(
        F.count_distinct("station_id").alias("stations"),
        F.count("*").alias("days"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def days_of_year(frame: DataFrame, year: int) -> DataFrame:
    """Rows of one calendar year."""
    return frame.where(in_year(F.col("date"), check_year(year)))


def station_ids(frame: DataFrame) -> DataFrame:
    """Distinct station ids in order."""
    return frame.select("station_id").distinct().orderBy("station_id")


def monthly_precipitation(precipitation: DataFrame) -> DataFrame:
    """Sum per station, year and month; months without entries have no row."""
    return precipitation.groupBy(
        "station_id", F.year("date").alias("year"), F.month("date").alias("month")
    ).agg(F.sum("precip_mm").alias("precip_mm"))


def annual_precipitation(monthly: DataFrame) -> DataFrame:
    """Sum over every month present, whether or not readings exist for it."""
    return monthly.groupBy("station_id", "year").agg(F.sum("precip_mm").alias("precip_annual"))


def precipitation_by_year(monthly: DataFrame) -> DataFrame:
    """Annual sum and month -> mm map per station and year, at most twelve entries each."""
    entries = F.collect_list(F.struct("month", "precip_mm"))
    return monthly.groupBy("station_id", "year").agg(
        F.sum("precip_mm").alias("precip_annual"),
        F.map_from_entries(entries).alias("precip_by_month"),
    )
