"""Stored tables kept up to date by new readings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.operators import gdd as gd
from bloomgrid.operators.weather import daily_extremes, keep_last
from bloomgrid.session import cut_lineage
from bloomgrid.sources import tables

ORDER = ("station_id", "date")


def rebuild(readings: DataFrame, plants: DataFrame, daily_path: str, gdd_path: str) -> None:
    """Both tables from all readings, a part for each year."""
    daily = daily_extremes(readings)
    tables.refresh(daily, daily_path, F.year("date"), ORDER)
    stored = tables.read(daily.sparkSession, daily_path, tables.current(daily.sparkSession, daily_path))
    tables.refresh(gd.gdd_table(stored, plants), gdd_path, F.year("date"), ORDER)


def take_in(readings: DataFrame, plants: DataFrame, daily_path: str, gdd_path: str) -> list[int]:
    """Merge new readings into both stored tables; returns the years that were written.

    The readings name the touched station-years. Only their years' parts are read and written:
    days of the other stations of such a year are carried over, and degree days are computed for
    touched station-years alone. A fresh day replaces the stored one. The daily table changes
    first; taking in the same readings again gives the same tables, so a run that broke off between
    the two is simply repeated.
    """
    spark = readings.sparkSession
    fresh = cut_lineage(daily_extremes(readings))
    touched = fresh.select("station_id", F.year("date").alias("year")).distinct()
    years = sorted(row[0] for row in touched.select("year").distinct().collect())
    if not years:
        return []

    state = tables.current(spark, daily_path)
    stored = tables.read(spark, daily_path, state, years)
    merged = keep_last(stored.withColumn("position", F.lit(0)), fresh).select(*stored.columns)
    tables.replace_parts(merged, daily_path, F.year("date"), years, state, ORDER)

    daily = tables.read(spark, daily_path, tables.current(spark, daily_path), years)
    dated = daily.withColumn("year", F.year("date"))
    made = gd.gdd_table(dated.join(touched, ["station_id", "year"], "left_semi"), plants)
    state = tables.current(spark, gdd_path)
    held = tables.read(spark, gdd_path, state, years)
    kept = held.withColumn("year", F.year("date")).join(
        touched, ["station_id", "year"], "left_anti"
    ).select(*held.columns)
    whole = kept.unionByName(made.select(*held.columns))
    tables.replace_parts(whole, gdd_path, F.year("date"), years, state, ORDER)
    return years
