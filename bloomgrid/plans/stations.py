"""Station questions, answered for whole tables of requests.

A request table holds the parameters as columns; one request is a one-row table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.functions import labels as L
from bloomgrid.operators import layers
from bloomgrid.operators.gdd import (
    asked_days,
    day_lists,
    monthly_totals,
    plant_terms,
    requested_degree_days,
    stored_days,
)
from bloomgrid.operators.weather import monthly_precipitation, precipitation_by_year
from bloomgrid.quality import check_year


def year_request(spark: SparkSession, station_id: str, year: int, plant_id: str) -> DataFrame:
    """A request table for one station, year and plant."""
    return spark.createDataFrame(
        [(station_id, check_year(year), plant_id)], "station_id STRING, year INT, plant_id STRING"
    )


def _known_requests(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Distinct requests for stations that have a zone, of any year."""
    wanted = requests.select("station_id", "year", "plant_id").distinct()
    return wanted.join(layers.first_zone(zones), "station_id").drop("cell_id", "area_ha")


def _days(daily: DataFrame, requests: DataFrame, zones: DataFrame, plants: DataFrame | None,
          gdd: DataFrame | None) -> DataFrame:
    """Days of every request with the GDD of its plant where there is one.

    From the plant dictionary, GDD is computed for the asked station-years alone. From a stored
    table it is joined; the plant is part of the join key, so days without GDD stay.
    """
    wanted = _known_requests(requests, zones)
    if gdd is None:
        return requested_degree_days(daily, plants, wanted)
    # A stored table brings its partition column, which then prunes by the requests' years.
    dated = daily if "year" in daily.columns else daily.withColumn("year", F.year("date"))
    totals = gdd if "year" in gdd.columns else gdd.withColumn("year", F.year("date"))
    totals = totals.select(
        "station_id", "plant_id", "year", "date", "gdd_daily", "gdd_cumulative"
    )
    asked = dated.join(wanted, ["station_id", "year"])
    return asked.join(totals, ["station_id", "plant_id", "year", "date"], "left")


def monthly_rows(daily: DataFrame, requests: DataFrame, zones: DataFrame,
                 plants: DataFrame | None = None, gdd: DataFrame | None = None) -> DataFrame:
    """One row per request and month with readings; every day counts, also one without values.

    GDD comes from a stored table `gdd` where one is given, else it is computed with `plants`.
    """
    days = _days(daily, requests, zones, plants, gdd)
    return days.groupBy(
        "station_id", "station_name", "year", "plant_id", F.month("date").alias("month")
    ).agg(
        F.avg("t_mean").alias("t_mean"),
        F.sum("gdd_daily").alias("gdd_monthly"),
        F.max("gdd_cumulative").alias("gdd_cumulative"),
        F.count("*").alias("day_count"),
        F.sum("t_mean").alias("t_sum"),
        F.count("t_mean").alias("t_days"),
    )


def monthly_summaries(daily: DataFrame, requests: DataFrame, zones: DataFrame,
                      precipitation: DataFrame, plants: DataFrame | None = None,
                      gdd: DataFrame | None = None) -> DataFrame:
    """Document per request: annual figures and its months in order.

    Annual figures come from the twelve monthly rows, not from a second pass over the days, and
    one join brings the precipitation of a whole station-year. Annual precipitation counts every
    month on file, also months without readings; a month without entries stays NULL.
    """
    months = monthly_rows(daily, requests, zones, plants, gdd)
    documents = months.groupBy("station_id", "station_name", "year", "plant_id").agg(
        F.sum("day_count").alias("day_count"),
        F.try_divide(F.sum("t_sum"), F.sum("t_days")).alias("t_mean_annual"),
        F.max("gdd_cumulative").alias("gdd_max"),
        F.array_sort(F.collect_list(
            F.struct("month", "t_mean", "gdd_monthly", "gdd_cumulative")
        )).alias("months"),
    )
    rain = precipitation_by_year(monthly_precipitation(precipitation))
    point = F.transform(
        "months",
        lambda m: F.struct(
            m["month"].alias("month"), m["t_mean"].alias("t_mean"),
            m["gdd_monthly"].alias("gdd_monthly"), m["gdd_cumulative"].alias("gdd_cumulative"),
            F.try_element_at(F.col("precip_by_month"), m["month"]).alias("precip_mm"),
        ),
    )
    return (
        documents.join(rain, ["station_id", "year"], "left")
        .withColumn("months", point)
        .drop("precip_by_month")
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    """Monthly summaries as flat rows, annual figures repeated, months labelled."""
    header = ("station_id", "station_name", "year", "plant_id", "day_count", "t_mean_annual",
              "gdd_max", "precip_annual")
    return summaries.select(*header, F.inline("months")).withColumn(
        "month_label", L.month_label(F.col("month"))
    )


def _with_rain(daily: DataFrame, precipitation: DataFrame) -> DataFrame:
    """Daily rows with the list of their precipitation entries, which have the same keys."""
    entries = F.collect_list(F.struct("precip_mm")).alias("rain")
    rain = precipitation.groupBy("station_id", "date").agg(entries)
    dated = daily if "year" in daily.columns else daily.withColumn("year", F.year("date"))
    dated = dated.select("station_id", "date", "year", "t_min", "t_max", "t_mean")
    return dated.join(rain, ["station_id", "date"], "left")


def daily_rows(daily: DataFrame, requests: DataFrame, zones: DataFrame, precipitation: DataFrame,
               plants: DataFrame | None = None, gdd: DataFrame | None = None) -> DataFrame:
    """One row per request and day with readings; a day without precipitation entry has NULL.

    Precipitation is joined before the days are listed, and requests meet the lists, so that no row
    per request and day is shuffled.
    """
    rainy, wanted = _with_rain(daily, precipitation), _known_requests(requests, zones)
    if gdd is None:
        days = asked_days(day_lists(rainy), plants, wanted)
    else:
        days = stored_days(day_lists(rainy.repartition("station_id")), gdd, wanted)
    days = days.select("*", F.inline_outer("rain"))
    return days.select(
        "station_id", "station_name", "year", "plant_id", "date",
        "t_min", "t_max", "t_mean", "gdd_daily", "gdd_cumulative", "precip_mm",
    )


def daily_series(rows: DataFrame) -> DataFrame:
    """Document per request with its days in order, at most 366."""
    point = F.struct(
        "date", "t_min", "t_max", "t_mean", "gdd_daily", "gdd_cumulative", "precip_mm"
    )
    return rows.groupBy("station_id", "station_name", "year", "plant_id").agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )


def bloom_status(plants: DataFrame, zones: DataFrame, requests: DataFrame,
                 daily: DataFrame | None = None, gdd: DataFrame | None = None) -> DataFrame:
    """Phase on a day: requests (station_id, date, plant_id) that have GDD data.

    From a stored table `gdd`, or computed from `daily` for the asked station-years and plants.
    """
    keys = ["station_id", "plant_id", "date"]
    wanted = requests.select(*keys).distinct()
    names = plants.select(
        F.col("id").alias("plant_id"), F.col("name_pl").alias("plant_name"), "gdd_min", "gdd_max"
    )
    if gdd is None:
        known = wanted.join(names.select("plant_id"), "plant_id", "left_semi")
        years = known.select("station_id", F.year("date").alias("year"), "plant_id").distinct()
        gdd = requested_degree_days(daily, plants, years)
    values = gdd.select(*keys, "gdd_cumulative", "bloom_day", "bloom_phase")
    found = values.join(wanted, keys).join(names, "plant_id")
    zone = layers.first_zone(zones).select("station_id", "station_name")
    return found.join(zone, "station_id", "left").select(
        "station_id", "station_name", "date", "plant_id", "plant_name", "gdd_cumulative",
        "bloom_day", "bloom_phase", L.phase_label(F.col("bloom_phase")).alias("bloom_phase_label"),
        "gdd_min", "gdd_max", L.bloom_day_text(F.col("bloom_day")).alias("bloom_day_text"),
    )


def annual_statuses(summaries: DataFrame, plants: DataFrame) -> DataFrame:
    """Where the year's highest total stands against the plant's thresholds."""
    rows = summaries.select("station_id", "year", "plant_id", "gdd_max")
    return rows.join(plant_terms(plants).withColumnsRenamed(
        {"gdd_min": "threshold_min", "gdd_max": "threshold_max"}
    ), "plant_id").select(
        "station_id", "year", "plant_id", "gdd_max", "threshold_min", "threshold_max",
        L.annual_status(F.col("gdd_max"), F.col("threshold_min"), F.col("threshold_max"))
        .alias("status"),
    )


def gdd_chart(summaries: DataFrame) -> DataFrame:
    """Months of the GDD chart: stored totals, else the running sum of the monthly ones."""
    months = summaries.select("station_id", "year", "plant_id", F.inline("months"))
    return monthly_totals(
        months.select("station_id", "year", "plant_id", "month", "gdd_monthly", "gdd_cumulative")
    ).withColumn("month_label", L.month_label(F.col("month")))


def station_list(zones: DataFrame) -> DataFrame:
    """Distinct stations by name."""
    return layers.stations(zones).orderBy("station_name", "station_id", "area_ha")


def station_choices(zones: DataFrame) -> DataFrame:
    """Choice texts `name (id)`, by name."""
    label = L.two_part_label(F.col("station_name"), F.col("station_id"))
    return station_list(zones).select("station_id", label.alias("label"))


def station_search(zones: DataFrame, query: str) -> DataFrame:
    """Matching station ids with their labels, by id."""
    return layers.search_stations(layers.stations(zones), query).orderBy("station_id")


def plant_list(plants: DataFrame) -> DataFrame:
    """The plant dictionary by name."""
    return plants.select(
        "id", "name_pl", "name_latin", "base_temp_c", "gdd_min", "gdd_max", "season"
    ).orderBy("name_pl", "id")


def plant_choices(plants: DataFrame) -> DataFrame:
    """Choice texts `name (latin)` and terms with defaults."""
    terms = plant_terms(plants)
    names = plants.select(
        F.col("id").alias("plant_id"),
        L.two_part_label(F.col("name_pl"), F.col("name_latin")).alias("label"),
        F.coalesce("season", F.lit(L.NO_VALUE)).alias("season"),
    )
    return names.join(terms, "plant_id")
