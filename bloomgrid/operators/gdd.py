"""Growing-degree-days, bloom days and bloom windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bloomgrid.functions import labels as L
from bloomgrid.functions.values import round2

DATES = T.ArrayType(T.DateType())
FOUND_WINDOWS = T.StructType([
    T.StructField("nth", T.ArrayType(T.IntegerType())), T.StructField("starts", DATES),
    T.StructField("ends", DATES),
])
PLANTS_PER_BLOCK = 1_000
#: Plants of a station-year whose totals are in memory at once.
PLANTS_PER_YEAR = 64
#: Widths of the running sum over the days of a year, days that come more than once included.
SUM_STEPS = tuple(2**k for k in range(16))


def plant_terms(plants: DataFrame) -> DataFrame:
    """Model terms per plant; a plant without its own takes the defaults."""
    return plants.select(
        F.col("id").alias("plant_id"),
        F.coalesce("base_temp_c", F.lit(L.DEFAULT_BASE_TEMP)).alias("base_temp_c"),
        F.coalesce("gdd_min", F.lit(L.DEFAULT_GDD_MIN)).alias("gdd_min"),
        F.coalesce("gdd_max", F.lit(L.DEFAULT_GDD_MAX)).alias("gdd_max"),
    )


def with_plants(daily: DataFrame, plants: DataFrame, plantings: DataFrame | None = None,
                ) -> DataFrame:
    """Daily rows once per plant.

    Without `plantings` every plant of the dictionary applies to every station. The dictionary is
    dealt to blocks of about PLANTS_PER_BLOCK, each day is unfolded per block, and an equality
    join on the block brings the plants, so that a dictionary of any size is an ordinary side of
    a join. With `plantings` (station_id, plant_id) the pairs come from equality joins.
    """
    terms = plant_terms(plants)
    if plantings is not None:
        pairs = plantings.select("station_id", "plant_id").distinct()
        return daily.join(pairs.join(terms, "plant_id"), "station_id")
    blocks = terms.agg(
        F.greatest(F.ceil(F.count("*") / F.lit(PLANTS_PER_BLOCK)), F.lit(1)).cast("int").alias("n")
    ).scalar()
    dealt = terms.withColumn("_block", F.pmod(F.hash("plant_id"), blocks))
    unfolded = daily.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return unfolded.join(dealt, "_block").drop("_block")


def daily_excess_of(mean: Column, base: Column) -> Column:
    """Degrees of the day above the base, to two decimals; NULL without a mean or a base."""
    return F.when(
        mean.isNotNull() & base.isNotNull(), round2(F.greatest(mean - base, F.lit(0.0)))
    )


def daily_excess() -> Column:
    return daily_excess_of(F.col("t_mean"), F.col("base_temp_c"))


def day_lists(daily: DataFrame) -> DataFrame:
    """One row per station and year: `days`, its daily rows in order of days, those without a mean
    (`unknown`) behind the others.

    Daily rows shuffle once, by station and year, and what follows is done list by list, so a task
    never sorts a row per day and plant. A place in the list counts the days with a mean, so no
    window has to sort them. A list has 366 entries at most.
    """
    dated = daily if "year" in daily.columns else daily.withColumn("year", F.year("date"))
    values = [c for c in dated.columns if c not in ("station_id", "year", "date")]
    day = F.struct(F.col("t_mean").isNull().alias("unknown"), "date", *values)
    return dated.groupBy("station_id", "year").agg(
        F.sort_array(F.collect_list(day)).alias("days")
    )


def growing_degree_days(daily: DataFrame, plants: DataFrame, plantings: DataFrame | None = None,
                        ) -> DataFrame:
    """Daily and cumulative GDD, bloom day and phase per station, plant and day.

    Daily rows are shuffled once, by station, and listed before they are unfolded per plant; where
    the plants are few enough to be sent to the tasks, rows stay in that partitioning, which also
    the columns of the stored table tell.
    """
    return degree_days(with_plants(day_lists(daily.repartition("station_id")), plants, plantings))


def running_sums(values: Column, length: Column) -> Column:
    """Sum up to each entry of a list, to two decimals.

    Each step adds the sum that ends as many entries before as it has summed so far.
    """
    widths = F.filter(F.array(*map(F.lit, SUM_STEPS)), lambda width: width < length)

    def add(sums: Column, width: Column) -> Column:
        return F.transform(sums, lambda own, i: own + F.coalesce(F.get(sums, i - width), F.lit(0.0)))

    return F.transform(F.aggregate(widths, values, add), round2)


def running_totals(days: Column, base: Column) -> Column:
    """Sum of `daily_excess` up to each day of a list; a day without a mean adds nothing."""
    excess = F.transform(days, lambda day: F.coalesce(daily_excess_of(day["t_mean"], base), F.lit(0.0)))
    return running_sums(excess, F.size(days))


def degree_lists(lists: DataFrame) -> DataFrame:
    """The lists with `totals`, GDD up to each of their `days`, and `below`, the known days before
    the bloom. They carry the plant's terms.

    The sum restarts every year and skips days without a mean, which stand last. Excesses have two decimals, so rounded sums do not hang on the order of adding. All of
    it stays inside the partitioning of the lists.
    """
    totals = running_totals(F.col("days"), F.col("base_temp_c"))
    # totals never fall, so the days up to gdd_min come before those in bloom, where there are any
    below = F.size(F.filter("totals", lambda total: total <= F.col("gdd_min")))
    return lists.withColumn("totals", totals).withColumn("below", below)


def degree_days(lists: DataFrame) -> DataFrame:
    """One row per day of `degree_lists`.

    Bloom days count the rows with gdd_min < total <= gdd_max; the phase is `blooming` from
    gdd_min on, both ends included. Rows without terms (an unknown plant) have NULL values.
    """
    total, low, high = F.col("gdd_cumulative"), F.col("gdd_min"), F.col("gdd_max")
    others = [c for c in lists.columns if c != "days"]
    rows = degree_lists(lists).select(
        *others, "below", F.posexplode(F.arrays_zip("days", "totals")).alias("nth", "day")
    ).select(*others, "below", "nth", "day.days.*", "day.totals")
    in_bloom = (total > low) & (total <= high)
    nth = F.when(in_bloom, F.col("nth") + 1 - F.col("below")).otherwise(0).cast("int")
    return (
        rows.withColumn("gdd_daily", daily_excess())
        .withColumn("gdd_cumulative", F.when(F.col("gdd_daily").isNotNull(), F.col("totals")))
        .withColumn("bloom_day", nth)
        .withColumn("bloom_phase", L.bloom_phase(total, low, high))
        .drop("unknown", "nth", "below", "totals")
    )


def windowed_degree_days(rows: DataFrame) -> DataFrame:
    """GDD columns for daily rows that carry `year`, `plant_id` and the plant's terms.

    The sum restarts every year and skips days without a mean, which keep a NULL total.
    Bloom days count the rows with gdd_min < total <= gdd_max; the phase is `blooming` from
    gdd_min on, both ends included. Rows without terms (an unknown plant) have NULL values. The
    window groups hold at most 366 rows each.
    """
    upto = (
        Window.partitionBy("station_id", "year", "plant_id")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.when(F.col("gdd_daily").isNotNull(), round2(F.sum("gdd_daily").over(upto)))
    in_bloom = (F.col("gdd_cumulative") > F.col("gdd_min")) & (
        F.col("gdd_cumulative") <= F.col("gdd_max")
    )
    nth = F.sum(F.when(in_bloom, 1).otherwise(0)).over(upto)
    phase = L.bloom_phase(F.col("gdd_cumulative"), F.col("gdd_min"), F.col("gdd_max"))
    return (
        rows.withColumn("gdd_daily", daily_excess())
        .withColumn("gdd_cumulative", total)
        .withColumn("bloom_day", F.when(in_bloom, nth).otherwise(0).cast("int"))
        .withColumn("bloom_phase", phase)
    )


def requested_degree_days(daily: DataFrame, plants: DataFrame, requests: DataFrame) -> DataFrame:
    """Degree days of the asked station-years and plants only.

    `requests`: distinct station_id, year, plant_id (further columns come along). They cut the
    daily rows before any sum is made, and one join brings request, day and terms together; the
    windows lie inside its partitioning. Plants that the dictionary lacks have NULL values.
    """
    dated = daily if "year" in daily.columns else daily.withColumn("year", F.year("date"))
    wanted = requests.join(plant_terms(plants), "plant_id", "left")
    return windowed_degree_days(dated.join(wanted, ["station_id", "year"]))


def asked_days(lists: DataFrame, plants: DataFrame, requests: DataFrame) -> DataFrame:
    """As `requested_degree_days`, from `day_lists` and without a window over the days.

    The plants asked for a station-year are dealt to lists of at most PLANTS_PER_YEAR, and what is
    computed for them stays inside the partitioning of the lists of days.
    """
    terms = plant_terms(plants).select("plant_id", "base_temp_c")
    nth = F.dense_rank().over(Window.partitionBy("station_id", "year").orderBy("plant_id"))
    wanted = requests.join(terms, "plant_id", "left").withColumn("nth", nth)
    asked = [c for c in requests.columns if c not in ("station_id", "year")]
    # rows of a plant that the dictionary has more than once are summed together
    each = wanted.groupBy("station_id", "year", "nth").agg(
        F.struct(*(F.first(c).alias(c) for c in asked), F.collect_list(
            F.struct("base_temp_c")).alias("bases")).alias("ask"))
    block = F.floor((F.col("nth") - 1) / F.lit(PLANTS_PER_YEAR)).alias("_block")
    each = each.groupBy("station_id", "year", block).agg(F.collect_list("ask").alias("asked"))
    rows = lists.join(each.drop("_block"), ["station_id", "year"]).select(
        "station_id", "year", "days", F.explode("asked").alias("ask"))
    days, bases = F.col("days"), F.col("ask")["bases"]

    def excess(day: Column, of: Column) -> Column:
        return F.coalesce(daily_excess_of(day["t_mean"], of["base_temp_c"]), F.lit(0.0))

    single = F.transform(days, lambda day: excess(day, F.get(bases, F.lit(0))))
    several = F.flatten(F.transform(days, lambda day: F.transform(bases, lambda of: excess(day, of))))
    totals = running_sums(
        F.when(F.size(bases) == 1, single).otherwise(several), F.size(days) * F.size(bases))
    rows = rows.withColumn("totals", totals).select(
        "station_id", "year", "totals", "ask", F.posexplode("days").alias("j", "day"))
    rows = rows.select("*", F.posexplode(F.col("ask")["bases"]).alias("k", "of"))
    total = F.get("totals", F.col("j") * F.size(F.col("ask")["bases"]) + F.col("k"))
    rows = rows.select(
        "station_id", "year", *(F.col("ask")[c].alias(c) for c in asked), "day.*", "of.base_temp_c",
        total.alias("total")).withColumn("gdd_daily", daily_excess())
    cumulative = F.when(F.col("gdd_daily").isNotNull(), F.col("total"))
    return rows.withColumn("gdd_cumulative", cumulative).drop("unknown", "total", "base_temp_c")


MATCHES = T.StructType([
    T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())),
])


@F.arrow_udf(MATCHES)
def matching_days(days: pa.Array, others: pa.Array) -> pa.Array:
    """Left join of two lists of days: places of each pair, -1 where a day is in the first only."""

    def keyed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(_places(lists))
        values = lists.flatten().cast(pa.int32()).fill_null(-(2**31)).to_numpy().astype(np.int64)
        return np.repeat(np.arange(len(sizes)), sizes) * 2**32 + values, sizes

    (own, own_sizes), (other, other_sizes) = keyed(days), keyed(others)
    order = np.argsort(other, kind="stable")
    first = np.searchsorted(other[order], own, "left")
    count = np.searchsorted(other[order], own, "right") - first
    times = np.maximum(count, 1)
    ends = np.append(0, np.cumsum(times))
    at = np.repeat(np.arange(len(own)), times)
    to = np.repeat(first, times) + np.arange(ends[-1]) - np.repeat(ends[:-1], times)
    right = np.full(len(at), -1)
    found = np.repeat(count > 0, times)
    before = lambda sizes: np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(own_sizes)), own_sizes)[at]
    right[found] = order[to[found]] - before(other_sizes)[row[found]]
    left = at - before(own_sizes)[row]
    rows = pa.array(ends[np.append(0, np.cumsum(own_sizes))], pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(rows, pa.array(x, pa.int32())) for x in (left, right)], ["left", "right"])


def stored_days(lists: DataFrame, gdd: DataFrame, requests: DataFrame) -> DataFrame:
    """Days of every request with the stored GDD of its plant where there is one.

    `lists`: `day_lists`. All sides meet by station, the partitioning that a computed table has, so
    that its rows and the days of the requests are not shuffled; year and plant are compared by two
    bounds each, which leaves them out of the join key. What meets has a row per station and year.
    """
    totals = gdd if "year" in gdd.columns else gdd.withColumn("year", F.year("date"))
    entry = F.collect_list(F.struct("date", "gdd_daily", "gdd_cumulative")).alias("stored")
    totals = totals.groupBy("station_id", "year", "plant_id").agg(entry).groupBy("station_id", "year").agg(
        F.collect_list(F.struct("plant_id", "stored")).alias("totals"))
    asked = [c for c in requests.columns if c not in ("station_id", "year")]
    wanted = requests.repartition("station_id").groupBy("station_id", "year").agg(
        F.collect_list(F.struct(*asked)).alias("asked"))

    def met(one: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.withColumnsRenamed({"station_id": "_station", "year": "_year"})
        same = (F.col("station_id") == F.col("_station")) & (F.col("year") >= F.col("_year")) & (
            F.col("year") <= F.col("_year"))
        return one.join(other, same, how).drop("_station", "_year")

    rows = met(met(lists, wanted, "inner"), totals, "left").select(
        "station_id", "year", "days", "totals", F.explode("asked").alias("ask"))
    own = F.filter(F.coalesce("totals", F.array()), lambda total: total["plant_id"] == F.col("ask")["plant_id"])
    rows = rows.withColumn("stored", F.coalesce(F.get(own, F.lit(0))["stored"], F.array())).drop("totals")
    pairs = matching_days(F.col("days")["date"], F.col("stored")["date"])
    rows = rows.withColumn("pairs", pairs).select(
        "station_id", "year", "ask", "days", "stored", "pairs", F.posexplode("pairs.left").alias("n", "at"))
    right = F.get(F.col("pairs")["right"], F.col("n"))
    found = F.when(right >= 0, F.get("stored", right))
    return rows.select(
        "station_id", "year", "ask.*", F.get("days", F.col("at")).alias("day"),
        found["gdd_daily"].alias("gdd_daily"), found["gdd_cumulative"].alias("gdd_cumulative"),
    ).select("*", "day.*").drop("day", "unknown")


GDD_COLUMNS = (
    "station_id", "plant_id", "date", "t_min", "t_max", "t_mean",
    "gdd_daily", "gdd_cumulative", "bloom_day", "bloom_phase",
)


def gdd_table(daily: DataFrame, plants: DataFrame, plantings: DataFrame | None = None,
              ) -> DataFrame:
    """The stored GDD table."""
    return growing_degree_days(daily, plants, plantings).select(*GDD_COLUMNS)


def yearly_windows(gdd: DataFrame, plants: DataFrame | None = None) -> DataFrame:
    """First day with total >= gdd_min and first day with total > gdd_max, per year.

    `gdd` may carry the plant's terms already (as `growing_degree_days` leaves them); a
    stored table does not, and takes them from `plants`.
    """
    if "gdd_min" not in gdd.columns:
        gdd = gdd.join(plant_terms(plants), "plant_id")
    if "year" not in gdd.columns:
        gdd = gdd.withColumn("year", F.year("date"))
    return gdd.groupBy("station_id", "year", "plant_id").agg(
        F.min(F.when(F.col("gdd_cumulative") >= F.col("gdd_min"), F.col("date")))
        .alias("bloom_start_date"),
        F.min(F.when(F.col("gdd_cumulative") > F.col("gdd_max"), F.col("date")))
        .alias("bloom_end_date"),
    )


def latest_windows(yearly: DataFrame) -> DataFrame:
    """The window of the latest year that has both dates, per station and plant."""
    complete = yearly.where(
        F.col("bloom_start_date").isNotNull() & F.col("bloom_end_date").isNotNull()
    )
    return complete.groupBy("station_id", "plant_id").agg(
        F.max("year").alias("year"),
        F.max_by("bloom_start_date", "year").alias("bloom_start_date"),
        F.max_by("bloom_end_date", "year").alias("bloom_end_date"),
    )


# windows by search ------------------------------------------------------------------------


TERMS = ("base_temp_c", "gdd_min", "gdd_max")


def _wanted(plants: DataFrame, plantings: DataFrame | None) -> DataFrame:
    """Plants with their terms in lists of at most about PLANTS_PER_BLOCK, by base temperature.

    Few bases lie in one list of a large dictionary, so that their sums are made for many plants.
    With `plantings` the lists are kept by station.
    """
    terms, keys = plant_terms(plants), []
    if plantings is not None:
        pairs = plantings.select("station_id", "plant_id").distinct()
        order = Window.partitionBy("station_id").orderBy(*TERMS)
        block = ((F.row_number().over(order) - 1) / F.lit(PLANTS_PER_BLOCK)).cast("int")
        dealt, keys = pairs.join(terms, "plant_id").repartition("station_id"), ["station_id"]
    else:
        per_list = F.greatest(F.ceil(F.count("*") / F.lit(PLANTS_PER_BLOCK)), F.lit(1)).cast("int")
        group = F.pmod(F.hash("base_temp_c"), terms.agg(per_list).scalar())
        grouped, keys = terms.withColumn("_group", group), ["_group"]
        dealt = grouped.join(grouped.groupBy("_group").agg(per_list.alias("_lists")), "_group")
        block = F.pmod(F.hash("plant_id"), F.col("_lists"))
    listed = F.sort_array(F.collect_list(F.struct(*TERMS, "plant_id"))).alias("plants")
    lists = dealt.withColumn("_block", block).groupBy(*keys, "_block").agg(listed)
    return lists.drop("_block", "_group")


def _beside(lists: DataFrame, plants: DataFrame, plantings: DataFrame | None) -> DataFrame:
    """Lists of days beside each list of plants that applies to their station."""
    wanted = _wanted(plants, plantings)
    return lists.crossJoin(wanted) if plantings is None else lists.join(wanted, "station_id")


def _listed(daily: DataFrame, planted: bool) -> DataFrame:
    """`day_lists` of the days with a mean; a year without any has an empty list.

    Daily rows shuffle once: by station where its plantings join them, else by station and year, so
    that days are listed in part before they shuffle.
    """
    rows = daily.select("station_id", F.year("date").alias("year"), "date", "t_mean")
    known = F.filter("days", lambda day: ~day["unknown"])
    lists = day_lists(rows.repartition("station_id") if planted else rows)
    return lists.withColumn("days", known)


def _places(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the values of all of them, and the end."""
    places = lists.offsets.to_numpy()
    return places - places[0]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First place and end of each run of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
    return [*zip(cuts[:-1], cuts[1:])] if len(values) else []


def _excess(means: np.ndarray, base: float) -> np.ndarray:
    """`daily_excess` of known days."""
    return np.rint(np.maximum(means - base, 0.0) * 100.0) / 100.0


@F.arrow_udf(T.StructType([T.StructField("starts", DATES), T.StructField("ends", DATES)]))
def first_days(dates: pa.Array, means: pa.Array, bases: pa.Array, lows: pa.Array, highs: pa.Array,
               ) -> pa.Array:
    """For each plant of a list the first day of a year that reaches the one threshold and the
    first that passes the other; NULL where there is none. Plants of one base are neighbours."""
    day, mean = dates.flatten().cast(pa.int32()), means.flatten().to_numpy()
    dated, day = day.is_valid().to_numpy(zero_copy_only=False), day.fill_null(0).to_numpy()
    base, low, high = (x.flatten().to_numpy() for x in (bases, lows, highs))
    of_day, of_plant = _places(dates), _places(bases)
    at, to = np.zeros((2, len(base)), np.int64)
    for first, last, begin, end in zip(of_day[:-1], of_day[1:], of_plant[:-1], of_plant[1:]):
        for left, right in _runs(base[begin:end]):
            own = slice(begin + left, begin + right)
            totals = np.rint(np.cumsum(_excess(mean[first:last], base[own.start])) * 100.0) / 100.0
            at[own] = totals.searchsorted(low[own], "left")
            to[own] = totals.searchsorted(high[own], "right")
    length, start = (np.repeat(x, np.diff(of_plant)) for x in (np.diff(of_day), of_day[:-1]))

    def listed(places: np.ndarray) -> pa.Array:
        known = places < length
        known[known] = dated[(start + places)[known]]
        found = np.zeros(len(places), np.int32)
        found[known] = day[(start + places)[known]]
        found = pa.array(found, pa.int32(), mask=~known).cast(pa.date32())
        return pa.ListArray.from_arrays(pa.array(of_plant, pa.int32()), found)

    return pa.StructArray.from_arrays([listed(at), listed(to)], ["starts", "ends"])


def searched_years(daily: DataFrame, plants: DataFrame, plantings: DataFrame | None = None,
                   ) -> DataFrame:
    """As `yearly_windows(growing_degree_days(...))`, without a row per day and plant.

    A total depends on the base only, so work is days x distinct bases for the sums, then two
    searches per station, year and plant.
    """
    rows = _beside(_listed(daily, plantings is not None), plants, plantings)
    days, terms = F.col("days"), F.col("plants")
    found = first_days(days["date"], days["t_mean"], *(terms[c] for c in TERMS))
    windows = rows.select("station_id", "year", "plants", found.alias("found")).select(
        "station_id", "year", "found", F.posexplode("plants").alias("nth", "plant"))
    start, end = (F.get(F.col("found")[c], F.col("nth")) for c in ("starts", "ends"))
    return windows.select(
        "station_id", "year", F.col("plant")["plant_id"].alias("plant_id"),
        start.alias("bloom_start_date"), end.alias("bloom_end_date"))


def _dates(days: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(days) if days else [], pa.int32()).cast(pa.date32())


@F.arrow_udf(FOUND_WINDOWS)
def latest_found(dates: pa.Array, means: pa.Array, bases: pa.Array, lows: pa.Array, highs: pa.Array,
                 ) -> pa.Array:
    """The plants of each list that have a year whose last total passes both thresholds: their
    places in the list, and of the latest such year the first days that reach the one and pass
    the other. Plants of one base are neighbours."""
    day, mean = dates.flatten().cast(pa.int32()).to_numpy(), means.flatten().to_numpy()
    base, low, high = (x.flatten().to_numpy() for x in (bases, lows, highs))
    year = day.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int32)
    of_day, of_plant = _places(dates), _places(bases)
    found, ends = ([], [], []), [0]
    for first, last, begin, end in zip(of_day[:-1], of_day[1:], of_plant[:-1], of_plant[1:]):
        cuts = [0, *(np.flatnonzero(np.diff(year[first:last])) + 1), last - first]
        years = [*zip(cuts[:-1], cuts[1:])][::-1] if last > first else []
        count = ends[-1]
        for left, right in _runs(base[begin:end]):
            pending = np.arange(left, right)
            excess = _excess(mean[first:last], base[begin + left])
            for start, stop in years:
                totals = np.rint(np.cumsum(excess[start:stop]) * 100.0) / 100.0
                small, great = low[begin + pending], high[begin + pending]
                most = np.inf if np.isnan(totals[-1]) else totals[-1]
                whole = (small <= most) & (great < most)
                at = totals.searchsorted(small[whole], "left")
                to = totals.searchsorted(great[whole], "right")
                known = day[first + start:first + stop]
                found[0].append(pending[whole])
                found[1].append(known[at])
                found[2].append(known[to])
                count += len(at)
                pending = pending[~whole]
                if not len(pending):
                    break
        ends.append(count)
    ends = pa.array(ends, pa.int32())
    nth = pa.array(np.concatenate(found[0]) if found[0] else [], pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(ends, x) for x in (nth, _dates(found[1]), _dates(found[2]))],
        ["nth", "starts", "ends"])


def searched_windows(daily: DataFrame, plants: DataFrame, plantings: DataFrame | None = None,
                     ) -> DataFrame:
    """As `latest_windows(yearly_windows(...))`, straight from daily temperatures.

    All known days of a station are one list, on which a whole list of plants is searched. Where
    every plant applies, each part of the stations meets each part of the plants as they lie, so
    that days are not written once per base temperature.
    """
    known = daily.select("station_id", "date", "t_mean").where(
        F.col("date").isNotNull() & F.col("t_mean").isNotNull())
    listed = F.sort_array(F.collect_list(F.struct("date", "t_mean"))).alias("days")
    stations = known.repartition("station_id").groupBy("station_id").agg(listed)
    rows = _beside(stations, plants, plantings)
    days, terms = F.col("days"), F.col("plants")
    found = latest_found(days["date"], days["t_mean"], *(terms[c] for c in TERMS))
    windows = rows.select("station_id", "plants", found.alias("found")).select(
        "station_id", "plants", "found", F.posexplode("found.nth").alias("at", "nth"))
    start, end = (F.get(F.col("found")[c], F.col("at")) for c in ("starts", "ends"))
    return windows.select(
        "station_id", F.get("plants", F.col("nth"))["plant_id"].alias("plant_id"),
        F.year(start).alias("year"), start.alias("bloom_start_date"), end.alias("bloom_end_date"))


def bloom_rows(gdd: DataFrame) -> DataFrame:
    return gdd.where(F.col("bloom_day") > 0)


def threshold_rows(plants: DataFrame) -> DataFrame:
    """Each plant's two thresholds as labelled rows; a missing one has no row."""
    low, high = L.THRESHOLD_LABELS
    pairs = F.array(
        F.struct(F.lit(low).alias("label"), F.col("gdd_min").alias("y")),
        F.struct(F.lit(high).alias("label"), F.col("gdd_max").alias("y")),
    )
    rows = plants.select(F.col("id").alias("plant_id"), F.inline(pairs))
    return rows.where(F.col("y").isNotNull())


def monthly_totals(months: DataFrame) -> DataFrame:
    """Monthly rows whose year has no stored total get the running sum of the monthly GDD.

    `months`: station_id, year, plant_id, month, gdd_monthly, gdd_cumulative (12 rows a year).
    """
    year = Window.partitionBy("station_id", "year", "plant_id")
    upto = year.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.coalesce("gdd_monthly", F.lit(0.0))).over(upto)
    none_stored = F.count("gdd_cumulative").over(year) == 0
    return months.withColumn(
        "gdd_cumulative", F.when(none_stored, running).otherwise(F.col("gdd_cumulative"))
    )
