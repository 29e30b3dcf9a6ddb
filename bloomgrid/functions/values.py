"""Small column expressions: rounding, missing values, dates and text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, half to even on the scaled double (not Spark's `round` or `bround`)."""
    return F.rint(value * F.lit(100.0)) / F.lit(100.0)


def nan_to_null(value: Column) -> Column:
    """One kind of missing value only: NaN becomes NULL."""
    return F.when(~F.isnan(value), value)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def text_or_null(value: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(value != "", value)


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance in degrees."""
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def reading_day(stamp: Column) -> Column:
    """Calendar day of an ISO stamp as written, whatever the session's zone is.

    Text that is no stamp fails the job.
    """
    return F.to_date(stamp.cast("timestamp_ntz"))


def iso_day(stamp: Column) -> Column:
    """Date part of ISO text."""
    return F.substring(stamp, 1, 10)


def in_year(day: Column, year: int) -> Column:
    """A date range, so that it prunes partitions and reaches the scan."""
    return day.between(F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year, 12, 31)))


def day_span(first: Column, last: Column) -> Column:
    """Days from first to last, both counted."""
    return F.datediff(last, first) + F.lit(1)


def clamp_end(start: Column, end: Column) -> Column:
    """An end before the start is moved to the start."""
    return F.greatest(end, start)


def start_of_day(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def end_of_day(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z"))


def search_fingerprint(start: Column, end: Column, max_cloud: Column) -> Column:
    """Text that identifies a scene search."""
    return F.concat_ws(
        "|",
        F.date_format(start, "yyyy-MM-dd"),
        F.date_format(end, "yyyy-MM-dd"),
        max_cloud.cast("string"),
    )


def five_decimals(value: Column) -> Column:
    """The exact binary value (up to 180) as text with five decimals, ties to the even digit.

    The value is taken apart in units so small that every double of its size is a whole number of
    them, and rounded in decimal arithmetic; below 2^-23 all values round to zero. Spark's own
    formatting rounds the shortest digits, which differs at ties.
    """
    size_of = F.abs(value)
    scales = (55, 2.0**-3), (65, 2.0**-13), (75, 0.0)

    def by_size(of) -> Column:
        (first, least), (second, less), (third, _) = scales
        return F.when(size_of >= least, of(first)).when(size_of >= less, of(second)).otherwise(of(third))

    size = by_size(lambda bits: F.lit(str(2**bits)).cast("decimal(23,0)"))
    scaled = size_of * by_size(lambda bits: F.lit(2.0**bits))
    units = F.floor(scaled)
    more = scaled > units
    product = units.cast("decimal(38,0)") * F.lit(100_000).cast("decimal(6,0)")
    whole = F.floor(product / size).cast("decimal(38,0)")
    rest = (product - whole * size).cast("decimal(38,0)")
    # a quotient that was rounded up to the next whole number is taken back
    whole, rest = F.when(rest < 0, whole - 1).otherwise(whole), F.when(rest < 0, rest + size).otherwise(rest)
    twice = rest * 2
    up = (twice > size) | ((twice == size) & (more | (whole % 2 == 1)))
    number = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
    minus = F.when((value < 0) | F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    return F.concat(
        minus, F.floor(number / 100_000).cast("bigint").cast("string"),
        F.lit("."), F.lpad((number % 100_000).cast("string"), 5, "0"),
    )


def click_key(lon: Column, lat: Column) -> Column:
    """Place of a click, to five decimals."""
    return F.concat(five_decimals(lat), F.lit(","), five_decimals(lon))
