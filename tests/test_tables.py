"""Tables that change in one step: refresh, parts, failing writes, two writers, new readings."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bloomgrid import schemas
from bloomgrid.operators import gdd as gd
from bloomgrid.operators.weather import daily_extremes, keep_last
from bloomgrid.plans import refresh
from bloomgrid.sources import files, sinks, tables

D = dt.date


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def numbers(spark, *values):
    return spark.createDataFrame([(v, v % 3) for v in values], "v INT, p INT")


def failing(frame):
    """Rows, and an error once they are computed."""
    return frame.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("broken")).cast("int"))
                            .otherwise(F.col("v")))


def test_refresh_and_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.current(spark, path) is None
    tables.refresh(numbers(spark, 1, 2, 3), path, F.col("p"), ("v",))
    assert rows_of(files.read_table(spark, path)) == [(1, 1), (2, 2), (3, 0)]
    assert rows_of(files.read_table(spark, path, parts=[1, 2, 7])) == [(1, 1), (2, 2)]
    state = tables.current(spark, path)
    tables.replace_parts(numbers(spark, 4, 7), path, F.col("p"), [1, 2], state)
    assert rows_of(files.read_table(spark, path)) == [(3, 0), (4, 1), (7, 1)]
    after = tables.current(spark, path)
    assert after.folders["0"] == state.folders["0"] and "2" not in after.folders
    with pytest.raises(ValueError, match="not replaced"):
        tables.replace_parts(numbers(spark, 3), path, F.col("p"), [1], after)
    # the state before is still whole until it is cleaned away
    assert rows_of(tables.read(spark, path, state)) == [(1, 1), (2, 2), (3, 0)]
    tables.clean(spark, path)
    assert rows_of(files.read_table(spark, path)) == [(3, 0), (4, 1), (7, 1)]
    assert len(list((tmp_path / "t" / "_states").glob("0*"))) == 1
    tables.refresh(numbers(spark), path, F.col("p"))
    assert files.read_table(spark, path).count() == 0
    tables.clean(spark, path)
    assert not list((tmp_path / "t" / "_rows").rglob("*.parquet"))


def test_a_second_writer_does_not_overwrite_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.refresh(numbers(spark, 1), path, F.col("p"))
    state = tables.current(spark, path)
    tables.replace_parts(numbers(spark, 4), path, F.col("p"), [1], state)
    with pytest.raises(tables.ChangedMeanwhile):
        tables.replace_parts(numbers(spark, 7), path, F.col("p"), [1], state)
    assert rows_of(files.read_table(spark, path)) == [(4, 1)]


def test_a_failing_write_changes_nothing(spark, tmp_path):
    path, plain = str(tmp_path / "t"), str(tmp_path / "plain")
    daily = str(tmp_path / "daily")
    days = spark.createDataFrame([("A", D(2024, 1, 1), 1.0, 1.0, 1.0)], schemas.DAILY)
    tables.refresh(numbers(spark, 1), path)
    sinks.refresh_table(numbers(spark, 1), plain)
    sinks.refresh_daily_table(days, daily)
    bad = failing(numbers(spark, *range(1, 50), -1))
    with pytest.raises(PySparkException):
        tables.refresh(bad, path)
    with pytest.raises(PySparkException):
        sinks.refresh_table(bad, plain)
    broken = days.withColumn("t_min", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(PySparkException):
        sinks.refresh_daily_table(broken, daily)
    assert rows_of(files.read_table(spark, path)) == [(1, 1)]
    assert rows_of(files.read_table(spark, plain)) == [(1, 1)]
    assert files.read_table(spark, daily).count() == 1


def test_read_merge_and_refresh_of_one_path(spark, tmp_path):
    plain, daily = str(tmp_path / "plain"), str(tmp_path / "daily")
    sinks.refresh_table(numbers(spark, 1, 2), plain)
    days = spark.createDataFrame([("A", D(2024, 1, 1), 1.0, 1.0, 1.0)], schemas.DAILY)
    sinks.refresh_daily_table(days, daily)
    fresh = spark.createDataFrame([("A", D(2024, 1, 2), 2.0, 2.0, 2.0)], schemas.DAILY)
    for _ in range(2):
        stored = files.read_table(spark, plain)
        sinks.refresh_table(stored.unionByName(numbers(spark, 3)).distinct(), plain)
        old = files.read_table(spark, daily).withColumn("position", F.lit(0))
        sinks.refresh_daily_table(keep_last(old, fresh), daily)
    assert rows_of(files.read_table(spark, plain)) == [(1, 1), (2, 2), (3, 0)]
    assert files.read_table(spark, daily).count() == 2
    assert not [p for p in tmp_path.iterdir() if "fresh-" in p.name or "former-" in p.name]


def test_catalogue_changes_in_one_step(spark, tmp_path):
    path = str(tmp_path / "c")

    def load(*pairs):
        return spark.createDataFrame(
            [(i, c, dt.datetime(2024, 1, 1)) for i, c in pairs],
            "id STRING, collection STRING, acquired_at TIMESTAMP_NTZ")

    sinks.store_catalogue(load(("a", "x"), ("b", "x"), ("c", "y/z w"), ("n", None)), path)
    sinks.store_catalogue(load(("d", "x"), ("e", "y/z w"), ("m", None)), path)
    assert [r[:2] for r in rows_of(files.read_table(spark, path))] == [
        ("d", "x"), ("e", "y/z w"), ("m", None)]


def test_two_writers_keep_one_manifest_per_digest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")

    def load(version, *digests):
        return spark.createDataFrame([(d, version) for d in digests], "digest STRING, v INT")

    sinks.store_manifests(load(0, "a"), path)
    append, raced = tables.append, []

    def late(frame, place, since):
        if not raced:  # another writer comes between looking and writing
            raced.append(True)
            append(load(1, "b", "c"), place, since)
        append(frame, place, since)

    monkeypatch.setattr(tables, "append", late)
    sinks.store_manifests(load(2, "a", "b", "d"), path)
    assert rows_of(files.read_table(spark, path)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


PLANTS = "id STRING, name_pl STRING, name_latin STRING, base_temp_c DOUBLE, gdd_min DOUBLE, gdd_max DOUBLE, season STRING"


def test_new_readings_touch_their_years_only(spark, tmp_path):
    daily_path, gdd_path = str(tmp_path / "daily"), str(tmp_path / "gdd")
    plants = spark.createDataFrame(
        [("w", "W", "w", 5.0, 20.0, 60.0, None), ("l", "L", "l", 8.0, 10.0, 30.0, None)], PLANTS)

    def readings(*rows):
        return spark.createDataFrame(rows, "station_id STRING, date DATE, air_temperature DOUBLE")

    first = [(s, D(year, 4, day), 10.0 + day + year % 3) for s in "ABC" for year in (2022, 2023, 2024)
             for day in range(1, 20)]
    refresh.rebuild(readings(*first), plants, daily_path, gdd_path)
    before = tables.current(spark, daily_path), tables.current(spark, gdd_path)

    new = [("B", D(2023, 4, 5), 1.0), ("B", D(2023, 4, 25), 20.0), ("Z", D(2023, 4, 1), 9.0)]
    assert refresh.take_in(readings(*new), plants, daily_path, gdd_path) == [2023]
    after = tables.current(spark, daily_path), tables.current(spark, gdd_path)
    for old, now in zip(before, after, strict=True):
        assert old.folders.keys() == now.folders.keys() == {"2022", "2023", "2024"}
        assert [y for y in old.folders if old.folders[y] != now.folders[y]] == ["2023"]

    whole = [r for r in first if r[:2] != ("B", D(2023, 4, 5))] + new
    daily = daily_extremes(readings(*whole))
    assert rows_of(files.read_table(spark, daily_path)) == rows_of(daily)
    table = gd.gdd_table(daily, plants)
    assert rows_of(files.read_table(spark, gdd_path)) == rows_of(table)
    # taking them in again changes nothing; no readings write nothing
    refresh.take_in(readings(*new), plants, daily_path, gdd_path)
    assert rows_of(files.read_table(spark, gdd_path)) == rows_of(table)
    assert refresh.take_in(readings(), plants, daily_path, gdd_path) == []
