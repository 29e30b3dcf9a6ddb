"""Column expressions on hand-made values."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bloomgrid.functions import labels as L
from bloomgrid.functions import scenes as S
from bloomgrid.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_round2_goes_half_to_even_on_the_scaled_value(spark):
    rows = [0.125, 6.625, 0.375, -0.125, 2.675, 1.005]
    frame = spark.createDataFrame([(r,) for r in rows], "x DOUBLE")
    got = [r.v for r in frame.select(V.round2(F.col("x")).alias("v")).collect()]
    assert got == [float(v) for v in np.round(rows, 2)]
    assert got[:2] == [0.12, 6.62]


@settings(max_examples=20, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50))
def test_round2_equals_numpy(spark, values):
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i INT, x DOUBLE")
    rows = frame.select("i", V.round2(F.col("x")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [float(v) for v in np.round(np.array(values, dtype=float), 2)]


@pytest.mark.parametrize(("text", "day"), [
    ("2024-01-01T23:59:59Z", dt.date(2024, 1, 1)),
    ("2024-01-01T23:30:00+02:00", dt.date(2024, 1, 1)),
    ("2024-02-29", dt.date(2024, 2, 29)),
])
def test_reading_day(spark, text, day):
    assert one(spark, V.reading_day(F.lit(text))) == day


def test_a_bad_stamp_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, V.reading_day(F.lit("no date")))


def test_five_decimals_round_the_exact_value(spark):
    rng = random.Random(5)
    values = [51.123455, 21.015625, 21.046875, -0.000004, -0.0, 0.0, 0.015625, 0.046875, 179.999995,
              180.0, 1e-300, 0.1, 0.000005, 0.1000050]
    values += [rng.randrange(-180 * 64, 180 * 64) / 64 for _ in range(200)]
    values += [rng.uniform(-180, 180) for _ in range(200)]
    values += [round(rng.uniform(-180, 180), 5) + 0.000005 for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(V.five_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.5f}" for v in values]


def test_reading_day_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, V.reading_day(F.lit("2024-01-01T00:10:00Z"))) == dt.date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dates(spark):
    a, b = F.lit(dt.date(2024, 8, 27)), F.lit(dt.date(2024, 8, 29))
    assert one(spark, V.day_span(a, b)) == 3
    assert one(spark, V.clamp_end(b, a)) == dt.date(2024, 8, 29)
    assert one(spark, V.start_of_day(a)) == "2024-08-27T00:00:00Z"
    assert one(spark, V.end_of_day(a)) == "2024-08-27T23:59:59Z"
    assert one(spark, V.search_fingerprint(a, b, F.lit(20))) == "2024-08-27|2024-08-29|20"
    assert one(spark, V.click_key(F.lit(22.5), F.lit(51.1234567))) == "51.12346,22.50000"


@pytest.mark.parametrize(("total", "phase", "frame", "annual"), [
    (99.99, "before", 0, "Przed kwitnieniem"),
    (100.0, "blooming", 1, "W okresie kwitnienia"),
    (200.0, "blooming", 1, "W okresie kwitnienia"),
    (200.01, "after", 2, "Po kwitnieniu"),
    (None, "after", 2, "—"),
])
def test_phases(spark, total, phase, frame, annual):
    terms = (F.lit(total).cast("double"), F.lit(100.0), F.lit(200.0))
    assert one(spark, L.bloom_phase(*terms)) == phase
    assert one(spark, L.frame_label(*terms)) == L.FRAME_LABELS[frame]
    assert one(spark, L.annual_status(*terms)) == annual


def test_texts(spark):
    assert one(spark, L.phase_label(F.lit("blooming"))) == "Kwitnie"
    assert one(spark, L.phase_label(F.lit("other"))) == "other"
    assert one(spark, L.month_label(F.lit(10))) == "10. Paź"
    assert one(spark, L.bloom_day_text(F.lit(0))) == "-"
    assert one(spark, L.bloom_day_text(F.lit(7))) == "7"
    assert one(spark, L.station_label(F.lit(""), F.lit("S1"))) == "S1"
    assert one(spark, L.station_label(F.lit(None).cast("string"), F.lit(""))) == "—"
    assert one(spark, L.two_part_label(F.lit("Wierzba iwa"), F.lit("Salix caprea"))) == (
        "Wierzba iwa (Salix caprea)"
    )


def test_zone_texts(spark):
    start, end = F.lit(dt.date(2025, 4, 1)), F.lit(dt.date(2025, 4, 20))
    none = F.lit(None).cast("date")
    name, sid, tip = F.lit("Lublin"), F.lit("S1"), F.lit("Wierzba iwa: brak danych")
    assert one(spark, L.zone_tip(name, sid, start, end, tip)) == "Lublin · 2025-04-01 – 2025-04-20"
    assert one(spark, L.zone_tip(name, sid, start, none, tip)) == "Wierzba iwa: brak danych"
    assert one(spark, L.zone_tip(F.lit(""), sid, none, none, F.lit(""))) == "S1"
    assert one(spark, L.zone_hover(name, start, none)) == "Lublin · 2025-04-01 – "
    assert one(spark, L.zone_hover(name, none, none)) == "Lublin"
    assert one(spark, L.bloom_tooltip(F.lit("Wierzba iwa"), start, end)) == (
        "Wierzba iwa: od 2025-04-01 do 2025-04-20"
    )
    assert one(spark, L.bloom_tooltip(F.lit("Wierzba iwa"), start, none)) is None


@pytest.mark.parametrize(("code", "item", "tile"), [
    ("MGRS-34UEB", "x", "MGRS-34UEB"),
    ("MGRS-35UKR", "x", "MGRS-35ULR"),
    (None, "S2B_34UEB_20240828_0_L2A", "MGRS-34UEB"),
    ("", "S2B_35UKS_20240828_0_L2A", "MGRS-35ULS"),
    (None, "S2B_34UEBX_20240828", "S2B_34UEBX_20240828"),
    (None, "noparts", "noparts"),
    (None, None, ""),
])
def test_tile_id(spark, code, item, tile):
    column = S.tile_id(F.lit(code).cast("string"), F.lit(item).cast("string"))
    assert one(spark, column) == tile


@pytest.mark.parametrize(("item", "platform", "label"), [
    ("S2C_34UEB_1", "sentinel-2a", "S2C"),
    ("S2_34UEB", "Sentinel-2A", "S2A"),
    ("scene", "sentinel-2b", "S2B"),
    ("scene", "landsat-8", "?"),
    ("scene", None, "?"),
    (None, "sentinel-2c", "S2C"),
])
def test_platform(spark, item, platform, label):
    column = S.scene_platform(F.lit(item).cast("string"), F.lit(platform).cast("string"))
    assert one(spark, column) == label


def test_year_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(3).select(F.lit(dt.date(2024, 5, 1)).alias("date")).write.parquet(path)
    frame = spark.read.parquet(path).where(V.in_year(F.col("date"), 2024))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-01)" in plan
    assert frame.count() == 3
