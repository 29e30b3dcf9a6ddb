"""Tables laid out by place: same rows as without, and less is read."""

import random

import pytest
from pyspark.sql import functions as F

from bloomgrid import quality
from bloomgrid.functions import geometry as G
from bloomgrid.operators import space_layout, spatial


def code(x, y):
    return sum(((x >> b) & 1) << 2 * b | ((y >> b) & 1) << 2 * b + 1 for b in range(space_layout.BITS))


def test_ranges_cover_the_box():
    rng = random.Random(1)
    side = space_layout.SIDE
    for most in (1, 4, 48):
        for _ in range(60):
            x, y = rng.uniform(-179, 110), rng.uniform(-85, 80)
            box = (x, y, x + rng.choice([0, 0.01, 3, 60]), y + rng.choice([0, 0.02, 5]))
            ranges = space_layout.code_ranges(*box, most=most)
            assert len(ranges) <= most
            assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
            for _ in range(40):
                px, py = rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])
                place = code(int((px + 180) // side), int((py + 180) // side))
                assert any(a <= place <= b for a, b in ranges)
    near = sum(b - a + 1 for a, b in space_layout.code_ranges(21, 50, 22, 51))
    assert near < 4 * (1 / side) ** 2  # not much more than the box


def scanned_rows(frame):
    """Rows that the scans of a plan have put out, once it has run."""
    frame._jdf.collectToPython()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        found += metric.get().value() if metric.isDefined() else 0
    return found


def test_a_box_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "points")
    points = spark.range(200_000).select(
        "id", (F.rand(1) * 20 + 10).alias("lon"), (F.rand(2) * 20 + 40).alias("lat")
    ).union(spark.sql("SELECT -1L, CAST(NULL AS DOUBLE), 50.0D")).cache()
    spark.conf.set("parquet.block.size", 40_000)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        space_layout.write_by_place(points, path, "lon", "lat", "lon", "lat")
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    box = (21.5, 50.2, 22.5, 51.3)
    found = spatial.within_bbox(space_layout.read_around(spark, path, *box), *box)
    want = spatial.within_bbox(points, *box)
    assert sorted(found.collect()) == sorted(want.collect()) and want.count() > 100
    assert spark.read.parquet(path).count() == 200_001
    assert scanned_rows(found) < 60_000


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_rows_are_met(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        x, y = rng.uniform(-170, 150), rng.uniform(-80, 60)
        rows.append((i, x, y, x + rng.choice([0, 1e-7, 0.3, 4, 40, 300]), y + rng.choice([0, 0.001, 2, 90])))
    frame = spark.createDataFrame(rows, "id INT, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    path = str(tmp_path / "boxes")
    space_layout.write_by_place(frame, path, "minx", "miny", "maxx", "maxy")
    for _ in range(4):
        x, y = rng.uniform(-170, 150), rng.uniform(-80, 60)
        box = (x, y, x + rng.uniform(0, 20), y + rng.uniform(0, 20))
        meets = f"minx <= {box[2]} AND maxx >= {box[0]} AND miny <= {box[3]} AND maxy >= {box[1]}"
        found = space_layout.read_around(spark, path, *box).where(meets)
        assert sorted(r.id for r in found.collect()) == sorted(
            r.id for r in frame.where(meets).collect())


def test_interleaved(spark):
    row = spark.range(1).select(
        G.interleaved(F.lit(5), F.lit(3), 4).alias("a"), G.interleaved(F.lit(65535), F.lit(0), 16).alias("b")).first()
    assert (row.a, row.b) == (code(5, 3), code(65535, 0))


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    empty = spark.createDataFrame([(1, 2.0, None)], "id INT, lon DOUBLE, lat DOUBLE")
    space_layout.write_by_place(empty, path, "lon", "lat", "lon", "lat")
    assert space_layout.read_around(spark, path, 0, 0, 9, 9).isEmpty()


def test_missing_values_are_counted_by_the_write(spark, tmp_path):
    frame = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a INT, b STRING")
    path = str(tmp_path / "t")
    found = quality.missing_as_written(frame, path, ("a", "b"))
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, quality.missing_values(frame, ("a", "b")).collect()))
    assert spark.read.parquet(path).count() == 3
