"""Scene search, best scene, coverage and catalogue upsert."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomgrid import schemas
from bloomgrid.functions import scenes as S
from bloomgrid.operators import scenes as sc
from bloomgrid.plans import scenes as plans


def scene(id, code="MGRS-34UEB", cloud=1.0, nodata=0.0, day="2024-08-28T10:00:00",
          href="h", collection="sentinel-2-l2a", box=(22.0, 51.0, 23.0, 52.0), platform=None):
    assets = None if href is None else {"visual": (href, None, None, None)}
    stamp = dt.datetime.fromisoformat(day)
    return (id, collection, stamp, day + "Z", *box, code, cloud, nodata, platform, assets)


def scenes(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SCENE)


def ids(frame):
    return [r["id"] for r in frame.collect()]


WINDOW = (dt.date(2024, 8, 27), dt.date(2024, 8, 29), 20.0)


def test_search_bounds(spark):
    frame = scenes(
        spark,
        scene("first", day="2024-08-27T00:00:00", cloud=3.0),
        scene("last", day="2024-08-29T23:59:59", cloud=2.0),
        scene("late", day="2024-08-30T00:00:00"),
        scene("at-limit", cloud=20.0),
        scene("no-cloud", cloud=None),
        scene("touching", box=(24.2, 51.0, 25.0, 52.0), cloud=1.0),
        scene("outside", box=(24.21, 51.0, 25.0, 52.0)),
        scene("other", collection="other"),
        scene("no-link", href=""),
        scene("no-assets", href=None),
    )
    assert sorted(ids(sc.search_scenes(frame, *WINDOW))) == ["first", "last", "touching"]
    assert ids(sc.search_scenes(frame, *WINDOW, limit=9)) == ["touching", "last", "first"]
    # An end before the start is moved to the start.
    assert ids(sc.search_scenes(frame, dt.date(2024, 8, 29), dt.date(2024, 8, 1), 20.0)) == ["last"]


def test_limit_comes_before_the_link_test(spark):
    frame = scenes(spark, scene("a", cloud=1.0, href=""), scene("b", cloud=2.0),
                   scene("c", cloud=3.0))
    assert ids(sc.search_scenes(frame, *WINDOW, limit=2)) == ["b"]
    assert sorted(ids(sc.search_scenes(frame, *WINDOW, limit=None))) == ["b", "c"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "scenes")
    scenes(spark, scene("a")).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    found = sc.search_scenes(spark.read.parquet(path), *WINDOW)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(collection", "LessThan(cloud_cover,20.0)", "LessThanOrEqual(minx,24.2)",
                 "GreaterThanOrEqual(acquired_at"):
        assert part in plan
    assert "Sort" not in plan
    page = sc.search_scenes(spark.read.parquet(path), *WINDOW, limit=5)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_best_scene_ties_and_missing_values(spark):
    frame = scenes(
        spark,
        scene("b", cloud=5.0), scene("a", cloud=5.0),                       # rank wins
        scene("c", "MGRS-34UEC", cloud=None), scene("d", "MGRS-34UEC", cloud=0.5),
        scene("e", "MGRS-34UFA", nodata=None, cloud=9.0),
        scene("f", "MGRS-34UFA", nodata=1.0, cloud=0.0),
        scene("g", "MGRS-35UKR"), scene("x", "MGRS-99XXX"),
        scene("S2B_34UED_20240828_0_L2A", None),
    )
    best = {r["tile"]: r["id"] for r in sc.best_per_tile(frame.withColumn("href", F.lit("h"))).collect()}
    assert best == {
        "MGRS-34UEB": "a", "MGRS-34UEC": "c", "MGRS-34UFA": "e", "MGRS-35ULR": "g",
        "MGRS-34UED": "S2B_34UED_20240828_0_L2A",
    }


def test_coverage_and_tiles(spark):
    frame = scenes(
        spark,
        scene("S2A_34UEB_1", cloud=4.0, nodata=6.0),
        scene("S2B_34UEC_1", "MGRS-34UEC", cloud=8.0, nodata=5.0, day="2024-08-27T10:00:00"),
    )
    best = plans.best_scenes(frame, *WINDOW)
    report = sc.coverage(best).first()
    assert (report["covered"], report["wanted"]) == (2, 16)
    assert (report["avg_cloud"], report["max_cloud"], report["max_nodata"]) == (6.0, 8.0, 6.0)
    assert (report["dates"], report["platforms"], report["partial"]) == (2, ["S2A", "S2B"], ["34UEB"])
    missing = [r["tile"] for r in sc.missing_tiles(best).collect()]
    assert missing == report["missing"]
    assert sorted([*missing, "34UEB", "34UEC"]) == sorted(
        t.removeprefix("MGRS-") for t in S.REGION_TILES)
    assert [tuple(r) for r in sc.partial_tiles(best).collect()] == [("34UEB", 6.0)]
    assert [(r["tile"], r["day"], r["platform"]) for r in sc.tile_details(best).collect()] == [
        ("34UEB", "2024-08-28", "S2A"), ("34UEC", "2024-08-27", "S2B")]


def test_coverage_of_nothing(spark):
    report = plans.coverage_report(scenes(spark, scene("a", cloud=90.0)), *WINDOW).first()
    assert report["covered"] == 0 and len(report["missing"]) == 16 and report["avg_cloud"] is None


@pytest.mark.parametrize(("interval", "found"), [
    ("2020-01-01T00:00:00Z/..", ["b", "c"]),
    ("../2020-01-01T00:00:00Z", ["a", "b"]),
    ("../..", ["a", "b", "c"]),
    ("2020-01-01T00:00:00Z", ["b"]),
    ("2019-01-01T00:00:00Z/2020-06-01T00:00:00Z", ["b"]),
])
def test_catalogue_intervals(spark, interval, found):
    frame = scenes(spark, scene("a", day="2018-01-01T00:00:00"),
                   scene("b", day="2020-01-01T00:00:00"), scene("c", day="2021-01-01T00:00:00"),
                   scene("far", box=(0.0, 0.0, 1.0, 1.0)))
    got = plans.catalogue_search(frame, (21.0, 50.0, 24.5, 52.0), interval)
    assert sorted(ids(got)) == found
    assert got.first()["asset_keys"] == ["visual"]


def test_replaced_collections(spark):
    schema = "id STRING, collection STRING, v INT"
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("a", "y", 1), ("c", "z", 1)], schema)
    load = spark.createDataFrame(
        [("a", "x", 2, 1), ("a", "x", 3, 2), ("n", "w", 4, 3)], schema + ", position INT")
    names = spark.createDataFrame([("x",), ("w",), ("z",)], "collection STRING")

    def rows(frame):
        return sorted(tuple(r) for r in frame.select("collection", "id", "v").collect())

    assert rows(sc.replace_collections(old, load)) == [
        ("w", "n", 4), ("x", "a", 3), ("y", "a", 1), ("z", "c", 1)]
    # A collection may come with no item at all.
    assert rows(sc.replace_collections(old, load, names)) == [
        ("w", "n", 4), ("x", "a", 3), ("y", "a", 1)]


def test_items_per_collection(spark):
    frame = scenes(spark, scene("a"), scene("b"), scene("c", collection="other"))
    counts = {r["collection"]: r["items"] for r in sc.items_per_collection(frame).collect()}
    assert counts == {"sentinel-2-l2a": 2, "other": 1}


def test_upserted_documents(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "old")], "id STRING, title STRING")
    load = spark.createDataFrame(
        [("b", "first", 1), ("b", None, 2), ("c", "new", 0)],
        "id STRING, title STRING, position INT")
    rows = sorted(tuple(r) for r in sc.upsert_by_id(stored, load).collect())
    assert rows == [("a", "old"), ("b", None), ("c", "new")]
