"""Manifests: digests, limits, tile lists, write-once."""

import hashlib

from pyspark.sql import functions as F

from bloomgrid import quality
from bloomgrid.operators import mosaics
from bloomgrid.plans import scenes as plans
from bloomgrid.sources import files, sinks

# One public image link, its extent, and the digest and tiles it must give.
LINK = (
    "https://sentinel-cogs.s3.us-west-2.amazonaws.com/sentinel-s2-l2a-cogs/34/U/EB/2024/8/"
    "S2B_34UEB_20240828_0_L2A/TCI.tif"
)
BOX = (20.999712, 50.453523, 22.579544, 51.451182)
DIGEST = "547f9db1f525743b"
TILES = ["1202131", "1202133", "1203020", "1203022"]
URLS = "request_id INT, url STRING"
FOOTPRINT = "url STRING, bbox STRUCT<minx: DOUBLE, miny: DOUBLE, maxx: DOUBLE, maxy: DOUBLE>"


def test_known_manifest(spark):
    requests = spark.createDataFrame([(1, LINK), (1, LINK), (2, LINK)], URLS)
    footprints = spark.createDataFrame([(LINK, BOX)], FOOTPRINT)
    rows = plans.mosaic_manifests(requests, footprints).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["digest"] == DIGEST
    assert sorted(row["tiles"]) == TILES and set(map(tuple, row["tiles"].values())) == {(LINK,)}
    assert row["bounds"] == list(BOX)
    assert row["center"] == [(BOX[0] + BOX[2]) / 2, (BOX[1] + BOX[3]) / 2, 7.0]
    assert (row["minzoom"], row["maxzoom"], row["quadkey_zoom"]) == (7, 13, 7)
    digests = mosaics.request_digests(mosaics.link_lists(requests))
    assert sorted(tuple(r) for r in digests.collect()) == [(1, DIGEST, 1), (2, DIGEST, 1)]


def test_lists_are_ordered_and_sets_with_unknown_links_left_out(spark):
    requests = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "gone")], URLS)
    box = (10.0, 50.0, 10.1, 50.1)
    footprints = spark.createDataFrame([("a", box), ("b", box)], FOOTPRINT)
    rows = plans.mosaic_manifests(requests, footprints).collect()
    assert [r["digest"] for r in rows] == [hashlib.sha256(b"a|b").hexdigest()[:16]]
    assert list(rows[0]["tiles"].values()) == [["a", "b"]]
    index = mosaics.quadkey_index(mosaics.placed_links(
        mosaics.distinct_sets(mosaics.link_lists(requests)), footprints)).collect()
    assert all(r["urls"] == ["a", "b"] for r in index)
    sets = mosaics.distinct_sets(mosaics.link_lists(requests))
    lacking = mosaics.incomplete_sets(sets, footprints).collect()
    assert [(r["links"], r["missing"]) for r in lacking] == [(2, ["gone"])]


def test_request_sizes(spark):
    rows = [(1, f"u{i}") for i in range(32)] + [(2, f"u{i}") for i in range(33)]
    rows += [(3, "same")] * 33 + [(4, None)]
    frame = spark.createDataFrame(rows, URLS)
    lists = mosaics.link_lists(frame).collect()
    assert sorted((r["request_id"], len(r["urls"])) for r in lists) == [(1, 32), (2, 33), (3, 1)]
    listed = spark.createDataFrame(
        [(1, ["a", "b"]), (2, []), (3, ["x"] * 33), (4, None)],
        "request_id INT, urls ARRAY<STRING>")
    assert sorted(tuple(r) for r in files.request_urls(listed).distinct().collect()) == [
        (1, "a"), (1, "b"), (3, "x")]
    refused = quality.refused_requests(listed).collect()
    assert sorted((r["request_id"], r["links"]) for r in refused) == [(2, 0), (3, 33), (4, 0)]


def test_extent(spark):
    sets = spark.createDataFrame([("d", ["a", "b"])], "digest STRING, urls ARRAY<STRING>")
    footprints = spark.createDataFrame(
        [("a", (1.0, 2.0, 3.0, 4.0)), ("b", (0.0, 3.0, 2.0, 8.0))], FOOTPRINT)
    row = mosaics.mosaic_extent(mosaics.placed_links(sets, footprints)).first()
    assert tuple(row) == ("d", 0.0, 2.0, 3.0, 8.0, 1.5, 5.0)


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "manifests")
    first = spark.createDataFrame([("d1", 1), ("d2", 1)], "digest STRING, v INT")
    sinks.append_new_manifests(spark, first, path)
    sinks.append_new_manifests(
        spark, spark.createDataFrame([("d2", 9), ("d3", 9)], "digest STRING, v INT"), path)
    rows = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert rows == [("d1", 1), ("d2", 1), ("d3", 9)]


def test_set_digest_ignores_order_and_copies(spark):
    frame = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],)], "u ARRAY<STRING>")
    rows = frame.select(mosaics.set_digest(F.col("u")).alias("d")).distinct().collect()
    assert [r["d"] for r in rows] == [hashlib.sha256(b"a|b").hexdigest()[:16]]


def test_a_set_is_made_in_one_row(spark):
    requests = spark.createDataFrame([(1, u) for u in "cab"] + [(2, "a")], URLS)
    footprints = spark.createDataFrame(
        [("a", (1.0, 1.0, 4.0, 2.0)), ("b", (3.0, 1.0, 5.0, 2.0)), ("b", (3.0, 1.0, 5.0, 2.0)),
         ("c", (1.0, 1.0, 2.0, 2.0))], FOOTPRINT)
    made = plans.mosaic_manifests(requests, footprints)
    plan = made._jdf.queryExecution().executedPlan().toString()
    rows = {len(set(sum(r["tiles"].values(), []))): r for r in made.collect()}
    assert [urls for _, urls in sorted(rows[3]["tiles"].items())] == [["a", "c"], ["a", "b"]]
    assert list(rows[1]["tiles"].values()) == [["a"], ["a"]] and rows[3]["bounds"] == [1.0, 1.0, 5.0, 2.0]
    assert "Window" not in plan and plan.count("ObjectHashAggregate(") == 4


def test_links_of_a_request_shuffle_once(spark):
    lists = mosaics.link_lists(spark.createDataFrame([(1, "b"), (1, "b"), (1, "a")], URLS))
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r["urls"] for r in lists.collect()] == [["a", "b"]]
