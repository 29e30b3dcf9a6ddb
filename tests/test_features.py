"""Large collections read in byte ranges, beside the reader of whole documents."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bloomgrid.sources import features, files


@pytest.fixture
def small_ranges(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size),
                        spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
    spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def collection(rng, count):
    """Features with braces, quotes and escapes in their names, short and long outlines."""
    made = []
    for k in range(count):
        ring = [[rng.uniform(20, 24), rng.uniform(49, 54)] for _ in range(rng.choice([3, 40, 120]))]
        name = rng.choice(["plain", 'a "quoted" {name}', "back\\slash\\", "}{][", "zażółć \u2028 é", "\\\"}", '"Feature"'])
        feature = {
            "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]},
            "properties": {"cell_id": k, "station_id": f"S{k}", "station_name": name, "extra": {"a": [{"b": {}}]}},
        }
        if k % 3 == 0:
            feature = dict(reversed(feature.items()))
        made.append(feature)
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}},
            "bbox": [[1, 2], [3, 4]], "features": made, "after": {"links": [{"type": "x"}]}}


def rows(frame):
    names = ("cell_id", "station_name", "geom_type", "polys", "bbox")
    return [tuple(r) for r in frame.orderBy("position").select(*names).collect()]


@pytest.mark.parametrize("size", [1_500, 9_000, 10_000_000])
def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    for name, indent in (("a", None), ("b", 1)):
        text = json.dumps(collection(rng, 25), indent=indent, ensure_ascii=name == "a")
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8")
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[]}\n')
    whole = rows(files.read_zones(spark, str(tmp_path)))
    small_ranges(size)
    found = files.read_large_zones(spark, str(tmp_path))
    assert len(whole) == 50 and rows(found) == whole
    tasks = features._chunks(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    assert tasks > 1 or size > 1_000_000


def test_broken_features_fail(spark, tmp_path):
    text = json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [["a"]]},
                                     "properties": {"cell_id": 1}}]})
    (tmp_path / "a.geojson").write_text(text)
    for reader in (files.read_zones, files.read_large_zones):
        with pytest.raises((PySparkException, Py4JJavaError)):
            reader(spark, str(tmp_path)).collect()
    (tmp_path / "a.geojson").write_text(text.replace('"cell_id": 1', '"cell_id": x'))
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_large_zones(spark, str(tmp_path)).collect()
