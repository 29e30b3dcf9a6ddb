"""Station and zone layers: choosing one row per station, joining windows, simplifying."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.functions import labels as L
from bloomgrid.functions.values import text_or_null
from bloomgrid.operators.outlines import simplifier
from bloomgrid.schemas import BBOX, POLYGONS

SIMPLIFY_TOLERANCE = 0.02


def station_points(zones: DataFrame) -> DataFrame:
    """First complete row per station in file order, as points.

    Rows without id or coordinates are left out before the choice. A missing name falls back to
    the id.
    """
    complete = zones.where(
        text_or_null(F.col("station_id")).isNotNull()
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )
    first = F.min(F.struct("position", "station_name", "station_type", "longitude", "latitude"))
    return complete.groupBy("station_id").agg(first.alias("f")).select(
        "station_id",
        F.coalesce("f.station_name", "station_id").alias("station_name"),
        F.col("f.station_type").alias("station_type"),
        F.col("f.longitude").alias("lon"),
        F.col("f.latitude").alias("lat"),
        F.col("f.position").alias("position"),
    )


def stations(zones: DataFrame) -> DataFrame:
    """Distinct (id, name, area)."""
    return zones.select("station_id", "station_name", "area_ha").distinct()


def station_by_id(station_list: DataFrame) -> DataFrame:
    """One row per station: the last of the list as ordered by name, then area."""
    last = F.max(F.struct("station_name", "area_ha")).alias("s")
    return (
        station_list.where(text_or_null(F.col("station_id")).isNotNull())
        .groupBy("station_id")
        .agg(last)
        .select("station_id", "s.*")
    )


def first_zone(zones: DataFrame) -> DataFrame:
    """One zone row per station: the lowest cell_id."""
    first = F.min(F.struct("cell_id", "station_name", "area_ha")).alias("z")
    return zones.groupBy("station_id").agg(first).select("station_id", "z.*")


def search_stations(station_list: DataFrame, query: str) -> DataFrame:
    """Ids whose id or label holds the text, case aside; an empty text finds all."""
    found = station_by_id(station_list)
    text = query.strip().lower()
    if text:
        label = L.station_label(F.col("station_name"), F.col("station_id"))
        found = found.where(
            F.contains(F.lower("station_id"), F.lit(text)) | F.contains(F.lower(label), F.lit(text))
        )
    return found.withColumn(
        "label", L.station_label(F.col("station_name"), F.col("station_id"))
    ).select("station_id", "label")


def with_windows(zones: DataFrame, windows: DataFrame, plants: DataFrame, plant_id: str,
                 ) -> DataFrame:
    """Zones with one plant's bloom window and text; zones without a window get the default."""
    dates = windows.where(F.col("plant_id") == plant_id).select(
        "station_id", "bloom_start_date", "bloom_end_date"
    )
    named = plants.where(F.col("id") == plant_id).agg(F.max("name_pl").alias("name"))
    unknown = F.raise_error(F.lit(f"no plant {plant_id}")).cast("string")
    name = named.select(F.coalesce("name", unknown)).scalar()
    kept = [c for c in zones.columns if not c.startswith("bloom_")]
    joined = zones.select(*kept).join(dates, "station_id", "left")
    text = L.bloom_tooltip(name, F.col("bloom_start_date"), F.col("bloom_end_date"))
    return joined.withColumn("bloom_tooltip", F.coalesce(text, L.no_bloom_tooltip(name)))


def first_features(zones: DataFrame, n: int) -> DataFrame:
    """The first rows of the layer by cell_id, as listed in a preview."""
    return zones.orderBy("cell_id", "station_id").limit(n).select(
        "cell_id", "station_name", "station_id",
        F.coalesce("area_ha", F.lit(0.0)).alias("area_ha"),
    )


# simplification ---------------------------------------------------------------------------


def by_distance(tolerance: float):
    """Douglas-Peucker for one closed ring: which points stay. A ring that would collapse stays whole."""

    def kept(points: np.ndarray) -> np.ndarray:
        keep = np.ones(len(points), dtype=bool)
        if len(points) <= 4:
            return keep
        keep[1:-1] = False
        spans = [(0, len(points) - 1)]
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            line = points[b] - points[a]
            offset = points[a + 1:b] - points[a]
            length2 = float(line @ line)
            if length2 > 0.0:
                share = np.clip(offset @ line / length2, 0.0, 1.0)
                offset = offset - share[:, None] * line
            distance2 = np.einsum("ij,ij->i", offset, offset)
            far = int(np.argmax(distance2))
            if distance2[far] > tolerance * tolerance:
                keep[a + 1 + far] = True
                spans += [(a, a + 1 + far), (a + 1 + far, b)]
        return keep if keep.sum() >= 4 else np.ones(len(points), dtype=bool)

    return kept


def ring_simplifier(tolerance: float):
    """One ring simplified by distance alone."""
    kept = by_distance(tolerance)

    def simplify_ring(ring) -> list:
        points = np.array([list(p) for p in ring], dtype=float)
        return points[kept(points)].tolist()

    return simplify_ring


def simplify(zones: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """The layer with simplified outlines that stay valid (see `outlines`), each row for itself.

    Rows without any point have nothing to simplify. They travel with a stand-in point, since
    a batch of nothing but empty nested lists cannot be turned into pandas.
    """
    others = [c for c in zones.columns if c not in ("polys", "bbox")]
    points = F.size(F.flatten(F.flatten("polys")))
    state = F.when(F.col("polys").isNull(), "none").when(points > 0, "full").otherwise("empty")
    stand_in = F.array(F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)))))
    carried = zones.select(*others, state.alias("_state"), "polys").withColumn(
        "polys", F.when(F.col("_state") == "full", F.col("polys")).otherwise(stand_in)
    )
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in zones.select(*others).schema]
        + [f"_state STRING, polys {POLYGONS}"]
    )
    simplified = simplifier(by_distance(tolerance))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["polys"] = [simplified(polys) for polys in batch["polys"]]
            yield batch

    slim = carried.mapInPandas(run, schema)
    restored = F.when(F.col("_state") == "full", F.col("polys")).when(
        F.col("_state") == "empty", F.array().cast(POLYGONS)
    )
    box = F.when(F.col("polys").isNotNull(), G.bbox_of(F.col("polys")).cast(BBOX))
    return slim.withColumn("polys", restored).drop("_state").withColumn("bbox", box)
