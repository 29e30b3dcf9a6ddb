"""Scene search to mosaic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from bloomgrid.operators import mosaics
from bloomgrid.operators import scenes as sc


def best_scenes(scenes: DataFrame, first: dt.date, last: dt.date, max_cloud: float,
                limit: int | None = None) -> DataFrame:
    """Best scene per region tile among all matching scenes, or among the `limit` clearest."""
    return sc.best_per_tile(sc.search_scenes(scenes, first, last, max_cloud, limit=limit))


def coverage_report(scenes: DataFrame, first: dt.date, last: dt.date, max_cloud: float,
                    limit: int | None = None) -> DataFrame:
    return sc.coverage(best_scenes(scenes, first, last, max_cloud, limit))


def mosaic_manifests(request_urls: DataFrame, footprints: DataFrame,
                     stored: DataFrame | None = None) -> DataFrame:
    """Manifests of all distinct link sets asked for, but for those stored already.

    Sets with a link of unknown footprint have none; `mosaics.incomplete_sets` names them.
    """
    sets = mosaics.distinct_sets(mosaics.link_lists(request_urls))
    if stored is not None:
        sets = mosaics.new_manifests(sets, stored)
    return mosaics.manifests(sets, footprints)


def catalogue_search(items: DataFrame, bbox: tuple[float, float, float, float], interval: str,
                     ) -> DataFrame:
    return sc.item_summary(sc.search_catalogue(items, bbox, interval))
