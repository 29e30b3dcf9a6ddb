"""Registered queries: the public query surface and its operators over whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid import quality, schemas
from bloomgrid.functions import labels as L
from bloomgrid.functions import scenes as S
from bloomgrid.functions import values as V
from bloomgrid.operators import gdd as gd
from bloomgrid.operators import layers, mosaics, space_layout, spatial, weather, zone_index
from bloomgrid.operators import scenes as sc
from bloomgrid.plans import layers as layer_plans
from bloomgrid.plans import refresh
from bloomgrid.plans import scenes as scene_plans
from bloomgrid.plans import stations as station_plans
from bloomgrid.plans import weather as weather_plans
from bloomgrid.session import cut_lineage, shared_folder
from bloomgrid.sources import files, sinks, tables
from checks.views import Views

PLANT = "P2"
SEARCH = (dt.date(1996, 1, 1), dt.date(1998, 12, 31), 60.0)
CATALOGUE_BBOX = (21.0, 50.0, 24.5, 52.0)
LOCATION_BBOX = (21.5, 50.2, 24.2, 52.3)

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: function(Views(spark, folder))

    return {name: bind(function) for name, function in QUERIES.items()}


def text_list(column: str):
    return F.array_join(column, ",").alias(column)


# sources ----------------------------------------------------------------------------------


@query
def s01_landed_readings(v: Views) -> DataFrame:
    rows = files.parse_reading_pages(v.reading_pages())
    return rows.select(
        "station_id", V.reading_day(F.col("measured_at")).alias("date"), "air_temperature"
    )


@query
def s02_extraction_plan(v: Views) -> DataFrame:
    return weather.extraction_plan(v.readings(), dt.date(2024, 1, 1), dt.date(2025, 12, 31))


@query
def s03_zone_files(v: Views) -> DataFrame:
    return files.parse_zone_collections(v.zone_documents()).select(
        "position", "cell_id", "station_id", "station_name", "area_ha", "latitude", "longitude",
        "station_type", "geom_type", F.size("polys").alias("parts"), "bbox.*",
    )


@query
def s03_large_zone_files(v: Views) -> DataFrame:
    """Zone collections written as text, read in byte ranges by any number of tasks."""
    path = _scratch(v)
    v.zone_documents().write.text(path)
    return files.read_large_zones(v.spark, path).select(
        "cell_id", "station_id", "station_name", "area_ha", "latitude", "longitude",
        "station_type", "geom_type", F.size("polys").alias("parts"), "bbox.*",
    )


@query
def s04_boundary_files(v: Views) -> DataFrame:
    return files.parse_boundaries(v.boundary_documents()).select(
        F.size("ring").alias("points"), F.col("ring")[0][0].alias("first_lon"),
        F.col("ring")[0][1].alias("first_lat"),
    )


@query
def s06_plant_files(v: Views) -> DataFrame:
    return files.parse_plants(v.plant_documents())


@query
def s07_item_files(v: Views) -> DataFrame:
    return files.parse_scenes(v.item_documents()).select(
        "id", "collection", "acquired_at", "datetime", "minx", "miny", "maxx", "maxy",
        "grid_code", "cloud_cover", "nodata_pct", "platform",
        S.visual_href(F.col("assets")).alias("href"),
        F.size(F.col("assets")["visual"]["roles"]).alias("roles"),
    )


@query
def s08_precipitation_files(v: Views) -> DataFrame:
    return files.precipitation_rows(v.precipitation_files())


def _scratch(v: Views) -> str:
    return f"{shared_folder(v.spark).rstrip('/')}/written-{uuid.uuid4().hex}"


@query
def s05_gdd_csv(v: Views) -> DataFrame:
    """Written as compressed CSV and read again, numbers cast and missing ones kept."""
    path = _scratch(v)
    sinks.write_csv(gd.gdd_table(v.daily(), v.plants()), path, compression="gzip")
    return files.read_station_gdd(v.spark, path)


@query
def s07_collection_files(v: Views) -> DataFrame:
    found = files.parse_stac_collections(v.collection_documents())
    return found.select("id", "title", F.col("extent.spatial.bbox")[0][0].alias("minx"))


@query
def s07_customer_collections(v: Views) -> DataFrame:
    """Collection documents stored as a catalogue table, loaded again in part."""
    path = _scratch(v)
    found = files.parse_stac_collections(v.customer_collections())
    loaded = found.select("id", "title", F.col("extent.spatial.bbox")[0][0].alias("minx"))
    tables.refresh(loaded, path, F.floor(F.col("minx")))
    return files.read_table(v.spark, path)


@query
def k01_history_csv(v: Views) -> DataFrame:
    path = _scratch(v)
    sinks.write_history_csv(v.daily(), path)
    return files.read_daily_history(v.spark, path).drop("position")


@query
def k02_refreshed_daily_table(v: Views) -> DataFrame:
    path = _scratch(v)
    sinks.refresh_daily_table(v.daily(), path)
    return files.read_table(v.spark, path)


@query
def k02_merged_twice(v: Views) -> DataFrame:
    """A stored table that is read, merged with new readings and refreshed under its own path, twice."""
    path, fresh = _scratch(v), weather.daily_extremes(v.readings_new())
    sinks.refresh_daily_table(weather_plans.daily_temperatures(v.readings_new(), v.history()), path)
    for _ in range(2):
        stored = files.read_table(v.spark, path).withColumn("position", F.lit(0))
        sinks.refresh_daily_table(weather.keep_last(stored, fresh), path)
    return files.read_table(v.spark, path).drop("year")


@query
def u01_incremental_refresh(v: Views) -> DataFrame:
    """The degree-day table after a rebuild from earlier readings and the taking in of later ones."""
    daily, table = _scratch(v), _scratch(v)
    later = F.col("date") >= F.lit(dt.date(1998, 8, 1))
    refresh.rebuild(v.readings().where(~later), v.plants(), daily, table)
    refresh.take_in(v.readings().where(later), v.plants(), daily, table)
    return files.read_table(v.spark, table)


@query
def k03_stored_scenes(v: Views) -> DataFrame:
    """The scene table with assets, stored and then loaded again for one of its collections."""
    path, scenes = _scratch(v), v.scenes()
    sinks.store_catalogue(scenes, path)
    sinks.store_catalogue(scenes.where("collection = 'other' AND cloud_cover < 50"), path)
    return files.read_table(v.spark, path).select(
        "id", "collection", "cloud_cover", S.visual_href(F.col("assets")).alias("href")
    )


@query
def k04_feature_document(v: Views) -> DataFrame:
    """The document of a small layer, taken apart again."""
    features = layer_plans.station_point_features(v.zones())
    document = sinks.feature_collection(features, limit=1_000_000)
    parsed = F.from_json("document", "features ARRAY<STRING>", files.STRICT)
    return document.select(F.explode(parsed["features"]).alias("feature"))


@query
def k04_tile_documents(v: Views) -> DataFrame:
    """Documents per map tile of the whole layer, taken apart again."""
    features = layer_plans.station_point_features(v.zones())
    documents = sinks.feature_documents(features, F.col("lon"), F.col("lat"), most=20)
    parsed = F.from_json("document", "features ARRAY<STRING>", files.STRICT)
    return documents.select(F.explode(parsed["features"]).alias("feature"))


# weather ----------------------------------------------------------------------------------


@query
def q01_daily_temperatures(v: Views) -> DataFrame:
    return weather_plans.daily_temperatures(v.readings_new(), v.history())


@query
def a01_daily_extremes(v: Views) -> DataFrame:
    return weather.daily_extremes(v.readings_new())


@query
def a02_history_profile(v: Views) -> DataFrame:
    return weather.history_profile(v.daily())


@query
def a08_station_ids(v: Views) -> DataFrame:
    return weather.station_ids(v.readings())


@query
def q02_bloom_table(v: Views) -> DataFrame:
    return weather_plans.bloom_table(v.daily(), v.plants())


@query
def a03_yearly_windows(v: Views) -> DataFrame:
    return gd.searched_years(v.daily(), v.plants())


@query
def a03_planted_windows(v: Views) -> DataFrame:
    """Windows of every year where a plant of the growing dictionary stands."""
    return gd.searched_years(v.daily(), v.catalogue_plants(), v.plantings())


@query
def w03_catalogue_windows(v: Views) -> DataFrame:
    """Latest windows of all stations for all plants of the growing dictionary."""
    return weather_plans.bloom_windows(v.daily(), v.catalogue_plants())


@query
def w03_bloom_windows(v: Views) -> DataFrame:
    return weather_plans.bloom_windows(v.daily(), v.plants())


@query
def q03_zone_bloom_windows(v: Views) -> DataFrame:
    windows = weather_plans.bloom_windows(v.daily(), v.plants().where(F.col("id") == PLANT))
    return weather_plans.zones_with_bloom(v.zones(), windows, v.plants(), PLANT).select(
        "cell_id", "station_id", "bloom_start_date", "bloom_end_date", "bloom_tooltip"
    )


@query
def q03_stored_windows(v: Views) -> DataFrame:
    stored = gd.gdd_table(v.daily(), v.plants()).drop("t_min", "t_max", "t_mean")
    return weather_plans.stored_windows(stored, v.plants())


@query
def j01_planted_stations(v: Views) -> DataFrame:
    return gd.gdd_table(v.daily(), v.plants(), v.day_requests()).select(
        "station_id", "plant_id", "date", "gdd_cumulative", "bloom_phase"
    )


@query
def p05_days_of_year(v: Views) -> DataFrame:
    return weather.days_of_year(v.daily(), 2000)


@query
def p08_bloom_rows(v: Views) -> DataFrame:
    return gd.bloom_rows(gd.gdd_table(v.daily(), v.plants())).select(
        "station_id", "plant_id", "date", "t_mean", "gdd_cumulative", "bloom_day"
    )


@query
def q22_animation_frames(v: Views) -> DataFrame:
    rows = gd.growing_degree_days(v.daily(), v.plants())
    return weather_plans.animation_frames(rows).select(
        "station_id", "plant_id", "date", "gdd_cumulative", "phase_label", "frame_date"
    )


@query
def o04_bloom_preview(v: Views) -> DataFrame:
    return weather_plans.bloom_preview(gd.gdd_table(v.daily(), v.plants()), 20)


@query
def u06_threshold_rows(v: Views) -> DataFrame:
    return gd.threshold_rows(v.catalogue_plants())


# stations ---------------------------------------------------------------------------------


@query
def q04_station_list(v: Views) -> DataFrame:
    return station_plans.station_list(v.zones())


@query
def f32_station_choices(v: Views) -> DataFrame:
    return station_plans.station_choices(v.zones())


@query
def q23_station_search(v: Views) -> DataFrame:
    return station_plans.station_search(v.zones(), " #00000001")


@query
def u03_station_by_id(v: Views) -> DataFrame:
    return layers.station_by_id(layers.stations(v.zones()))


@query
def q12_plant_dictionary(v: Views) -> DataFrame:
    return station_plans.plant_list(v.catalogue_plants())


@query
def f29_plant_choices(v: Views) -> DataFrame:
    return station_plans.plant_choices(v.catalogue_plants())


@query
def a06_precipitation(v: Views) -> DataFrame:
    monthly = weather.monthly_precipitation(v.precipitation())
    return monthly.join(weather.annual_precipitation(monthly), ["station_id", "year"])


def _summaries(v: Views) -> DataFrame:
    return station_plans.monthly_summaries(
        v.daily(), v.year_requests(), v.zones(), v.precipitation(), plants=v.plants()
    )


@query
def q09_monthly_summary(v: Views) -> DataFrame:
    return station_plans.summary_rows(_summaries(v))


@query
def q21_annual_status(v: Views) -> DataFrame:
    return station_plans.annual_statuses(_summaries(v), v.plants())


@query
def w04_gdd_chart(v: Views) -> DataFrame:
    return station_plans.gdd_chart(_summaries(v))


def _series(v: Views) -> DataFrame:
    return station_plans.daily_rows(
        v.daily(), v.year_requests(), v.zones(), v.precipitation(), plants=v.plants()
    )


@query
def q10_daily_series(v: Views) -> DataFrame:
    return _series(v)


@query
def j01_daily_with_stored_totals(v: Views) -> DataFrame:
    """Days joined with a stored table, the plant inside the join key."""
    daily = v.daily()
    return station_plans.daily_rows(
        daily, v.year_requests(), v.zones(), v.precipitation(),
        gdd=gd.gdd_table(daily, v.plants()),
    )


@query
def k06_series_documents(v: Views) -> DataFrame:
    total = F.aggregate(
        "points", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["gdd_daily"], F.lit(0.0))
    )
    return station_plans.daily_series(_series(v)).select(
        "station_id", "station_name", "year", "plant_id", F.size("points").alias("days"),
        F.element_at("points", 1)["date"].alias("first_day"),
        F.element_at("points", -1)["date"].alias("last_day"),
        F.element_at("points", -1)["t_mean"].alias("last_t_mean"),
        total.alias("gdd_sum"),
    )


@query
def q11_bloom_status(v: Views) -> DataFrame:
    return station_plans.bloom_status(v.plants(), v.zones(), v.day_requests(), daily=v.daily())


# layers and points ------------------------------------------------------------------------


@query
def q05_station_points(v: Views) -> DataFrame:
    return layer_plans.station_point_features(v.zones()).drop("position")


@query
def q06_zone_layer(v: Views) -> DataFrame:
    windows = weather_plans.bloom_windows(v.daily(), v.plants().where(F.col("id") == PLANT))
    zones = weather_plans.zones_with_bloom(v.zones(), windows, v.plants(), PLANT)
    return layer_plans.zone_layer(zones).select("cell_id", "feature")


@query
def p16_zone_tips(v: Views) -> DataFrame:
    windows = weather_plans.bloom_windows(v.daily(), v.plants().where(F.col("id") == PLANT))
    zones = weather_plans.zones_with_bloom(v.zones(), windows, v.plants(), PLANT)
    return layer_plans.zone_tips(zones)


@query
def q07_simplified_zone_layer(v: Views) -> DataFrame:
    return layer_plans.simplified_zone_layer(v.outlines()).select("cell_id", "feature")


@query
def q07_valid_outlines(v: Views) -> DataFrame:
    return layers.simplify(v.bulged_outlines()).select(
        "cell_id", F.to_json("polys").alias("polys"), "bbox.*"
    )


@query
def g07_extents(v: Views) -> DataFrame:
    corners = F.size(F.flatten(F.flatten("polys"))).alias("corners")
    return layers.simplify(v.zones(), 0.02).select("cell_id", "station_id", "bbox.*", corners)


@query
def o06_first_features(v: Views) -> DataFrame:
    return layers.first_features(v.zones(), 5)


@query
def q08_zone_at_point(v: Views) -> DataFrame:
    return layer_plans.zone_at_point(v.points(), v.zones())


@query
def q08_stored_index(v: Views) -> DataFrame:
    """Two batches of points against one stored index of slanted zones with holes, which was built
    of a part of the layer first and brought up to the whole of it then."""
    path, layer, points = _scratch(v), v.slanted_zones(), v.exact_points()
    zone_index.store(layer.where("area_ha > 0"), path)
    zone_index.update(layer, path)
    west, east = points.where("lon < 22.5"), points.where("lon >= 22.5")
    found = [
        spatial.zones_at_points(batch, zone_index.opened(v.spark, path, batch))
        for batch in (west, east)
    ]
    return found[0].unionByName(found[1])


@query
def q19_locations_in_bbox(v: Views) -> DataFrame:
    return layer_plans.locations_in_bbox(v.locations(), *LOCATION_BBOX)


@query
def q19_pruned_bbox(v: Views) -> DataFrame:
    """The box on a table laid out by place: only what lies around it is read."""
    path = _scratch(v)
    space_layout.write_by_place(v.locations(), path, "lon", "lat", "lon", "lat")
    near = space_layout.read_around(v.spark, path, *LOCATION_BBOX)
    return layer_plans.locations_in_bbox(near, *LOCATION_BBOX)


@query
def q19_locations_by_id(v: Views) -> DataFrame:
    ids = v.table("orders").select(F.col("o_custkey").alias("id"))
    return layer_plans.locations_by_id(v.locations(), ids)


@query
def q19_location_features(v: Views) -> DataFrame:
    return sinks.location_features(v.locations()).select("id", "feature")


def _pins(v: Views) -> DataFrame:
    return layers.station_points(v.zones())


@query
def q20_nearest_station(v: Views) -> DataFrame:
    return spatial.nearest_stations(v.points(), _pins(v))


@query
def q20_resolved_clicks(v: Views) -> DataFrame:
    resolved = spatial.resolve_stations(v.clicks(), _pins(v), v.zones())
    return resolved.select("click_id", "station_id", "station_name")


@query
def q20_selected_stations(v: Views) -> DataFrame:
    """Stations that clicks select: resolved first, then without repeated places. A click that
    finds no station leaves the memory as it was."""
    resolved = cut_lineage(spatial.resolve_stations(v.clicks(), _pins(v), v.zones()))
    changed = spatial.session_changes(resolved)
    places = resolved.select(
        "click_id", "session", "ts", "station_id",
        V.click_key(F.col("lon"), F.col("lat")).alias("place"),
    )
    return places.join(changed, ["session", "ts", "place"], "left_semi").select(
        "click_id", "station_id", "place"
    )


@query
def w06_changed_clicks(v: Views) -> DataFrame:
    return spatial.session_changes(v.clicks())


@query
def w06_changed_in_parts(v: Views) -> DataFrame:
    """The same, by time parts of sessions."""
    return spatial.changed_clicks(v.clicks())


# scenes -----------------------------------------------------------------------------------


@query
def p10_scene_filter(v: Views) -> DataFrame:
    found = sc.search_scenes(v.scenes(), *SEARCH)
    return found.select("id", "cloud_cover", "href")


@query
def o05_scene_page(v: Views) -> DataFrame:
    """One page: the 500 clearest scenes that match, of these those with a link."""
    return sc.search_scenes(v.scenes(), *SEARCH, limit=500).select("id", "cloud_cover", "href")


@query
def q13_scene_search(v: Views) -> DataFrame:
    return sc.search_scenes(v.scenes(), *SEARCH).select("id", "cloud_cover", "datetime", "href")


@query
def p12_linked_scenes(v: Views) -> DataFrame:
    return sc.with_links(v.scenes()).select("id", "href")


@query
def p13_region_scenes(v: Views) -> DataFrame:
    return sc.in_region(sc.with_tile(v.scenes())).select("id", "tile")


@query
def f15_scene_names(v: Views) -> DataFrame:
    return sc.with_tile(v.scenes()).select(
        "id", "tile", S.short_tile(F.col("tile")).alias("short"),
        S.scene_platform(F.col("id"), F.col("platform")).alias("platform"),
        V.iso_day(F.col("datetime")).alias("day"),
    )


@query
def q14_best_scenes(v: Views) -> DataFrame:
    return scene_plans.best_scenes(v.scenes(), *SEARCH).select(
        "tile", "id", "nodata", "cloud", "href"
    )


@query
def a09_best_scene_of_all(v: Views) -> DataFrame:
    return sc.best_per_tile(sc.with_links(v.scenes())).select("tile", "id", "nodata", "cloud")


@query
def q15_coverage_report(v: Views) -> DataFrame:
    report = scene_plans.coverage_report(v.scenes(), *SEARCH)
    return report.select(
        "covered", "wanted", text_list("missing"), "avg_cloud", "max_cloud", "max_nodata",
        "dates", text_list("platforms"), text_list("partial"),
    )


def _best(v: Views) -> DataFrame:
    return scene_plans.best_scenes(v.scenes(), *SEARCH)


@query
def o08_tile_details(v: Views) -> DataFrame:
    return sc.tile_details(_best(v))


@query
def u05_missing_tiles(v: Views) -> DataFrame:
    return sc.missing_tiles(_best(v))


@query
def p17_partial_tiles(v: Views) -> DataFrame:
    return sc.partial_tiles(_best(v))


def _best_with_gaps(v: Views) -> DataFrame:
    return scene_plans.best_scenes(v.scenes_with_gaps(), *SEARCH)


@query
def u05_tiles_in_gaps(v: Views) -> DataFrame:
    return sc.missing_tiles(_best_with_gaps(v))


@query
def p17_tiles_with_gaps(v: Views) -> DataFrame:
    return sc.partial_tiles(_best_with_gaps(v))


@query
def q15_report_with_gaps(v: Views) -> DataFrame:
    report = scene_plans.coverage_report(v.scenes_with_gaps(), *SEARCH)
    return report.select(
        "covered", "wanted", text_list("missing"), "avg_cloud", "max_cloud", "max_nodata",
        "dates", text_list("platforms"), text_list("partial"),
    )


@query
def a15_region_mosaic_request(v: Views) -> DataFrame:
    links = sc.ordered_links(_best(v))
    return links.select(
        mosaics.set_digest(F.col("urls")).alias("digest"),
        F.size(mosaics.url_set(F.col("urls"))).alias("tile_count"),
        F.array_join("urls", "|").alias("urls"),
    )


@query
def q17_catalogue_search(v: Views) -> DataFrame:
    found = scene_plans.catalogue_search(v.scenes(), CATALOGUE_BBOX, "1997-01-01T00:00:00Z/..")
    return found.withColumn("asset_keys", F.array_join(F.array_sort("asset_keys"), ","))


@query
def q17_pruned_search(v: Views) -> DataFrame:
    """The catalogue search on a table laid out by place."""
    path = _scratch(v)
    space_layout.write_by_place(v.scenes(), path, "minx", "miny", "maxx", "maxy")
    near = space_layout.read_around(v.spark, path, *CATALOGUE_BBOX)
    found = scene_plans.catalogue_search(near, CATALOGUE_BBOX, "1997-01-01T00:00:00Z/..")
    return found.withColumn("asset_keys", F.array_join(F.array_sort("asset_keys"), ","))


@query
def q18_catalogue_counts(v: Views) -> DataFrame:
    return sc.items_per_collection(v.scenes())


@query
def k03_replaced_catalogue(v: Views) -> DataFrame:
    return sc.replace_collections(v.stored_items(), v.loaded_items())


@query
def k03_upserted_documents(v: Views) -> DataFrame:
    return sc.upsert_by_id(v.stored_documents(), v.loaded_documents())


@query
def v06_search_requests(v: Views) -> DataFrame:
    last = V.clamp_end(F.col("first"), F.col("last"))
    return v.searches().withColumn("last", last).select(
        "search_id", "last", V.day_span(F.col("first"), F.col("last")).alias("days"),
        V.search_fingerprint(F.col("first"), F.col("last"), F.col("max_cloud")).alias("print"),
    )


# mosaics ----------------------------------------------------------------------------------


@query
def q16_mosaic_manifests(v: Views) -> DataFrame:
    found = scene_plans.mosaic_manifests(v.request_urls(), v.footprints())
    tiles = F.transform(
        F.map_entries("tiles"),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")),
    )
    return found.select(
        "digest", "minzoom", "maxzoom", "quadkey_zoom",
        *[F.col("bounds")[i].alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))],
        F.col("center")[0].alias("center_lon"), F.col("center")[1].alias("center_lat"),
        F.size("tiles").alias("tile_keys"), F.array_join(F.array_sort(tiles), ";").alias("tiles"),
    )


@query
def s10_listed_urls(v: Views) -> DataFrame:
    return files.request_urls(v.url_lists())


@query
def a14_request_digests(v: Views) -> DataFrame:
    return mosaics.request_digests(mosaics.link_lists(v.request_urls()))


def _sets(v: Views) -> DataFrame:
    return mosaics.distinct_sets(mosaics.link_lists(v.request_urls()))


@query
def a12_quadkey_index(v: Views) -> DataFrame:
    placed = mosaics.placed_links(_sets(v), v.footprints())
    return mosaics.quadkey_index(placed).withColumn("urls", F.array_join("urls", "|"))


@query
def a13_mosaic_extents(v: Views) -> DataFrame:
    return mosaics.mosaic_extent(mosaics.placed_links(_sets(v), v.footprints()))


@query
def k05_new_manifests(v: Views) -> DataFrame:
    earlier = v.table("orders").where("o_orderdate < DATE'1998-01-01'").select(
        F.col("o_orderkey").alias("request_id")
    )
    stored = mosaics.distinct_sets(
        mosaics.link_lists(v.request_urls().join(earlier, "request_id", "left_semi"))
    )
    fresh = mosaics.new_manifests(_sets(v), stored)
    return fresh.select("digest", F.size("urls").alias("links"))


@query
def k05_incomplete_sets(v: Views) -> DataFrame:
    found = mosaics.incomplete_sets(_sets(v), v.footprints())
    return found.select("digest", "links", F.array_join("missing", "|").alias("missing"))


@query
def k05_sets_without_footprints(v: Views) -> DataFrame:
    found = mosaics.incomplete_sets(_sets(v), v.known_footprints())
    return found.select("digest", "links", F.array_join("missing", "|").alias("missing"))


@query
def a13_extents_of_complete_sets(v: Views) -> DataFrame:
    return mosaics.mosaic_extent(mosaics.placed_links(_sets(v), v.known_footprints()))


# quality ----------------------------------------------------------------------------------


@query
def v05_refused_requests(v: Views) -> DataFrame:
    return quality.refused_requests(v.url_lists())


@query
def v05_refused_years(v: Views) -> DataFrame:
    return quality.refused_years(v.year_requests())


@query
def v07_rejected_documents(v: Views) -> DataFrame:
    rejected = files.rejected_documents(v.landed_documents(), schemas.READING_PAGE)
    return rejected.select("l_orderkey", "l_linenumber", "document")


@query
def v01_duplicate_keys(v: Views) -> DataFrame:
    return quality.duplicate_keys(v.readings(), quality.KEYS["station_daily"])


@query
def v02_missing_values(v: Views) -> DataFrame:
    return quality.missing_values(v.catalogue_plants(), quality.REQUIRED["honey_plants"])


@query
def v03_rejected_features(v: Views) -> DataFrame:
    zones = v.zones().withColumn("station_id", V.text_or_null(F.col("station_id")))
    rejected = quality.rejected_rows(zones, quality.REQUIRED["zone_features"])
    return rejected.select("cell_id", text_list("lacking"))


@query
def v04_bloom_status_contract(v: Views) -> DataFrame:
    return quality.missing_values(q11_bloom_status(v), quality.REQUIRED["bloom_status"])


@query
def v04_contract_beside_the_write(v: Views) -> DataFrame:
    return quality.missing_as_written(
        q11_bloom_status(v), _scratch(v), quality.REQUIRED["bloom_status"]
    )


@query
def d07_unknown_totals(v: Views) -> DataFrame:
    return quality.unknown_totals(gd.gdd_table(v.daily(), v.plants()))


@query
def a16_months_without_precipitation(v: Views) -> DataFrame:
    daily = v.daily()
    rows = daily.join(v.precipitation(), ["station_id", "date"], "left").withColumn(
        "year", F.year("date")
    )
    return quality.all_missing(rows, ("station_id", "year"), "precip_mm")


@query
def f16_bloom_day_texts(v: Views) -> DataFrame:
    table = gd.gdd_table(v.daily(), v.plants())
    return table.groupBy(
        "plant_id", L.bloom_day_text(F.col("bloom_day")).alias("bloom_day"),
        L.phase_label(F.col("bloom_phase")).alias("phase"),
    ).agg(F.count("*").alias("rows"))
