"""DuckDB SQL for the registered queries, written from the definitions over the given tables."""

from __future__ import annotations

# Named subqueries; each may use the ones before it. --------------------------------------

VIEWS: dict[str, str] = {
    "readings": """
        SELECT 'S' || l_suppkey AS station_id, l_shipdate::DATE AS date,
               CASE WHEN l_quantity NOT IN (7, 8) THEN (l_quantity - 10) / 2.0::DOUBLE END
                   AS air_temperature
        FROM lineitem""",
    "readings_new": """
        SELECT 'U' || user_id AS station_id, ts::DATE AS date,
               value / 20.0::DOUBLE AS air_temperature
        FROM events""",
    "history": """
        SELECT 'U' || user_id AS station_id, ts::DATE AS date,
               min(value / 10.0::DOUBLE) AS t_min, max(value / 10.0::DOUBLE) AS t_max,
               max(value / 10.0::DOUBLE) AS t_mean, min(event_id) AS position
        FROM events GROUP BY user_id, ts::DATE, event_type""",
    "daily_new": """
        SELECT station_id, date, min(air_temperature) AS t_min, max(air_temperature) AS t_max,
               round_even((max(air_temperature) + min(air_temperature)) / 2.0::DOUBLE * 100, 0)
                   / 100 AS t_mean
        FROM readings_new GROUP BY ALL""",
    "daily": """
        SELECT station_id, date, min(air_temperature) AS t_min, max(air_temperature) AS t_max,
               round_even((max(air_temperature) + min(air_temperature)) / 2.0::DOUBLE * 100, 0)
                   / 100 AS t_mean
        FROM readings GROUP BY ALL""",
    "plants": """
        SELECT 'P' || r_regionkey AS id, r_name AS name_pl, lower(r_name) AS name_latin,
               3.0::DOUBLE + r_regionkey * 0.5::DOUBLE AS base_temp_c,
               100.0::DOUBLE + r_regionkey * 25.0::DOUBLE AS gdd_min,
               200.0::DOUBLE + r_regionkey * 50.0::DOUBLE AS gdd_max,
               CASE WHEN r_name <> 'EUROPE' THEN 'wiosna' END AS season
        FROM region""",
    "catalogue_plants": """
        SELECT 'plant' || p_partkey AS id, p_name AS name_pl, p_type AS name_latin,
               CASE WHEN p_size > 5 THEN p_size / 4.0::DOUBLE END AS base_temp_c,
               CASE WHEN p_size > 10 THEN floor(p_retailprice) / 8.0::DOUBLE END AS gdd_min,
               CASE WHEN p_size > 15 THEN floor(p_retailprice) / 4.0::DOUBLE END AS gdd_max,
               CASE WHEN p_size > 20 THEN p_brand END AS season
        FROM part""",
    "gdd_daily": """
        SELECT d.*, p.*, year(d.date)::INT AS year,
               round_even(CASE WHEN d.t_mean > p.base_temp_c THEN d.t_mean - p.base_temp_c
                               WHEN d.t_mean IS NOT NULL THEN 0::DOUBLE END * 100, 0) / 100
                   AS gdd_daily
        FROM daily d CROSS JOIN (SELECT id AS plant_id, base_temp_c, gdd_min, gdd_max
                                 FROM plants) p""",
    "gdd_total": """
        SELECT *, CASE WHEN gdd_daily IS NOT NULL THEN round_even(sum(gdd_daily) OVER (
                   PARTITION BY station_id, plant_id, year ORDER BY date
                   ROWS UNBOUNDED PRECEDING) * 100, 0) / 100 END AS gdd_cumulative
        FROM gdd_daily""",
    "gdd": """
        SELECT *,
               CASE WHEN gdd_cumulative > gdd_min AND gdd_cumulative <= gdd_max
                    THEN row_number() OVER (
                        PARTITION BY station_id, plant_id, year,
                                     gdd_cumulative > gdd_min AND gdd_cumulative <= gdd_max
                        ORDER BY date)
                    ELSE 0 END::INT AS bloom_day,
               CASE WHEN gdd_cumulative < gdd_min THEN 'before'
                    WHEN gdd_cumulative <= gdd_max THEN 'blooming' ELSE 'after' END AS bloom_phase
        FROM gdd_total""",
    "yearly": """
        SELECT y.station_id, y.year, y.plant_id, s.date AS bloom_start_date, e.date AS bloom_end_date
        FROM (SELECT DISTINCT station_id, year, plant_id FROM gdd) y
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY station_id, year, plant_id
                                                ORDER BY date) AS nth
                   FROM gdd WHERE gdd_cumulative >= gdd_min) s
          ON (s.station_id, s.year, s.plant_id, s.nth) = (y.station_id, y.year, y.plant_id, 1)
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY station_id, year, plant_id
                                                ORDER BY date) AS nth
                   FROM gdd WHERE gdd_cumulative > gdd_max) e
          ON (e.station_id, e.year, e.plant_id, e.nth) = (y.station_id, y.year, y.plant_id, 1)""",
    "windows": """
        SELECT station_id, plant_id, year, bloom_start_date, bloom_end_date
        FROM yearly WHERE bloom_start_date IS NOT NULL AND bloom_end_date IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY station_id, plant_id ORDER BY year DESC) = 1""",
    "catalogue_terms": """
        SELECT id AS plant_id, coalesce(base_temp_c, 5.0::DOUBLE) AS base,
               coalesce(gdd_min, 100.0::DOUBLE) AS gdd_min, coalesce(gdd_max, 200.0::DOUBLE) AS gdd_max
        FROM catalogue_plants""",
    "catalogue_totals": """
        SELECT station_id, year(date)::INT AS year, date, base,
               CASE WHEN t_mean IS NOT NULL THEN round_even(sum(
                   round_even(greatest(t_mean - base, 0::DOUBLE) * 100, 0) / 100) OVER (
                   PARTITION BY station_id, base, year(date) ORDER BY date
                   ROWS UNBOUNDED PRECEDING) * 100, 0) / 100 END AS total
        FROM (SELECT station_id, date, t_mean, base FROM daily, (SELECT DISTINCT base FROM catalogue_terms))""",
    "zones": """
        SELECT (s_suppkey * 2)::INT AS cell_id, 'S' || s_suppkey AS station_id,
               s_name AS station_name, s_acctbal AS area_ha, x, y,
               CASE WHEN s_nationkey <> 3 THEN y + 0.125::DOUBLE END AS latitude,
               x + 0.125::DOUBLE AS longitude,
               CASE WHEN s_nationkey > 12 THEN 'PME' END AS station_type
        FROM (SELECT *, 21.0::DOUBLE + 0.25::DOUBLE * (s_suppkey % 10)
                        + 2.5::DOUBLE * (s_suppkey // 100 % 16) AS x,
                     50.0::DOUBLE + 0.25::DOUBLE * (s_suppkey // 10 % 10)
                        + 2.5::DOUBLE * (s_suppkey // 1600 % 8) AS y FROM supplier)
        UNION ALL
        SELECT (s_suppkey * 2 + 1)::INT, 'S' || s_suppkey, s_name || ' B', -s_acctbal,
               x + 0.125::DOUBLE, y + 0.125::DOUBLE, y + 0.25::DOUBLE, x + 0.25::DOUBLE, 'IUNG'
        FROM (SELECT *, 21.0::DOUBLE + 0.25::DOUBLE * (s_suppkey % 10)
                        + 2.5::DOUBLE * (s_suppkey // 100 % 16) AS x,
                     50.0::DOUBLE + 0.25::DOUBLE * (s_suppkey // 10 % 10)
                        + 2.5::DOUBLE * (s_suppkey // 1600 % 8) AS y FROM supplier)
        WHERE s_acctbal < 0
        UNION ALL
        SELECT (-1 - n_nationkey)::INT,
               CASE WHEN n_regionkey <> 0 THEN 'N' || n_nationkey ELSE '' END, n_name, NULL,
               10.0::DOUBLE + 0.5::DOUBLE * n_nationkey, 40.0::DOUBLE, 40.125::DOUBLE,
               10.125::DOUBLE + 0.5::DOUBLE * n_nationkey, NULL
        FROM nation""",
    "zone_windows": """
        SELECT z.*, w.bloom_start_date, w.bloom_end_date,
               CASE WHEN w.station_id IS NULL THEN 'ASIA: brak danych'
                    ELSE 'ASIA: od ' || w.bloom_start_date || ' do ' || w.bloom_end_date
               END AS bloom_tooltip
        FROM zones z LEFT JOIN (SELECT * FROM windows WHERE plant_id = 'P2') w
          ON w.station_id = z.station_id""",
    "first_zone": """
        SELECT DISTINCT ON (station_id) station_id, station_name
        FROM zones ORDER BY station_id, cell_id""",
    "pins": """
        SELECT DISTINCT ON (station_id) station_id, station_name, station_type,
               longitude AS lon, latitude AS lat, cell_id AS position
        FROM zones WHERE station_id <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL
        ORDER BY station_id, cell_id""",
    "points": """
        SELECT c_custkey AS point_id,
               21.0::DOUBLE + (c_custkey * 37 % 1000) / 400.0::DOUBLE
                   + 2.5::DOUBLE * (c_custkey // 1500 % 16) AS lon,
               50.0::DOUBLE + (c_custkey * 53 % 1000) / 400.0::DOUBLE
                   + 2.5::DOUBLE * (c_custkey // 24000 % 8) AS lat
        FROM customer""",
    "locations": """
        SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, lon, lat
        FROM customer JOIN points ON point_id = c_custkey""",
    "clicks": """
        SELECT event_id AS click_id, user_id AS session, ts,
               21.0::DOUBLE + floor(value / 10) / 64.0::DOUBLE AS lon,
               50.0::DOUBLE + (user_id % 50) / 20.0::DOUBLE AS lat,
               CASE WHEN event_type = 'purchase' THEN 'S' || user_id END AS station_id
        FROM events""",
    "resolved": """
        SELECT c.click_id,
               coalesce(c.station_id, n.station_id, z.station_id) AS station_id,
               CASE WHEN c.station_id IS NOT NULL THEN c.station_id
                    WHEN n.station_id IS NOT NULL THEN n.station_name
                    ELSE z.station_name END AS station_name
        FROM clicks c
        LEFT JOIN (SELECT DISTINCT ON (click_id) click_id, s.station_id, station_name
                   FROM clicks k JOIN pins s
                     ON s.lon BETWEEN k.lon - 0.04 AND k.lon + 0.04
                    AND s.lat BETWEEN k.lat - 0.04 AND k.lat + 0.04
                   WHERE (s.lon - k.lon) * (s.lon - k.lon) + (s.lat - k.lat) * (s.lat - k.lat)
                         < 0.03::DOUBLE * 0.03::DOUBLE
                   ORDER BY click_id, (s.lon - k.lon) * (s.lon - k.lon)
                            + (s.lat - k.lat) * (s.lat - k.lat), position) n
          ON n.click_id = c.click_id
        LEFT JOIN (SELECT DISTINCT ON (click_id) click_id, s.station_id, station_name
                   FROM clicks k JOIN zones s
                     ON k.lon > x AND k.lon < x + 0.25::DOUBLE
                    AND k.lat > y AND k.lat < y + 0.25::DOUBLE
                   ORDER BY click_id, cell_id) z
          ON z.click_id = c.click_id
        WHERE coalesce(c.station_id, n.station_id, z.station_id) IS NOT NULL""",
    "precipitation": """
        SELECT 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS station_id,
               o_orderdate::DATE AS date, sum(floor(o_totalprice) % 40)::DOUBLE AS precip_mm
        FROM orders GROUP BY 1, 2""",
    "rain_monthly": """
        SELECT station_id, year(date)::INT AS year, month(date)::INT AS month,
               sum(precip_mm) AS precip_mm
        FROM precipitation GROUP BY ALL""",
    "rain_annual": """
        SELECT station_id, year(date)::INT AS year, sum(precip_mm) AS precip_annual
        FROM precipitation GROUP BY ALL""",
    "requests": """
        SELECT DISTINCT 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS station_id,
               year(o_orderdate)::INT AS year, 'P' || (o_orderkey % 6) AS plant_id
        FROM orders""",
    "statuses": """
        SELECT g.station_id, z.station_name, g.date, g.plant_id, p.name_pl AS plant_name,
               g.gdd_cumulative, g.bloom_day, g.bloom_phase,
               CASE g.bloom_phase WHEN 'before' THEN 'Przed kwitnieniem'
                    WHEN 'blooming' THEN 'Kwitnie' ELSE 'Po kwitnieniu' END AS bloom_phase_label,
               p.gdd_min, p.gdd_max,
               CASE WHEN g.bloom_day > 0 THEN g.bloom_day::VARCHAR ELSE '-' END AS bloom_day_text
        FROM (SELECT DISTINCT 'S' || l_suppkey AS station_id, l_shipdate::DATE AS date,
                     'P' || (l_linenumber % 6) AS plant_id FROM lineitem) r
        JOIN gdd g USING (station_id, date, plant_id)
        JOIN plants p ON p.id = g.plant_id
        LEFT JOIN first_zone z ON z.station_id = g.station_id""",
    "asked": """
        SELECT d.station_id, z.station_name, r.year, r.plant_id, d.date, d.t_min, d.t_max,
               d.t_mean, g.gdd_daily, g.gdd_cumulative
        FROM requests r JOIN first_zone z USING (station_id)
        JOIN daily d ON d.station_id = r.station_id AND year(d.date) = r.year
        LEFT JOIN gdd g ON g.station_id = d.station_id AND g.date = d.date
                       AND g.plant_id = r.plant_id""",
    "asked_months": """
        SELECT a.station_id, a.station_name, a.year, a.plant_id, month(a.date)::INT AS month,
               avg(t_mean) AS t_mean, sum(gdd_daily) AS gdd_monthly,
               max(gdd_cumulative) AS gdd_cumulative
        FROM asked a GROUP BY ALL""",
    "asked_years": """
        SELECT station_id, year, plant_id, count(*)::BIGINT AS day_count,
               avg(t_mean) AS t_mean_annual, max(gdd_cumulative) AS gdd_max
        FROM asked GROUP BY ALL""",
    "scenes": """
        SELECT CASE WHEN pr = '1-URGENT' THEN 'scene' || k
                    ELSE 'S2' || CASE st WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END || '_'
                         || code || '_' || strftime(taken, '%Y%m%d') || '_' || k || '_L2A' END AS id,
               CASE WHEN st = 'P' AND pr = '2-HIGH' THEN 'other' ELSE 'sentinel-2-l2a' END
                   AS collection,
               taken AS acquired_at, strftime(taken, '%Y-%m-%d') || 'T09:40:31Z' AS datetime,
               20.9::DOUBLE + 0.2::DOUBLE * t AS minx, 49.9::DOUBLE + 0.125::DOUBLE * t AS miny,
               22.4::DOUBLE + 0.2::DOUBLE * t AS maxx, 50.9::DOUBLE + 0.125::DOUBLE * t AS maxy,
               CASE WHEN pr = '1-URGENT' OR st <> 'F' THEN 'MGRS-' || code END AS grid_code,
               CASE WHEN pr <> '5-LOW' OR st <> 'O' THEN (price % 101)::DOUBLE END AS cloud_cover,
               nullif(k % 7, 0)::DOUBLE AS nodata_pct,
               CASE st WHEN 'F' THEN 'sentinel-2a' WHEN 'O' THEN 'Sentinel-2B' END AS platform,
               CASE WHEN pr <> '4-NOT SPECIFIED'
                    THEN 'https://images.example/' || k || '.tif' END AS href
        FROM (SELECT o_orderkey AS k, o_custkey % 20 AS t,
                     ['34UEA','34UEB','34UEC','34UED','34UFA','34UFB','34UFC','34UFD','34UGA',
                      '34UGB','34UGC','34UGD','35ULR','35ULS','35ULT','35ULU','35UKR','35UKS',
                      '33UVR','36UWV'][o_custkey % 20 + 1] AS code,
                     o_orderdate AS taken, o_orderstatus AS st, o_orderpriority AS pr,
                     floor(o_totalprice) AS price
              FROM orders)""",
    "tiled": """
        SELECT *, CASE raw WHEN 'MGRS-35UKR' THEN 'MGRS-35ULR' WHEN 'MGRS-35UKS' THEN 'MGRS-35ULS'
                  ELSE raw END AS tile,
               CASE WHEN id[1:2] = 'S2' AND length(split_part(id, '_', 1)) = 3
                    THEN split_part(id, '_', 1)
                    WHEN lower(platform) LIKE '%sentinel-2a%' THEN 'S2A'
                    WHEN lower(platform) LIKE '%sentinel-2b%' THEN 'S2B'
                    WHEN lower(platform) LIKE '%sentinel-2c%' THEN 'S2C' ELSE '?' END AS short_platform
        FROM (SELECT *, CASE WHEN grid_code IS NOT NULL THEN grid_code
                             WHEN length(split_part(id, '_', 2)) = 5
                             THEN 'MGRS-' || split_part(id, '_', 2) ELSE id END AS raw
              FROM scenes)""",
    "region_tiles": """
        SELECT unnest(['MGRS-34UEA','MGRS-34UEB','MGRS-34UEC','MGRS-34UED','MGRS-34UFA',
            'MGRS-34UFB','MGRS-34UFC','MGRS-34UFD','MGRS-34UGA','MGRS-34UGB','MGRS-34UGC',
            'MGRS-34UGD','MGRS-35ULR','MGRS-35ULS','MGRS-35ULT','MGRS-35ULU']) AS tile""",
    "matching": """
        SELECT * FROM tiled
        WHERE collection = 'sentinel-2-l2a' AND cloud_cover < 60
          AND minx <= 24.2 AND maxx >= 21.5 AND miny <= 52.3 AND maxy >= 50.2
          AND acquired_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31 23:59:59'""",
    "best": """
        SELECT DISTINCT ON (tile) *, coalesce(nodata_pct, 0) AS nodata,
               coalesce(cloud_cover, 0) AS cloud
        FROM matching WHERE href IS NOT NULL AND tile IN (SELECT tile FROM region_tiles)
        ORDER BY tile, nodata, cloud, cloud_cover, id""",
    "gap_best": """
        SELECT DISTINCT ON (tile) * REPLACE (gap_pct AS nodata_pct), coalesce(gap_pct, 0) AS nodata,
               coalesce(cloud_cover, 0) AS cloud
        FROM (SELECT *, (nodata_pct + 2) * 2 AS gap_pct FROM matching)
        WHERE href IS NOT NULL AND tile IN (SELECT tile FROM region_tiles)
          AND tile NOT IN ('MGRS-34UEB', 'MGRS-35ULT')
        ORDER BY tile, nodata, cloud, cloud_cover, id""",
    "request_sets": """
        SELECT l_orderkey AS request_id,
               list_sort(list_distinct(list('https://images.example/' || l_suppkey || '.tif')))
                   AS urls
        FROM lineitem GROUP BY l_orderkey""",
    "request_digests": """
        SELECT request_id, urls, sha256(array_to_string(urls, '|'))[1:16] AS digest
        FROM request_sets""",
    "link_sets": "SELECT DISTINCT digest, urls FROM request_digests",
    "unplaced": """
        SELECT digest, url FROM (SELECT digest, unnest(urls) AS url FROM link_sets)
        JOIN supplier ON url = 'https://images.example/' || s_suppkey || '.tif'
        WHERE s_acctbal <= -850""",
    "placed": """
        SELECT digest, url, 14.0::DOUBLE + 0.37::DOUBLE * (s_suppkey % 40) AS minx,
               45.0::DOUBLE + 0.41::DOUBLE * (s_suppkey // 40 % 40) AS miny,
               15.5::DOUBLE + 0.37::DOUBLE * (s_suppkey % 40) AS maxx,
               46.0::DOUBLE + 0.41::DOUBLE * (s_suppkey // 40 % 40) AS maxy
        FROM (SELECT digest, unnest(urls) AS url FROM link_sets
              WHERE digest NOT IN (SELECT digest FROM unplaced))
        JOIN supplier ON url = 'https://images.example/' || s_suppkey || '.tif'""",
    "tile_ranges": """
        SELECT digest, url,
               floor((minx + 180.0::DOUBLE) / 360.0::DOUBLE * 128)::INT AS x1,
               (ceil((maxx + 180.0::DOUBLE) / 360.0::DOUBLE * 128) - 1)::INT AS x2,
               floor((0.5::DOUBLE - ln((1 + sin(radians(maxy))) / (1 - sin(radians(maxy))))
                     / (4 * pi())) * 128)::INT AS y1,
               (ceil((0.5::DOUBLE - ln((1 + sin(radians(miny))) / (1 - sin(radians(miny))))
                     / (4 * pi())) * 128) - 1)::INT AS y2
        FROM placed""",
    "tile_links": """
        SELECT DISTINCT digest, url, array_to_string(list_transform(
                   [6, 5, 4, 3, 2, 1, 0],
                   lambda b: ((x >> b) & 1) + 2 * ((y >> b) & 1)), '') AS quadkey
        FROM (SELECT digest, url, x, unnest(range(y1, y2 + 1))::INT AS y
              FROM (SELECT *, unnest(range(x1, x2 + 1))::INT AS x FROM tile_ranges))""",
    "quadkeys": """
        SELECT digest, quadkey, string_agg(url, '|' ORDER BY url) AS urls
        FROM tile_links GROUP BY ALL""",
    "extents": """
        SELECT digest, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy
        FROM placed GROUP BY ALL""",
}

ASKED_HEADER = """
    m.station_id, m.station_name, m.year, m.plant_id"""

# Final statements over the named subqueries. ----------------------------------------------

FINAL: dict[str, str] = {
    "s01_landed_readings": """
        SELECT 'S' || l_suppkey AS station_id, l_shipdate::DATE AS date,
               l_quantity AS air_temperature
        FROM lineitem WHERE l_returnflag <> 'N'
        UNION ALL
        SELECT 'S' || l_suppkey, l_shipdate::DATE, NULL FROM lineitem WHERE l_returnflag <> 'N'""",
    "s02_extraction_plan": """
        SELECT station_id, s AS chunk_start, e AS chunk_end,
               s || 'T00:00:00Z' AS after, e || 'T23:59:59Z' AS before
        FROM (SELECT DISTINCT station_id FROM readings),
             (SELECT (DATE '2024-01-01' + k * 90)::DATE AS s,
                     least(DATE '2024-01-01' + k * 90 + 89, DATE '2025-12-31')::DATE AS e
              FROM (SELECT unnest(range(0, 9))::INT AS k))""",
    "s03_zone_files": """
        SELECT 0 AS position, s_suppkey::INT AS cell_id, 'S' || s_suppkey AS station_id,
               s_name AS station_name, s_acctbal AS area_ha, 50.25::DOUBLE AS latitude,
               20.25::DOUBLE AS longitude, 'PME' AS station_type, 'MultiPolygon' AS geom_type,
               2 AS parts, 20.0::DOUBLE AS minx, 50.0::DOUBLE AS miny, 30.5::DOUBLE AS maxx,
               50.5::DOUBLE AS maxy
        FROM supplier
        UNION ALL
        SELECT 1, (s_suppkey + 1)::INT, 'S' || s_suppkey, s_name, NULL, NULL, NULL, NULL,
               'Polygon', 1, 30.0, 50.0, 30.5, 50.5
        FROM supplier""",
    "s03_large_zone_files": """
        SELECT s_suppkey::INT AS cell_id, 'S' || s_suppkey AS station_id, s_name AS station_name,
               s_acctbal AS area_ha, 50.25::DOUBLE AS latitude, 20.25::DOUBLE AS longitude,
               'PME' AS station_type, 'MultiPolygon' AS geom_type, 2 AS parts, 20.0::DOUBLE AS minx,
               50.0::DOUBLE AS miny, 30.5::DOUBLE AS maxx, 50.5::DOUBLE AS maxy
        FROM supplier
        UNION ALL
        SELECT (s_suppkey + 1)::INT, 'S' || s_suppkey, s_name, NULL, NULL, NULL, NULL, 'Polygon', 1,
               30.0, 50.0, 30.5, 50.5
        FROM supplier""",
    "s04_boundary_files": """
        SELECT 4 AS points, c_custkey::DOUBLE AS first_lon, 1.0::DOUBLE AS first_lat
        FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""",
    "s05_gdd_csv": """
        SELECT station_id, plant_id, date, gdd_daily, gdd_cumulative, bloom_day, bloom_phase
        FROM gdd""",
    "k01_history_csv": "SELECT station_id, date, t_min, t_max, t_mean FROM daily",
    "k02_refreshed_daily_table": """
        SELECT station_id, date, t_min, t_max, t_mean, year(date)::INT AS year FROM daily""",
    "k02_merged_twice": """
        SELECT DISTINCT ON (station_id, date) station_id, date, t_min, t_max, t_mean
        FROM (SELECT station_id, date, t_min, t_max, t_mean, 0 AS fresh, position FROM history
              UNION ALL
              SELECT station_id, date, t_min, t_max, t_mean, 1, 0 FROM daily_new)
        ORDER BY station_id, date, fresh DESC, position DESC""",
    "u01_incremental_refresh": """
        SELECT station_id, plant_id, date, t_min, t_max, t_mean, gdd_daily, gdd_cumulative,
               bloom_day, bloom_phase
        FROM gdd""",
    "k03_stored_scenes": """
        SELECT id, collection, cloud_cover, href FROM scenes
        WHERE collection <> 'other' OR cloud_cover < 50""",
    "k04_feature_document": """
        SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat
               || ']},"properties":{"station_id":"' || station_id || '","station_name":"'
               || station_name || '","station_type":'
               || coalesce('"' || station_type || '"', 'null') || '}}' AS feature
        FROM pins""",
    "k04_tile_documents": """
        SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat
               || ']},"properties":{"station_id":"' || station_id || '","station_name":"'
               || station_name || '","station_type":'
               || coalesce('"' || station_type || '"', 'null') || '}}' AS feature
        FROM pins""",
    "s07_collection_files": """
        SELECT 'c' || n_nationkey AS id, n_name AS title, n_regionkey::DOUBLE AS minx
        FROM nation""",
    "s07_customer_collections": """
        SELECT 'c' || c_custkey AS id, c_name AS title, c_nationkey::DOUBLE AS minx FROM customer""",
    "s06_plant_files": """
        SELECT 'p' || p_partkey AS id, p_name AS name_pl, p_type AS name_latin,
               p_size::DOUBLE AS base_temp_c, 100.0::DOUBLE AS gdd_min,
               floor(p_retailprice)::DOUBLE AS gdd_max, NULL::VARCHAR AS season
        FROM part""",
    "s07_item_files": """
        SELECT 'item' || o_orderkey AS id, 'c-' || o_orderstatus AS collection,
               o_orderdate::DATE + INTERVAL 10 HOUR AS acquired_at,
               strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' AS datetime,
               21.0::DOUBLE AS minx, 50.0::DOUBLE AS miny, 22.0::DOUBLE AS maxx,
               51.0::DOUBLE AS maxy, 'MGRS-34UEB' AS grid_code,
               (floor(o_totalprice) % 100)::DOUBLE AS cloud_cover, NULL::DOUBLE AS nodata_pct,
               NULL::VARCHAR AS platform, 'h' || o_orderkey AS href, 2 AS roles
        FROM orders""",
    "s08_precipitation_files": """
        SELECT station_id, date, max(precip_mm) AS precip_mm FROM (
            SELECT 'ST_' || o_custkey AS station_id, o_orderdate::DATE AS date,
                   (floor(o_totalprice) % 40 + 0.5)::DOUBLE AS precip_mm
            FROM orders
            UNION ALL
            SELECT 'ST_' || o_custkey, make_date(year(o_orderdate)::INT, 12, 31), 0.25 FROM orders)
        GROUP BY ALL""",
    "q01_daily_temperatures": """
        SELECT DISTINCT ON (station_id, date) station_id, date, t_min, t_max, t_mean
        FROM (SELECT station_id, date, t_min, t_max, t_mean, 0 AS fresh, position FROM history
              UNION ALL
              SELECT station_id, date, t_min, t_max, t_mean, 1, 0 FROM daily_new)
        ORDER BY station_id, date, fresh DESC, position DESC""",
    "a01_daily_extremes": "SELECT * FROM daily_new",
    "a02_history_profile": """
        SELECT count(DISTINCT station_id) AS stations, count(*) AS days,
               min(date) AS first_day, max(date) AS last_day
        FROM daily""",
    "a08_station_ids": "SELECT DISTINCT station_id FROM readings ORDER BY station_id",
    "q02_bloom_table": """
        SELECT station_id, plant_id, date, t_min, t_max, t_mean, gdd_daily, gdd_cumulative,
               bloom_day, bloom_phase
        FROM gdd""",
    "a03_yearly_windows": "SELECT * FROM yearly",
    "a03_planted_windows": """
        SELECT station_id, year, plant_id, min(date) FILTER (total >= gdd_min) AS bloom_start_date,
               min(date) FILTER (total > gdd_max) AS bloom_end_date
        FROM (SELECT DISTINCT 'S' || l_suppkey AS station_id, 'plant' || l_partkey AS plant_id
              FROM lineitem)
        JOIN catalogue_terms USING (plant_id) JOIN catalogue_totals USING (station_id, base)
        GROUP BY ALL""",
    "w03_catalogue_windows": """
        SELECT station_id, plant_id, year, bloom_start_date, bloom_end_date
        FROM (SELECT station_id, year, plant_id, min(date) FILTER (total >= gdd_min) AS bloom_start_date,
                     min(date) FILTER (total > gdd_max) AS bloom_end_date
              FROM catalogue_terms JOIN catalogue_totals USING (base) GROUP BY ALL)
        WHERE bloom_start_date IS NOT NULL AND bloom_end_date IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY station_id, plant_id ORDER BY year DESC) = 1""",
    "w03_bloom_windows": "SELECT * FROM windows",
    "q03_zone_bloom_windows": """
        SELECT cell_id, station_id, bloom_start_date, bloom_end_date, bloom_tooltip
        FROM zone_windows""",
    "q03_stored_windows": "SELECT * FROM windows",
    "j01_planted_stations": """
        SELECT station_id, plant_id, date, gdd_cumulative, bloom_phase
        FROM gdd JOIN (SELECT DISTINCT 'S' || l_suppkey AS station_id,
                              'P' || (l_linenumber % 6) AS plant_id FROM lineitem)
        USING (station_id, plant_id)""",
    "p05_days_of_year": "SELECT * FROM daily WHERE year(date) = 2000",
    "p08_bloom_rows": """
        SELECT station_id, plant_id, date, t_mean, gdd_cumulative, bloom_day
        FROM gdd WHERE bloom_day > 0""",
    "q22_animation_frames": """
        SELECT station_id, plant_id, date, gdd_cumulative,
               CASE WHEN gdd_cumulative < gdd_min THEN '1. Przed kwitnieniem (Uśpienie)'
                    WHEN gdd_cumulative <= gdd_max THEN '2. Kwitnienie'
                    ELSE '3. Po kwitnieniu (Przekwitanie)' END AS phase_label,
               date::VARCHAR AS frame_date
        FROM gdd""",
    "o04_bloom_preview": """
        SELECT station_id, plant_id, date, t_mean, gdd_cumulative, bloom_day FROM gdd
        WHERE bloom_day > 0 ORDER BY station_id, plant_id, date LIMIT 20""",
    "u06_threshold_rows": """
        SELECT id AS plant_id, 'Próg kwitnienia od' AS label, gdd_min AS y
        FROM catalogue_plants WHERE gdd_min IS NOT NULL
        UNION ALL
        SELECT id, 'Próg kwitnienia do', gdd_max FROM catalogue_plants
        WHERE gdd_max IS NOT NULL""",
    "q04_station_list": """
        SELECT DISTINCT station_id, station_name, area_ha FROM zones""",
    "f32_station_choices": """
        SELECT station_id, station_name || ' (' || station_id || ')' AS label
        FROM (SELECT DISTINCT station_id, station_name, area_ha FROM zones)""",
    "q23_station_search": """
        SELECT station_id, CASE WHEN station_name <> '' THEN station_name ELSE station_id END
                   AS label
        FROM (SELECT DISTINCT ON (station_id) station_id, station_name FROM zones
              WHERE station_id <> '' ORDER BY station_id, station_name DESC, area_ha DESC)
        WHERE contains(lower(station_id), '#00000001')
           OR contains(lower(station_name), '#00000001')""",
    "u03_station_by_id": """
        SELECT DISTINCT ON (station_id) station_id, station_name, area_ha FROM zones
        WHERE station_id <> '' ORDER BY station_id, station_name DESC, area_ha DESC""",
    "q12_plant_dictionary": "SELECT * FROM catalogue_plants",
    "f29_plant_choices": """
        SELECT id AS plant_id, name_pl || ' (' || name_latin || ')' AS label,
               coalesce(season, '—') AS season, coalesce(base_temp_c, 5) AS base_temp_c,
               coalesce(gdd_min, 100) AS gdd_min, coalesce(gdd_max, 200) AS gdd_max
        FROM catalogue_plants""",
    "a06_precipitation": """
        SELECT station_id, year, month, precip_mm, precip_annual
        FROM rain_monthly JOIN rain_annual USING (station_id, year)""",
    "q09_monthly_summary": f"""
        SELECT {ASKED_HEADER}, y.day_count, y.t_mean_annual, y.gdd_max, ra.precip_annual,
               m.month, m.t_mean, m.gdd_monthly, m.gdd_cumulative, rm.precip_mm,
               printf('%02d. ', m.month) || ['Sty', 'Lut', 'Mar', 'Kwi', 'Maj', 'Cze', 'Lip',
                   'Sie', 'Wrz', 'Paź', 'Lis', 'Gru'][m.month] AS month_label
        FROM asked_months m JOIN asked_years y USING (station_id, year, plant_id)
        LEFT JOIN rain_monthly rm ON rm.station_id = m.station_id AND rm.year = m.year
                                 AND rm.month = m.month
        LEFT JOIN rain_annual ra ON ra.station_id = m.station_id AND ra.year = m.year""",
    "q21_annual_status": """
        SELECT y.station_id, y.year, y.plant_id, y.gdd_max, p.gdd_min AS threshold_min,
               p.gdd_max AS threshold_max,
               CASE WHEN y.gdd_max IS NULL THEN '—'
                    WHEN y.gdd_max < p.gdd_min THEN 'Przed kwitnieniem'
                    WHEN y.gdd_max <= p.gdd_max THEN 'W okresie kwitnienia'
                    ELSE 'Po kwitnieniu' END AS status
        FROM asked_years y JOIN plants p ON p.id = y.plant_id""",
    "w04_gdd_chart": """
        SELECT m.station_id, m.year, m.plant_id, m.month, m.gdd_monthly,
               CASE WHEN count(gdd_cumulative) OVER y = 0
                    THEN sum(coalesce(gdd_monthly, 0)) OVER (y ORDER BY month)
                    ELSE gdd_cumulative END AS gdd_cumulative,
               printf('%02d. ', m.month) || ['Sty', 'Lut', 'Mar', 'Kwi', 'Maj', 'Cze', 'Lip',
                   'Sie', 'Wrz', 'Paź', 'Lis', 'Gru'][m.month] AS month_label
        FROM asked_months m WINDOW y AS (PARTITION BY station_id, year, plant_id)""",
    "q10_daily_series": """
        SELECT a.station_id, a.station_name, a.year, a.plant_id, a.date, a.t_min, a.t_max,
               a.t_mean, a.gdd_daily, a.gdd_cumulative, p.precip_mm
        FROM asked a LEFT JOIN precipitation p USING (station_id, date)""",
    "j01_daily_with_stored_totals": """
        SELECT a.station_id, a.station_name, a.year, a.plant_id, a.date, a.t_min, a.t_max,
               a.t_mean, a.gdd_daily, a.gdd_cumulative, p.precip_mm
        FROM asked a LEFT JOIN precipitation p USING (station_id, date)""",
    "k06_series_documents": """
        SELECT station_id, station_name, year, plant_id, count(*)::INT AS days,
               min(date) AS first_day, max(date) AS last_day, (list(t_mean ORDER BY date))[-1] AS last_t_mean,
               sum(coalesce(gdd_daily, 0)) AS gdd_sum
        FROM asked GROUP BY ALL""",
    "q11_bloom_status": "SELECT * FROM statuses",
    "q05_station_points": """
        SELECT station_id, station_name, station_type, lon, lat,
               '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat
               || ']},"properties":{"station_id":"' || station_id || '","station_name":"'
               || station_name || '","station_type":'
               || coalesce('"' || station_type || '"', 'null') || '}}' AS feature
        FROM pins""",
    "q06_zone_layer": """
        SELECT cell_id, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['
               || x || ',' || y || '],[' || x + 0.25::DOUBLE || ',' || y || '],['
               || x + 0.25::DOUBLE || ',' || y + 0.25::DOUBLE || '],[' || x || ','
               || y + 0.25::DOUBLE || '],[' || x || ',' || y
               || ']]]},"properties":{"cell_id":' || cell_id
               || ',"station_id":"' || station_id || '","station_name":"' || station_name
               || '","area_ha":' || coalesce(area_ha::VARCHAR, 'null')
               || ',"bloom_start_date":' || coalesce('"' || bloom_start_date || '"', 'null')
               || ',"bloom_end_date":' || coalesce('"' || bloom_end_date || '"', 'null')
               || ',"bloom_tooltip":"' || bloom_tooltip || '"}}' AS feature
        FROM zone_windows""",
    "p16_zone_tips": """
        SELECT cell_id,
               CASE WHEN bloom_start_date IS NOT NULL AND bloom_end_date IS NOT NULL
                    THEN station_name || ' · ' || bloom_start_date || ' – ' || bloom_end_date
                    ELSE bloom_tooltip END AS tip,
               station_name || CASE WHEN bloom_start_date IS NOT NULL
                    THEN ' · ' || bloom_start_date || ' – ' || bloom_end_date ELSE '' END AS hover,
               CASE WHEN bloom_start_date IS NOT NULL
                    THEN 'Kwitnienie: ' || bloom_start_date || ' – ' || bloom_end_date
                    ELSE bloom_tooltip END AS popup
        FROM zone_windows""",
    "q07_simplified_zone_layer": """
        SELECT s_suppkey::INT AS cell_id,
               '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['
               || x || ',' || y || '],[' || x + 0.25::DOUBLE || ',' || y || '],['
               || x + 0.25::DOUBLE || ',' || y + 0.25::DOUBLE || '],[' || x || ','
               || y + 0.25::DOUBLE || '],[' || x || ',' || y || ']],[['
               || x + 0.125::DOUBLE || ',' || y + 0.0625::DOUBLE || '],['
               || x + 0.1875::DOUBLE || ',' || y + 0.125::DOUBLE || '],['
               || x + 0.125::DOUBLE || ',' || y + 0.1875::DOUBLE || '],['
               || x + 0.0625::DOUBLE || ',' || y + 0.125::DOUBLE || '],['
               || x + 0.125::DOUBLE || ',' || y + 0.0625::DOUBLE
               || ']]]},"properties":{"cell_id":' || s_suppkey
               || ',"station_id":"S' || s_suppkey || '","station_name":"' || s_name
               || '","area_ha":' || s_acctbal
               || ',"bloom_start_date":null,"bloom_end_date":null,"bloom_tooltip":null}}' AS feature
        FROM (SELECT *, 21.0::DOUBLE + 0.25::DOUBLE * (s_suppkey % 10) AS x,
                     50.0::DOUBLE + 0.25::DOUBLE * (s_suppkey // 10) AS y FROM supplier)""",
    "q07_valid_outlines": """
        SELECT s_suppkey::INT AS cell_id, '[[[[' || x || ',' || y || '],[' || x + 80 / 256.0::DOUBLE || ',' || y
               || '],[' || x + 80 / 256.0::DOUBLE || ',' || y + 40 / 256.0::DOUBLE || '],['
               || x + 44 / 256.0::DOUBLE || ',' || y + 44 / 256.0::DOUBLE || '],[' || x || ','
               || y + 40 / 256.0::DOUBLE || '],[' || x || ',' || y || ']],[['
               || x + 38 / 256.0::DOUBLE || ',' || y + 41 / 256.0::DOUBLE || '],['
               || x + 42 / 256.0::DOUBLE || ',' || y + 41 / 256.0::DOUBLE || '],['
               || x + 42 / 256.0::DOUBLE || ',' || y + 43 / 256.0::DOUBLE || '],['
               || x + 38 / 256.0::DOUBLE || ',' || y + 43 / 256.0::DOUBLE || '],['
               || x + 38 / 256.0::DOUBLE || ',' || y + 41 / 256.0::DOUBLE || ']]]]' AS polys,
               x AS minx, y AS miny, x + 80 / 256.0::DOUBLE AS maxx, y + 44 / 256.0::DOUBLE AS maxy
        FROM (SELECT *, 21.0::DOUBLE + 0.5::DOUBLE * (s_suppkey % 10) AS x,
                     50.0::DOUBLE + 0.25::DOUBLE * (s_suppkey // 10) AS y FROM supplier)""",
    "g07_extents": """
        SELECT cell_id, station_id, x AS minx, y AS miny, x + 0.25::DOUBLE AS maxx,
               y + 0.25::DOUBLE AS maxy, 5 AS corners
        FROM zones""",
    "o06_first_features": """
        SELECT cell_id, station_name, station_id, coalesce(area_ha, 0)::DOUBLE AS area_ha
        FROM zones ORDER BY cell_id, station_id LIMIT 5""",
    "q08_zone_at_point": """
        SELECT DISTINCT ON (point_id) point_id, station_id, station_name, area_ha
        FROM points JOIN zones
          ON lon > x AND lon < x + 0.25::DOUBLE AND lat > y AND lat < y + 0.25::DOUBLE
        ORDER BY point_id, cell_id""",
    "q08_stored_index": """
        SELECT DISTINCT ON (point_id) point_id, s_suppkey::INT AS cell_id,
               'S' || s_suppkey AS station_id, s_name AS station_name, s_acctbal AS area_ha
        FROM (SELECT c_custkey AS point_id,
                     21.0::DOUBLE + (c_custkey * 37 % 1024) / 256.0::DOUBLE
                         + 2.5::DOUBLE * (c_custkey // 1500 % 16) AS lon,
                     50.0::DOUBLE + (c_custkey * 53 % 1024) / 256.0::DOUBLE
                         + 2.5::DOUBLE * (c_custkey // 24000 % 8) AS lat FROM customer) p
        JOIN (SELECT *, 21.25::DOUBLE + 0.25::DOUBLE * (s_suppkey % 10)
                            + 2.5::DOUBLE * (s_suppkey // 100 % 16) AS x,
                     50.25::DOUBLE + 0.25::DOUBLE * (s_suppkey // 10 % 10)
                            + 2.5::DOUBLE * (s_suppkey // 1600 % 8) AS y FROM supplier) z
          ON (abs(lon - x) + abs(lat - y) < 0.1875::DOUBLE
              AND NOT (abs(lon - x) <= 0.03125::DOUBLE AND abs(lat - y) <= 0.03125::DOUBLE))
          OR (lon > x + 0.125::DOUBLE AND lat > y + 0.125::DOUBLE
              AND lon - x + lat - y < 0.375::DOUBLE)
        ORDER BY point_id, s_suppkey""",
    "q19_locations_in_bbox": """
        SELECT id, name, category, lon, lat FROM locations
        WHERE lon > 21.5 AND lon < 24.2 AND lat > 50.2 AND lat < 52.3""",
    "q19_pruned_bbox": """
        SELECT id, name, category, lon, lat FROM locations
        WHERE lon > 21.5 AND lon < 24.2 AND lat > 50.2 AND lat < 52.3""",
    "q19_locations_by_id": """
        SELECT id, name, category, lon, lat FROM locations
        WHERE id IN (SELECT o_custkey FROM orders)""",
    "q19_location_features": """
        SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ','
               || lat || ']},"properties":{"name":"' || name || '","category":"' || category
               || '"}}' AS feature
        FROM locations""",
    "q20_nearest_station": """
        SELECT DISTINCT ON (point_id) point_id, station_id, station_name,
               (s.lon - p.lon) * (s.lon - p.lon) + (s.lat - p.lat) * (s.lat - p.lat) AS distance2
        FROM points p JOIN pins s
          ON s.lon BETWEEN p.lon - 0.04 AND p.lon + 0.04
         AND s.lat BETWEEN p.lat - 0.04 AND p.lat + 0.04
        WHERE distance2 < 0.03::DOUBLE * 0.03::DOUBLE
        ORDER BY point_id, distance2, position""",
    "q20_resolved_clicks": "SELECT * FROM resolved",
    "q20_selected_stations": """
        SELECT click_id, station_id, place FROM (
            SELECT *, dense_rank() OVER (PARTITION BY session ORDER BY ts, place) AS nth
            FROM (SELECT c.click_id, c.session, c.ts, r.station_id,
                         printf('%.5f,%.5f', c.lat, c.lon) AS place
                  FROM clicks c JOIN resolved r ON r.click_id = c.click_id)) k
        WHERE place IS DISTINCT FROM (
            SELECT max(b.place) FROM (
                SELECT DISTINCT c.session, c.ts, printf('%.5f,%.5f', c.lat, c.lon) AS place,
                       dense_rank() OVER (PARTITION BY c.session
                           ORDER BY c.ts, printf('%.5f,%.5f', c.lat, c.lon)) AS nth
                FROM clicks c JOIN resolved r ON r.click_id = c.click_id) b
            WHERE b.session = k.session AND b.nth = k.nth - 1)""",
    "w06_changed_clicks": """
        SELECT session, ts, place FROM (
            SELECT *, lag(place) OVER (PARTITION BY session ORDER BY ts, place) AS before
            FROM (SELECT session, ts, printf('%.5f,%.5f', lat, lon) AS place FROM clicks))
        WHERE place IS DISTINCT FROM before""",
    "w06_changed_in_parts": """
        SELECT session, ts, place FROM (
            SELECT *, lag(place) OVER (PARTITION BY session ORDER BY ts, place) AS before
            FROM (SELECT session, ts, printf('%.5f,%.5f', lat, lon) AS place FROM clicks))
        WHERE place IS DISTINCT FROM before""",
    "p10_scene_filter": """
        SELECT id, cloud_cover, href FROM matching WHERE href IS NOT NULL""",
    "q13_scene_search": """
        SELECT id, cloud_cover, datetime, href FROM matching WHERE href IS NOT NULL""",
    "o05_scene_page": """
        SELECT id, cloud_cover, href
        FROM (SELECT * FROM matching ORDER BY cloud_cover, id LIMIT 500) WHERE href IS NOT NULL""",
    "p12_linked_scenes": """
        SELECT id, href FROM scenes WHERE collection = 'sentinel-2-l2a' AND href IS NOT NULL""",
    "p13_region_scenes": """
        SELECT id, tile FROM tiled WHERE tile IN (SELECT tile FROM region_tiles)""",
    "f15_scene_names": """
        SELECT id, tile, replace(tile, 'MGRS-', '') AS short, short_platform AS platform,
               datetime[1:10] AS day
        FROM tiled""",
    "q14_best_scenes": "SELECT tile, id, nodata, cloud, href FROM best",
    "a09_best_scene_of_all": """
        SELECT DISTINCT ON (tile) tile, id, coalesce(nodata_pct, 0) AS nodata,
               coalesce(cloud_cover, 0) AS cloud
        FROM tiled WHERE collection = 'sentinel-2-l2a' AND href IS NOT NULL
          AND tile IN (SELECT tile FROM region_tiles)
        ORDER BY tile, nodata, cloud, cloud_cover NULLS FIRST, id""",
    "q15_coverage_report": """
        SELECT count(*)::INT AS covered, 16 AS wanted,
               (SELECT coalesce(string_agg(replace(tile, 'MGRS-', ''), ',' ORDER BY tile), '')
                FROM region_tiles WHERE tile NOT IN (SELECT tile FROM best)) AS missing,
               avg(cloud) AS avg_cloud, max(cloud) AS max_cloud, max(nodata) AS max_nodata,
               count(DISTINCT datetime[1:10])::INT AS dates,
               array_to_string(list_sort(list(DISTINCT short_platform)), ',') AS platforms,
               coalesce(string_agg(replace(tile, 'MGRS-', ''), ',' ORDER BY tile)
                        FILTER (WHERE nodata > 5), '') AS partial
        FROM best""",
    "q15_report_with_gaps": """
        SELECT count(*)::INT AS covered, 16 AS wanted,
               (SELECT coalesce(string_agg(replace(tile, 'MGRS-', ''), ',' ORDER BY tile), '')
                FROM region_tiles WHERE tile NOT IN (SELECT tile FROM gap_best)) AS missing,
               avg(cloud) AS avg_cloud, max(cloud) AS max_cloud, max(nodata) AS max_nodata,
               count(DISTINCT datetime[1:10])::INT AS dates,
               array_to_string(list_sort(list(DISTINCT short_platform)), ',') AS platforms,
               coalesce(string_agg(replace(tile, 'MGRS-', ''), ',' ORDER BY tile)
                        FILTER (WHERE nodata > 5), '') AS partial
        FROM gap_best""",
    "o08_tile_details": """
        SELECT replace(tile, 'MGRS-', '') AS tile, datetime[1:10] AS day,
               short_platform AS platform, cloud, nodata
        FROM best""",
    "u05_missing_tiles": """
        SELECT replace(tile, 'MGRS-', '') AS tile FROM region_tiles
        WHERE tile NOT IN (SELECT tile FROM best)""",
    "u05_tiles_in_gaps": """
        SELECT replace(tile, 'MGRS-', '') AS tile FROM region_tiles
        WHERE tile NOT IN (SELECT tile FROM gap_best)""",
    "p17_partial_tiles": """
        SELECT replace(tile, 'MGRS-', '') AS tile, nodata FROM best WHERE nodata > 5""",
    "p17_tiles_with_gaps": """
        SELECT replace(tile, 'MGRS-', '') AS tile, nodata FROM gap_best WHERE nodata > 5""",
    "a15_region_mosaic_request": """
        SELECT sha256(string_agg(href, '|' ORDER BY href))[1:16] AS digest,
               count(*)::INT AS tile_count, string_agg(href, '|' ORDER BY href) AS urls
        FROM best""",
    "q17_catalogue_search": """
        SELECT id, minx, miny, maxx, maxy, datetime, 'thumbnail,visual' AS asset_keys
        FROM scenes
        WHERE minx <= 24.5 AND maxx >= 21 AND miny <= 52 AND maxy >= 50
          AND acquired_at >= TIMESTAMP '1997-01-01'""",
    "q17_pruned_search": """
        SELECT id, minx, miny, maxx, maxy, datetime, 'thumbnail,visual' AS asset_keys
        FROM scenes
        WHERE minx <= 24.5 AND maxx >= 21 AND miny <= 52 AND maxy >= 50
          AND acquired_at >= TIMESTAMP '1997-01-01'""",
    "q18_catalogue_counts": "SELECT collection, count(*) AS items FROM scenes GROUP BY ALL",
    "k03_replaced_catalogue": """
        SELECT 'item' || o_orderkey AS id, 'c-' || o_orderstatus AS collection,
               o_orderdate::DATE AS day, o_totalprice AS size
        FROM orders WHERE o_orderstatus NOT IN (SELECT l_linestatus FROM lineitem)
        UNION ALL
        SELECT * FROM (
            SELECT DISTINCT ON (l_orderkey, l_linestatus) 'item' || l_orderkey AS id,
                   'c-' || l_linestatus AS collection, l_shipdate::DATE AS day,
                   l_extendedprice AS size
            FROM lineitem
            ORDER BY l_orderkey, l_linestatus, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                     l_extendedprice DESC, l_shipdate DESC)""",
    "k03_upserted_documents": """
        SELECT 'd' || c_custkey AS id, c_name AS title, c_acctbal AS size FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey + 100 FROM orders)
        UNION ALL
        SELECT * FROM (SELECT DISTINCT ON (o_custkey) 'd' || (o_custkey + 100) AS id,
                              o_orderpriority AS title, o_totalprice AS size
                       FROM orders ORDER BY o_custkey, o_orderkey DESC)""",
    "v06_search_requests": """
        SELECT search_id, last, (last - first + 1)::INT AS days,
               first || '|' || last || '|' || max_cloud AS print
        FROM (SELECT o_orderkey AS search_id, o_orderdate::DATE AS first,
                     greatest(o_orderdate::DATE,
                              o_orderdate::DATE + (o_custkey % 9)::INT - 3)::DATE AS last,
                     (floor(o_totalprice) % 101)::INT AS max_cloud
              FROM orders)""",
    "q16_mosaic_manifests": """
        SELECT e.digest, 7 AS minzoom, 13 AS maxzoom, 7 AS quadkey_zoom, minx, miny, maxx, maxy,
               (minx + maxx) / 2 AS center_lon, (miny + maxy) / 2 AS center_lat,
               q.tile_keys, q.tiles
        FROM extents e JOIN (
            SELECT digest, count(*)::INT AS tile_keys,
                   string_agg(quadkey || '=' || urls, ';' ORDER BY quadkey || '=' || urls) AS tiles
            FROM quadkeys GROUP BY ALL) q USING (digest)""",
    "s10_listed_urls": """
        SELECT request_id, 'u' || (k % 7) AS url
        FROM (SELECT o_orderkey AS request_id, unnest(range(0, o_custkey % 40)) AS k
              FROM orders)""",
    "a14_request_digests": """
        SELECT request_id, digest, len(urls)::INT AS tile_count FROM request_digests""",
    "a12_quadkey_index": "SELECT * FROM quadkeys",
    "a13_mosaic_extents": """
        SELECT *, (minx + maxx) / 2 AS center_lon, (miny + maxy) / 2 AS center_lat FROM extents""",
    "k05_new_manifests": """
        SELECT digest, len(urls)::INT AS links FROM link_sets
        WHERE digest NOT IN (
            SELECT digest FROM request_digests JOIN orders ON o_orderkey = request_id
            WHERE o_orderdate < TIMESTAMP '1998-01-01')""",
    "k05_incomplete_sets": """
        SELECT digest, len(urls)::INT AS links, string_agg(url, '|' ORDER BY url) AS missing
        FROM unplaced JOIN link_sets USING (digest) GROUP BY ALL""",
    "k05_sets_without_footprints": """
        SELECT digest, len(urls)::INT AS links, string_agg(url, '|' ORDER BY url) AS missing
        FROM (SELECT digest, urls, unnest(urls) AS url FROM link_sets)
        JOIN supplier ON url = 'https://images.example/' || s_suppkey || '.tif'
        WHERE s_acctbal < 0 GROUP BY ALL""",
    "a13_extents_of_complete_sets": """
        SELECT digest, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy,
               (min(minx) + max(maxx)) / 2 AS center_lon, (min(miny) + max(maxy)) / 2 AS center_lat
        FROM placed
        WHERE digest NOT IN (
            SELECT digest FROM (SELECT digest, unnest(urls) AS url FROM link_sets)
            JOIN supplier ON url = 'https://images.example/' || s_suppkey || '.tif'
            WHERE s_acctbal < 0) GROUP BY ALL""",
    "v05_refused_requests": """
        SELECT o_orderkey AS request_id, (o_custkey % 40)::INT AS links,
               CASE WHEN o_custkey % 40 = 0 THEN 'no links' ELSE 'too many links' END AS reason
        FROM orders WHERE o_custkey % 40 NOT BETWEEN 1 AND 32""",
    "v05_refused_years": "SELECT * FROM requests WHERE year NOT BETWEEN 2000 AND 2100",
    "v07_rejected_documents": """
        SELECT l_orderkey, l_linenumber, '{"content":[{"stationId":"S' || l_suppkey AS document
        FROM lineitem WHERE l_returnflag = 'R'""",
    "v01_duplicate_keys": """
        SELECT station_id, date, count(*) AS rows FROM readings GROUP BY ALL HAVING count(*) > 1""",
    "v02_missing_values": """
        SELECT "column", missing FROM (
            SELECT count(*) FILTER (WHERE id IS NULL) AS id,
                   count(*) FILTER (WHERE name_pl IS NULL) AS name_pl,
                   count(*) FILTER (WHERE name_latin IS NULL) AS name_latin,
                   count(*) FILTER (WHERE base_temp_c IS NULL) AS base_temp_c,
                   count(*) FILTER (WHERE gdd_min IS NULL) AS gdd_min,
                   count(*) FILTER (WHERE gdd_max IS NULL) AS gdd_max
            FROM catalogue_plants)
        UNPIVOT (missing FOR "column" IN (id, name_pl, name_latin, base_temp_c, gdd_min, gdd_max))""",
    "v03_rejected_features": """
        SELECT cell_id, 'station_id' AS lacking FROM zones WHERE station_id = ''""",
    "v04_bloom_status_contract": """
        SELECT "column", missing FROM (
            SELECT count(*) FILTER (WHERE station_id IS NULL) AS station_id,
                   count(*) FILTER (WHERE date IS NULL) AS date,
                   count(*) FILTER (WHERE plant_id IS NULL) AS plant_id,
                   count(*) FILTER (WHERE plant_name IS NULL) AS plant_name,
                   count(*) FILTER (WHERE gdd_cumulative IS NULL) AS gdd_cumulative,
                   count(*) FILTER (WHERE bloom_day IS NULL) AS bloom_day,
                   count(*) FILTER (WHERE bloom_phase IS NULL) AS bloom_phase,
                   count(*) FILTER (WHERE bloom_phase_label IS NULL) AS bloom_phase_label,
                   count(*) FILTER (WHERE gdd_min IS NULL) AS gdd_min,
                   count(*) FILTER (WHERE gdd_max IS NULL) AS gdd_max
            FROM statuses)
        UNPIVOT (missing FOR "column" IN (station_id, date, plant_id, plant_name, gdd_cumulative,
                 bloom_day, bloom_phase, bloom_phase_label, gdd_min, gdd_max))""",
    "v04_contract_beside_the_write": """
        SELECT "column", missing FROM (
            SELECT count(*) FILTER (WHERE station_id IS NULL) AS station_id,
                   count(*) FILTER (WHERE date IS NULL) AS date,
                   count(*) FILTER (WHERE plant_id IS NULL) AS plant_id,
                   count(*) FILTER (WHERE plant_name IS NULL) AS plant_name,
                   count(*) FILTER (WHERE gdd_cumulative IS NULL) AS gdd_cumulative,
                   count(*) FILTER (WHERE bloom_day IS NULL) AS bloom_day,
                   count(*) FILTER (WHERE bloom_phase IS NULL) AS bloom_phase,
                   count(*) FILTER (WHERE bloom_phase_label IS NULL) AS bloom_phase_label,
                   count(*) FILTER (WHERE gdd_min IS NULL) AS gdd_min,
                   count(*) FILTER (WHERE gdd_max IS NULL) AS gdd_max
            FROM statuses)
        UNPIVOT (missing FOR "column" IN (station_id, date, plant_id, plant_name, gdd_cumulative,
                 bloom_day, bloom_phase, bloom_phase_label, gdd_min, gdd_max))""",
    "d07_unknown_totals": """
        SELECT plant_id, count(*) FILTER (WHERE gdd_cumulative IS NULL) AS days_without_total,
               count(*) AS days
        FROM gdd GROUP BY ALL""",
    "a16_months_without_precipitation": """
        SELECT d.station_id, year(d.date)::INT AS year, count(p.precip_mm) = 0 AS all_missing
        FROM daily d LEFT JOIN precipitation p USING (station_id, date) GROUP BY ALL""",
    "f16_bloom_day_texts": """
        SELECT plant_id, CASE WHEN bloom_day > 0 THEN bloom_day::VARCHAR ELSE '-' END AS bloom_day,
               CASE bloom_phase WHEN 'before' THEN 'Przed kwitnieniem'
                    WHEN 'blooming' THEN 'Kwitnie' ELSE 'Po kwitnieniu' END AS phase,
               count(*) AS rows
        FROM gdd GROUP BY ALL""",
}


def _needed(text: str) -> list[str]:
    """Names of the subqueries a statement uses, in definition order."""
    import re

    words = set(re.findall(r"[a-z_]+", text))
    found: set[str] = set()
    for name in reversed(list(VIEWS)):
        if name in words:
            found.add(name)
            words |= set(re.findall(r"[a-z_]+", VIEWS[name]))
    return [name for name in VIEWS if name in found]


def statement(name: str) -> str:
    """One SQL statement for a registered query."""
    final = FINAL[name]
    parts = [f"{view} AS ({VIEWS[view]})" for view in _needed(final)]
    return f"WITH {', '.join(parts)} {final}" if parts else final
