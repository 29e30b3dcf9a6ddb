"""The engine's inputs as views over the given tables.

Every view covers its whole table. Values are exact in binary where sums are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G
from bloomgrid.functions import scenes as S
from bloomgrid.operators.weather import daily_extremes


class Views:
    """Lazily defined stand-ins for one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # weather ------------------------------------------------------------------------------

    def readings(self) -> DataFrame:
        """One reading per line item: the supplier is the station. Some readings are missing."""
        return self.table("lineitem").selectExpr(
            "concat('S', l_suppkey) AS station_id",
            "to_date(l_shipdate) AS date",
            "CASE WHEN l_quantity = 7 THEN NULL WHEN l_quantity = 8 THEN double('NaN')"
            " ELSE (l_quantity - 10) / 2.0D END AS air_temperature",
        )

    def readings_new(self) -> DataFrame:
        """Several readings a day per user, in January 2024."""
        return self.table("events").selectExpr(
            "concat('U', user_id) AS station_id",
            "to_date(ts) AS date",
            "value / 20.0D AS air_temperature",
        )

    def history(self) -> DataFrame:
        """Earlier daily rows, one per event type, so that keys repeat; `position` is file order."""
        return (
            self.table("events")
            .groupBy(
                F.expr("concat('U', user_id)").alias("station_id"),
                F.to_date("ts").alias("date"),
                "event_type",
            )
            .agg(
                F.min(F.expr("value / 10.0D")).alias("t_min"),
                F.max(F.expr("value / 10.0D")).alias("t_max"),
                F.min("event_id").alias("position"),
            )
            .withColumn("t_mean", F.col("t_max"))
        )

    def daily(self) -> DataFrame:
        return daily_extremes(self.readings())

    def plants(self) -> DataFrame:
        """Region as a small dictionary; one plant has no season."""
        return self.table("region").selectExpr(
            "concat('P', r_regionkey) AS id",
            "r_name AS name_pl",
            "lower(r_name) AS name_latin",
            "3.0D + r_regionkey * 0.5D AS base_temp_c",
            "100.0D + r_regionkey * 25.0D AS gdd_min",
            "200.0D + r_regionkey * 50.0D AS gdd_max",
            "CASE WHEN r_name <> 'EUROPE' THEN 'wiosna' END AS season",
        )

    def catalogue_plants(self) -> DataFrame:
        """Part as a plant dictionary that grows; some entries lack thresholds."""
        return self.table("part").selectExpr(
            "concat('plant', p_partkey) AS id",
            "p_name AS name_pl",
            "p_type AS name_latin",
            "CASE WHEN p_size > 5 THEN p_size / 4.0D END AS base_temp_c",
            "CASE WHEN p_size > 10 THEN floor(p_retailprice) / 8.0D END AS gdd_min",
            "CASE WHEN p_size > 15 THEN floor(p_retailprice) / 4.0D END AS gdd_max",
            "CASE WHEN p_size > 20 THEN p_brand END AS season",
        )

    def plantings(self) -> DataFrame:
        """Which plants of the growing dictionary stand at which station."""
        return self.table("lineitem").selectExpr(
            "concat('S', l_suppkey) AS station_id", "concat('plant', l_partkey) AS plant_id"
        )

    def precipitation(self) -> DataFrame:
        stations = self.table("supplier").agg(F.count("*")).scalar()
        return (
            self.table("orders")
            .groupBy(
                F.concat(F.lit("S"), F.col("o_custkey") % stations).alias("station_id"),
                F.to_date("o_orderdate").alias("date"),
            )
            .agg(F.sum(F.expr("floor(o_totalprice) % 40")).cast("double").alias("precip_mm"))
        )

    def year_requests(self) -> DataFrame:
        stations = self.table("supplier").agg(F.count("*")).scalar()
        return self.table("orders").select(
            F.concat(F.lit("S"), F.col("o_custkey") % stations).alias("station_id"),
            F.year("o_orderdate").alias("year"),
            F.expr("concat('P', o_orderkey % 6)").alias("plant_id"),
        ).distinct()

    def day_requests(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('S', l_suppkey) AS station_id",
            "to_date(l_shipdate) AS date",
            "concat('P', l_linenumber % 6) AS plant_id",
        )

    # space --------------------------------------------------------------------------------

    def zones(self) -> DataFrame:
        """A rectangle per supplier, a second one where the balance is negative, and one
        without readings per nation. `position` is the place in the zone file."""
        suppliers = self.table("supplier").selectExpr(
            "s_suppkey AS i",
            "21.0D + 0.25D * (s_suppkey % 10) + 2.5D * (s_suppkey DIV 100 % 16) AS x",
            "50.0D + 0.25D * (s_suppkey DIV 10 % 10) + 2.5D * (s_suppkey DIV 1600 % 8) AS y",
            "s_name", "s_acctbal", "s_nationkey",
        )
        first = suppliers.selectExpr(
            "CAST(i * 2 AS INT) AS cell_id", "concat('S', i) AS station_id",
            "s_name AS station_name", "s_acctbal AS area_ha", "x", "y",
            "CASE WHEN s_nationkey <> 3 THEN y + 0.125D END AS latitude",
            "x + 0.125D AS longitude",
            "CASE WHEN s_nationkey > 12 THEN 'PME' END AS station_type",
        )
        second = suppliers.where("s_acctbal < 0").selectExpr(
            "CAST(i * 2 + 1 AS INT) AS cell_id", "concat('S', i) AS station_id",
            "concat(s_name, ' B') AS station_name", "-s_acctbal AS area_ha",
            "x + 0.125D AS x", "y + 0.125D AS y",
            "y + 0.25D AS latitude", "x + 0.25D AS longitude", "'IUNG' AS station_type",
        )
        silent = self.table("nation").selectExpr(
            "CAST(-1 - n_nationkey AS INT) AS cell_id",
            "CASE WHEN n_regionkey <> 0 THEN concat('N', n_nationkey) ELSE '' END AS station_id",
            "n_name AS station_name", "CAST(NULL AS DOUBLE) AS area_ha",
            "10.0D + 0.5D * n_nationkey AS x", "40.0D AS y",
            "40.125D AS latitude", "10.125D + 0.5D * n_nationkey AS longitude",
            "CAST(NULL AS STRING) AS station_type",
        )
        rows = first.unionByName(second).unionByName(silent)
        side = F.lit(0.25)
        x, y = F.col("x"), F.col("y")
        return rows.select(
            "*",
            F.col("cell_id").alias("position"),
            F.lit("Polygon").alias("geom_type"),
            G.rectangle(x, y, x + side, y + side).alias("polys"),
            F.struct(x.alias("minx"), y.alias("miny"), (x + side).alias("maxx"),
                     (y + side).alias("maxy")).alias("bbox"),
        ).drop("x", "y")

    def slanted_zones(self) -> DataFrame:
        """A zone per supplier: a diamond with a square hole, and a triangle beside it. Zones overlap
        their neighbours."""
        shapes = {
            "diamond": [(-12, 0), (0, -12), (12, 0), (0, 12), (-12, 0)],
            "hole": [(-2, -2), (-2, 2), (2, 2), (2, -2), (-2, -2)],
            "triangle": [(8, 8), (16, 8), (8, 16), (8, 8)],
        }

        def ring(points) -> str:
            places = (f"array(x + {dx / 64}D, y + {dy / 64}D)" for dx, dy in points)
            return f"array({', '.join(places)})"

        rows = self.table("supplier").selectExpr(
            "21.25D + 0.25D * (s_suppkey % 10) + 2.5D * (s_suppkey DIV 100 % 16) AS x",
            "50.25D + 0.25D * (s_suppkey DIV 10 % 10) + 2.5D * (s_suppkey DIV 1600 % 8) AS y",
            "s_suppkey", "s_name", "s_acctbal",
        )
        parts = f"array(array({ring(shapes['diamond'])}, {ring(shapes['hole'])}), array({ring(shapes['triangle'])}))"
        return rows.selectExpr(
            "CAST(s_suppkey AS INT) AS cell_id", "concat('S', s_suppkey) AS station_id",
            "s_name AS station_name", "s_acctbal AS area_ha", f"{parts} AS polys",
        ).withColumn("bbox", G.bbox_of(F.col("polys")))

    def exact_points(self) -> DataFrame:
        """Customers on a grid whose coordinates are exact in binary, many of them on edges."""
        return self.table("customer").selectExpr(
            "c_custkey AS point_id",
            "21.0D + (c_custkey * 37 % 1024) / 256.0D + 2.5D * (c_custkey DIV 1500 % 16) AS lon",
            "50.0D + (c_custkey * 53 % 1024) / 256.0D + 2.5D * (c_custkey DIV 24000 % 8) AS lat",
        )

    def outlines(self) -> DataFrame:
        """A square per supplier with bent sides, and a slanted hole with points on its sides.

        What simplification leaves of them is known: the corners.
        """
        bent = [(0, 0), (16, -1), (32, 0), (33, 16), (32, 32), (16, 33), (0, 32), (-1, 16), (0, 0)]
        hole = [(16, 8), (20, 12), (24, 16), (20, 20), (16, 24), (12, 20), (8, 16), (12, 12), (16, 8)]

        def ring(points) -> str:
            places = (f"array(x + {dx / 128}D, y + {dy / 128}D)" for dx, dy in points)
            return f"array({', '.join(places)})"

        rows = self.table("supplier").selectExpr(
            "s_suppkey AS i", "21.0D + 0.25D * (s_suppkey % 10) AS x",
            "50.0D + 0.25D * (s_suppkey DIV 10) AS y", "s_name", "s_acctbal",
        )
        shaped = rows.selectExpr(
            "CAST(i AS INT) AS cell_id", "concat('S', i) AS station_id",
            "s_name AS station_name", "s_acctbal AS area_ha",
            "CAST(NULL AS DATE) AS bloom_start_date", "CAST(NULL AS DATE) AS bloom_end_date",
            "CAST(NULL AS STRING) AS bloom_tooltip", "'Polygon' AS geom_type",
            f"array(array({ring(bent)}, {ring(hole)})) AS polys",
        )
        return shaped.withColumn("bbox", G.bbox_of(F.col("polys")))

    def bulged_outlines(self) -> DataFrame:
        """A box per supplier with a bulge thinner than the tolerance, and a hole inside the bulge.

        Cutting the bulge off would put the hole outside, so one of its points has to stay.
        """
        shell = [(0, 0), (80, 0), (80, 40), (48, 40), (44, 44), (36, 44), (32, 40), (0, 40), (0, 0)]
        hole = [(38, 41), (42, 41), (42, 43), (38, 43), (38, 41)]

        def ring(points) -> str:
            places = (f"array(x + {dx / 256}D, y + {dy / 256}D)" for dx, dy in points)
            return f"array({', '.join(places)})"

        return self.table("supplier").selectExpr(
            "s_suppkey", "21.0D + 0.5D * (s_suppkey % 10) AS x", "50.0D + 0.25D * (s_suppkey DIV 10) AS y",
        ).selectExpr("CAST(s_suppkey AS INT) AS cell_id", f"array(array({ring(shell)}, {ring(hole)})) AS polys")

    def _placed_customers(self, *columns: str) -> DataFrame:
        """Customers with a place each; some lie on zone edges."""
        return self.table("customer").selectExpr(
            *columns,
            "21.0D + (c_custkey * 37 % 1000) / 400.0D + 2.5D * (c_custkey DIV 1500 % 16) AS lon",
            "50.0D + (c_custkey * 53 % 1000) / 400.0D + 2.5D * (c_custkey DIV 24000 % 8) AS lat",
        )

    def points(self) -> DataFrame:
        return self._placed_customers("c_custkey AS point_id")

    def locations(self) -> DataFrame:
        return self._placed_customers(
            "c_custkey AS id", "c_name AS name", "c_mktsegment AS category"
        )

    def clicks(self) -> DataFrame:
        """A click per event; every tenth of the value scale is one place, half of which lie
        exactly between two five-decimal keys."""
        return self.table("events").selectExpr(
            "event_id AS click_id", "user_id AS session", "ts",
            "21.0D + floor(value / 10) / 64.0D AS lon",
            "50.0D + (user_id % 50) / 20.0D AS lat",
            "CASE WHEN event_type = 'purchase' THEN concat('S', user_id) END AS station_id",
            "CAST(NULL AS STRING) AS station_name",
        )

    # catalogue ----------------------------------------------------------------------------

    def scenes(self) -> DataFrame:
        """A scene per order: sixteen known tiles, two old names, two unknown ones."""
        tiles = (*S.REGION_TILES, *S.TILE_ALIASES, "MGRS-33UVR", "MGRS-36UWV")
        codes = ", ".join(f"'{tile.removeprefix(S.TILE_PREFIX)}'" for tile in tiles)
        base = self.table("orders").selectExpr(
            "o_orderkey AS k",
            f"array({codes})[CAST(o_custkey % 20 AS INT)] AS code",
            "CAST(o_custkey % 20 AS INT) AS t",
            "o_orderdate AS at", "o_orderstatus AS st", "o_orderpriority AS pr",
            "floor(o_totalprice) AS price",
        )
        return base.selectExpr(
            "CASE WHEN pr = '1-URGENT' THEN concat('scene', k) ELSE concat('S2',"
            " CASE st WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END, '_', code, '_',"
            " date_format(at, 'yyyyMMdd'), '_', k, '_L2A') END AS id",
            "CASE WHEN st = 'P' AND pr = '2-HIGH' THEN 'other' ELSE 'sentinel-2-l2a' END"
            " AS collection",
            "at AS acquired_at",
            "concat(date_format(at, 'yyyy-MM-dd'), 'T09:40:31Z') AS datetime",
            "20.9D + 0.2D * t AS minx", "49.9D + 0.125D * t AS miny",
            "22.4D + 0.2D * t AS maxx", "50.9D + 0.125D * t AS maxy",
            "CASE WHEN pr = '1-URGENT' OR st <> 'F' THEN concat('MGRS-', code) END AS grid_code",
            "CASE WHEN pr <> '5-LOW' OR st <> 'O' THEN CAST(price % 101 AS DOUBLE) END"
            " AS cloud_cover",
            "CAST(nullif(k % 7, 0) AS DOUBLE) AS nodata_pct",
            "CASE st WHEN 'F' THEN 'sentinel-2a' WHEN 'O' THEN 'Sentinel-2B' END AS platform",
            "map('visual', named_struct('href', CASE WHEN pr <> '4-NOT SPECIFIED' THEN"
            " concat('https://images.example/', k, '.tif') ELSE '' END, 'type', 'image/tiff',"
            " 'title', CAST(NULL AS STRING), 'roles', array('visual')),"
            " 'thumbnail', named_struct('href', concat('https://images.example/', k, '.jpg'),"
            " 'type', 'image/jpeg', 'title', CAST(NULL AS STRING), 'roles', array('thumbnail')))"
            " AS assets",
        )

    def scenes_with_gaps(self) -> DataFrame:
        """Scenes without those of two region tiles, and with many empty pixels."""
        gaps = ("34UEB", "35ULT")
        code = F.coalesce(F.substring("grid_code", 6, 5), F.get(F.split("id", "_"), F.lit(1)), F.lit(""))
        return self.scenes().where(~code.isin(*gaps)).withColumn(
            "nodata_pct", (F.col("nodata_pct") + 2.0) * 2.0
        )

    def known_footprints(self) -> DataFrame:
        """Footprints of the images of suppliers that are not in debt; the others are unknown."""
        able = self.table("supplier").where("s_acctbal >= 0").selectExpr(
            "concat('https://images.example/', s_suppkey, '.tif') AS url"
        )
        return self.footprints().join(able, "url", "left_semi")

    def customer_collections(self) -> DataFrame:
        """A collection document per customer."""
        return self.table("customer").selectExpr(
            "concat('{\"id\":\"c', c_custkey, '\",\"title\":\"', c_name,"
            " '\",\"extent\":{\"spatial\":{\"bbox\":[[', c_nationkey, ',1,2,3]]}}}') AS document"
        )

    def stored_items(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('item', o_orderkey) AS id", "concat('c-', o_orderstatus) AS collection",
            "to_date(o_orderdate) AS day", "o_totalprice AS size",
        )

    def loaded_items(self) -> DataFrame:
        """A load in which ids repeat; `position` is the place in the load."""
        return self.table("lineitem").selectExpr(
            "concat('item', l_orderkey) AS id", "concat('c-', l_linestatus) AS collection",
            "to_date(l_shipdate) AS day", "l_extendedprice AS size",
            "named_struct('a', l_linenumber, 'b', l_partkey, 'c', l_suppkey, 'd', l_extendedprice,"
            " 'e', l_shipdate)"
            " AS position",
        )

    def stored_documents(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('d', c_custkey) AS id", "c_name AS title", "c_acctbal AS size"
        )

    def loaded_documents(self) -> DataFrame:
        """Documents loaded again, most of them often, some for the first time."""
        return self.table("orders").selectExpr(
            "concat('d', o_custkey + 100) AS id", "o_orderpriority AS title",
            "o_totalprice AS size", "o_orderkey AS position",
        )

    def searches(self) -> DataFrame:
        """Scene searches, some with the end before the start."""
        return self.table("orders").selectExpr(
            "o_orderkey AS search_id", "to_date(o_orderdate) AS first",
            "date_add(to_date(o_orderdate), CAST(o_custkey % 9 AS INT) - 3) AS last",
            "CAST(floor(o_totalprice) % 101 AS INT) AS max_cloud",
        )

    # documents ----------------------------------------------------------------------------

    def reading_pages(self) -> DataFrame:
        """A landed page per line item, with two readings or without content."""
        return self.table("lineitem").selectExpr(
            "CASE WHEN l_returnflag = 'N' THEN '{}' ELSE concat("
            "'{\"content\":[{\"stationId\":\"S', l_suppkey, '\",\"measurementDate\":\"',"
            " date_format(l_shipdate, 'yyyy-MM-dd'), 'T23:30:00Z\",\"airTemperature\":',"
            " CAST(l_quantity AS STRING), '},{\"stationId\":\"S', l_suppkey,"
            " '\",\"measurementDate\":\"', date_format(l_shipdate, 'yyyy-MM-dd'),"
            " 'T00:10:00Z\"}]}') END AS document"
        )

    def zone_documents(self) -> DataFrame:
        """A zone file per supplier: a two-part zone, then a plain one without area."""
        square = "[[[{x},50.0],[{x}.5,50.0],[{x}.5,50.5],[{x},50.5],[{x},50.0]]]"
        a, b = square.format(x="20"), square.format(x="30")
        return self.table("supplier").selectExpr(
            "concat('{\"type\":\"FeatureCollection\",\"features\":[{\"type\":\"Feature\",'"
            f" '\"geometry\":{{\"type\":\"MultiPolygon\",\"coordinates\":[{a},{b}]}},'"
            " '\"properties\":{\"cell_id\":', s_suppkey, ',\"station_id\":\"S', s_suppkey,"
            " '\",\"station_name\":\"', s_name, '\",\"area_ha\":', CAST(s_acctbal AS STRING),"
            " ',\"latitude\":50.25,\"longitude\":20.25,\"stationType\":\"PME\"}},'"
            f" '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":{b}}},'"
            " '\"properties\":{\"cell_id\":', s_suppkey + 1, ',\"station_id\":\"S', s_suppkey,"
            " '\",\"station_name\":\"', s_name, '\"}}]}') AS document"
        )

    def boundary_documents(self) -> DataFrame:
        """A boundary per customer in one of the three forms; points are no boundary."""
        return self.table("customer").selectExpr(
            "c_custkey",
            "concat('{\"type\":\"Polygon\",\"coordinates\":[[[', c_custkey,"
            " ',1.0],[3.0,1.0],[3.0,2.0],[', c_custkey, ',1.0]]]}') AS geometry",
            "c_mktsegment",
        ).selectExpr(
            "CASE c_mktsegment WHEN 'BUILDING' THEN geometry"
            " WHEN 'MACHINERY' THEN concat('{\"type\":\"Feature\",\"geometry\":', geometry, '}')"
            " WHEN 'HOUSEHOLD' THEN '{\"type\":\"Point\",\"coordinates\":[1.0,2.0]}'"
            " ELSE concat('{\"type\":\"FeatureCollection\",\"features\":['"
            ", '{\"type\":\"Feature\",\"geometry\":', geometry, '}]}') END AS document"
        )

    def plant_documents(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('[{\"id\":\"p', p_partkey, '\",\"name_pl\":\"', p_name,"
            " '\",\"name_latin\":\"', p_type, '\",\"base_temp_c\":', p_size,"
            " ',\"gdd_min\":100,\"gdd_max\":', floor(p_retailprice), '}]') AS document"
        )

    def item_documents(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('[{\"type\":\"Feature\",\"id\":\"item', o_orderkey,"
            " '\",\"collection\":\"c-', o_orderstatus, '\",\"bbox\":[21.0,50.0,22.0,51.0],'"
            " '\"properties\":{\"datetime\":\"', date_format(o_orderdate, 'yyyy-MM-dd'),"
            " 'T10:00:00Z\",\"eo:cloud_cover\":', floor(o_totalprice) % 100,"
            " ',\"grid:code\":\"MGRS-34UEB\"},\"assets\":{\"visual\":{\"href\":\"h', o_orderkey,"
            " '\",\"roles\":[\"visual\",\"data\"]}}}]') AS document"
        )

    def collection_documents(self) -> DataFrame:
        """A collection document per nation."""
        return self.table("nation").selectExpr(
            "concat('{\"id\":\"c', n_nationkey, '\",\"title\":\"', n_name,"
            " '\",\"extent\":{\"spatial\":{\"bbox\":[[', n_regionkey, ',1,2,3]]}}}') AS document"
        )

    def precipitation_files(self) -> DataFrame:
        """A station-year file per order, two days each."""
        return self.table("orders").selectExpr(
            "concat('ST_', o_custkey, '_', date_format(o_orderdate, 'yyyy'), '.json') AS file_name",
            "concat('{\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\": ', floor(o_totalprice) % 40,"
            " '.5, \"', date_format(o_orderdate, 'yyyy'), '-12-31\": 0.25}') AS document",
        )

    # mosaics ------------------------------------------------------------------------------

    def request_urls(self) -> DataFrame:
        """The images of an order's suppliers."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS request_id", "concat('https://images.example/', l_suppkey, '.tif') AS url"
        )

    def url_lists(self) -> DataFrame:
        """A list of links per order, from none to more than a request may hold."""
        return self.table("orders").selectExpr(
            "o_orderkey AS request_id",
            "transform(slice(sequence(0, 39), 1, CAST(o_custkey % 40 AS INT)),"
            " k -> concat('u', k % 7)) AS urls",
        )

    def footprints(self) -> DataFrame:
        """Footprints of most images; those of some suppliers are unknown."""
        box = (
            "named_struct('minx', 14.0D + 0.37D * (s_suppkey % 40),"
            " 'miny', 45.0D + 0.41D * (s_suppkey DIV 40 % 40),"
            " 'maxx', 15.5D + 0.37D * (s_suppkey % 40),"
            " 'maxy', 46.0D + 0.41D * (s_suppkey DIV 40 % 40)) AS bbox"
        )
        return self.table("supplier").where("s_acctbal > -850").selectExpr(
            "concat('https://images.example/', s_suppkey, '.tif') AS url", box
        )

    def landed_documents(self) -> DataFrame:
        """Landed pages, some of which broke off."""
        return self.table("lineitem").selectExpr(
            "l_orderkey", "l_linenumber",
            "CASE WHEN l_returnflag = 'R' THEN concat('{\"content\":[{\"stationId\":\"S', l_suppkey)"
            " WHEN l_returnflag = 'A' THEN '{\"content\":[]}' END AS document",
        )
