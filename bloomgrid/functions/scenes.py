"""Column expressions over catalogue items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bloomgrid.functions.values import number_or_zero, text_or_null

# Grid tiles of the region, tile aliases, platforms, search defaults.
REGION_TILES = (
    "MGRS-34UEA", "MGRS-34UEB", "MGRS-34UEC", "MGRS-34UED",
    "MGRS-34UFA", "MGRS-34UFB", "MGRS-34UFC", "MGRS-34UFD",
    "MGRS-34UGA", "MGRS-34UGB", "MGRS-34UGC", "MGRS-34UGD",
    "MGRS-35ULR", "MGRS-35ULS", "MGRS-35ULT", "MGRS-35ULU",
)
TILE_ALIASES = {"MGRS-35UKR": "MGRS-35ULR", "MGRS-35UKS": "MGRS-35ULS"}
TILE_PREFIX = "MGRS-"
PLATFORMS = {"sentinel-2a": "S2A", "sentinel-2b": "S2B", "sentinel-2c": "S2C"}
SCENE_COLLECTION = "sentinel-2-l2a"
REGION_BBOX = (21.5, 50.2, 24.2, 52.3)
PARTIAL_NODATA_PCT = 5.0


def canonical_tile(code: Column) -> Column:
    """Old tile names become the current ones; any other code stays."""
    aliases = F.create_map(*[F.lit(part) for pair in TILE_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(aliases, code), code)


def tile_id(grid_code: Column, item_id: Column) -> Column:
    """The grid code, else the five-letter second token of the id, else the id."""
    token = F.get(F.split(item_id, "_"), F.lit(1))
    from_id = F.when(F.length(token) == 5, F.concat(F.lit(TILE_PREFIX), token))
    return F.coalesce(
        canonical_tile(text_or_null(grid_code)), canonical_tile(from_id), item_id, F.lit("")
    )


def short_tile(tile: Column) -> Column:
    return F.replace(tile, F.lit(TILE_PREFIX), F.lit(""))


def scene_platform(item_id: Column, platform: Column) -> Column:
    """`S2x` from the id, else from the platform text, else `?`."""
    head = F.get(F.split(item_id, "_"), F.lit(0))
    label = F.when(head.startswith("S2") & (F.length(head) == 3), head)
    for text, short in PLATFORMS.items():
        label = label.when(F.contains(F.lower(platform), F.lit(text)), short)
    return label.otherwise("?")


def visual_href(assets: Column) -> Column:
    """Link of the true-colour image; NULL when missing or empty."""
    return text_or_null(F.try_element_at(assets, F.lit("visual"))["href"])


def score(nodata_pct: Column, cloud_cover: Column) -> list[Column]:
    """Fewest empty pixels first, then fewest clouds; a missing value ranks as zero."""
    return [number_or_zero(nodata_pct), number_or_zero(cloud_cover)]


def overlaps(bbox: tuple[float, float, float, float]) -> Column:
    """Item rectangle (minx, miny, maxx, maxy columns) meets the given one, edges included."""
    minx, miny, maxx, maxy = bbox
    return (
        (F.col("minx") <= F.lit(float(maxx)))
        & (F.col("maxx") >= F.lit(float(minx)))
        & (F.col("miny") <= F.lit(float(maxy)))
        & (F.col("maxy") >= F.lit(float(miny)))
    )
