"""Fixed splits of rows by a checksum of their id, and bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample(frame: DataFrame, label: str, size: int) -> DataFrame:
    """About `size` distinct rows of each label value, chosen by a hash of the whole row.

    Equal rows are one. A label with more distinct rows gives each the same chance; their number is
    estimated within a few per cent, so the sample is about `size` rows however rows or single
    columns repeat. A label with fewer gives all. One row per label is counted.
    """
    others = [c for c in frame.columns if c != label]
    rows = frame.withColumn("_place", F.xxhash64(F.lit("sample"), *others))
    counts = rows.groupBy(label).agg(F.approx_count_distinct("_place", 0.02).alias("_rows"))
    counted = rows.join(F.broadcast(counts), label) if _few(counts) else rows.join(counts, label)
    place = F.pmod("_place", F.lit(1 << 30))
    chosen = counted.where(place < F.lit(float(size) * (1 << 30)) / F.col("_rows"))
    return chosen.groupBy(label, "_place").agg(
        *[F.any_value(c).alias(c) for c in others]
    ).select(*frame.columns)


def _few(counts: DataFrame) -> bool:
    """Whether the labels are so few that a table of them may be sent to every task."""
    return counts.limit(10_001).count() <= 10_000
