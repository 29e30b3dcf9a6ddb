"""Which side of a spatial join may be broadcast: only one whose bytes have been counted as few.

The optimizer's estimate follows file sizes and does not see the grid cells that zones and points
are unfolded to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def placed(frame: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side known as small; sort-merge otherwise, which AQE splits on skew."""
    return F.broadcast(frame) if small else frame.hint("merge")
