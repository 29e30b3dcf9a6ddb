"""Tables laid out by place, so that a box reads only the files and row groups around it.

Rows are kept by size class and sorted by the place of their centre along a Z-order curve. A box is
turned into ranges of that curve, which reach the scan as plain comparisons; wide rows are met
because the box is widened by half the size of each class. The ranges may take in more than the box:
the exact test stays with whoever asks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.functions import geometry as G

#: Places on the curve: 2**BITS along either axis, over 360 degrees.
BITS = 16
SIDE = 360.0 / 2**BITS
#: Classes are powers of two of degrees; the least one holds points.
LEAST_CLASS, WIDEST_CLASS = -20, 9
#: Ranges a box is turned into at most.
MOST_RANGES = 48
CLASS, CODE = "size_class", "place_code"


def _cell(degrees: Column) -> Column:
    cell = F.floor((degrees + F.lit(180.0)) / F.lit(SIDE))
    return F.greatest(F.least(cell, F.lit(2**BITS - 1)), F.lit(0))


def laid_out(frame: DataFrame, minx: str, miny: str, maxx: str, maxy: str) -> DataFrame:
    """The rows with their size class and place; rows without a place have NULL for both.

    A point is a box whose corners are the same column.
    """
    size = F.greatest(F.col(maxx) - F.col(minx), F.col(maxy) - F.col(miny))
    power = F.ceil(F.log2(F.greatest(size, F.lit(2.0**LEAST_CLASS))))
    code = G.interleaved(
        _cell((F.col(minx) + F.col(maxx)) / 2.0), _cell((F.col(miny) + F.col(maxy)) / 2.0), BITS
    )
    return frame.withColumn(CLASS, F.least(power, F.lit(WIDEST_CLASS)).cast("int")).withColumn(
        CODE, F.when(F.col(CLASS).isNotNull(), code)
    )


def write_by_place(frame: DataFrame, path: str, minx: str, miny: str, maxx: str, maxy: str) -> None:
    """Write the table by class and place; a class or region with many rows takes several files."""
    rows = laid_out(frame, minx, miny, maxx, maxy)
    (
        rows.repartitionByRange(CLASS, CODE).sortWithinPartitions(CLASS, CODE)
        .write.mode("overwrite").partitionBy(CLASS).parquet(path)
    )


def code_ranges(minx: float, miny: float, maxx: float, maxy: float, most: int = MOST_RANGES,
                ) -> list[tuple[int, int]]:
    """Ranges of the curve, both ends included, that cover all places in the box.

    Squares of the curve are halved along both axes, the largest first, while they only meet the box
    and the ranges stay few; neighbours on the curve become one range.
    """
    def cell(degrees: float) -> int:
        return max(0, min(2**BITS - 1, int((degrees + 180.0) // SIDE)))

    x1, x2, y1, y2 = cell(minx), cell(maxx), cell(miny), cell(maxy)
    whole: list[tuple[int, int]] = []
    level, open_squares = BITS, [(0, 0, 0)]  # place on the curve, and lower corner, in cells
    while open_squares and level > 0 and len(whole) + 4 * len(open_squares) <= 4 * most:
        level -= 1
        side, left = 1 << level, []
        for code, x, y in open_squares:
            for quarter in range(4):
                qx, qy = x + side * (quarter & 1), y + side * (quarter >> 1)
                if qx > x2 or qx + side - 1 < x1 or qy > y2 or qy + side - 1 < y1:
                    continue
                place = code + (quarter << 2 * level)
                inside = x1 <= qx and qx + side - 1 <= x2 and y1 <= qy and qy + side - 1 <= y2
                if inside or level == 0:
                    whole.append((place, place + (1 << 2 * level) - 1))
                else:
                    left.append((place, qx, qy))
        open_squares = left
    whole += [(code, code + (1 << 2 * level) - 1) for code, _, _ in open_squares]
    merged: list[tuple[int, int]] = []
    for first, last in sorted(whole):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    while len(merged) > most:  # the narrowest gaps are read along
        gaps = [(b[0] - a[1], i) for i, (a, b) in enumerate(zip(merged, merged[1:], strict=False))]
        at = min(gaps)[1]
        merged[at : at + 2] = [(merged[at][0], merged[at + 1][1])]
    return merged


def around(minx: float, miny: float, maxx: float, maxy: float, classes: list[int]) -> Column:
    """Rows of these classes that may meet the box, as comparisons on class and place."""
    tests = []
    for power in classes:
        reach = 2.0**power / 2 if power > LEAST_CLASS else SIDE
        if power == WIDEST_CLASS:  # holds all that is wider, too
            tests.append(F.col(CLASS) == power)
            continue
        ranges = code_ranges(minx - reach, miny - reach, maxx + reach, maxy + reach)
        near = reduce(lambda a, b: a | b, [F.col(CODE).between(*r) for r in ranges])
        tests.append((F.col(CLASS) == power) & near)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def read_around(spark: SparkSession, path: str, minx: float, miny: float, maxx: float, maxy: float,
                ) -> DataFrame:
    """The rows of a table written by place that may meet the box.

    One scan per class in use, since each has ranges of its own.
    """
    table = spark.read.parquet(path)
    classes = [r[0] for r in table.select(CLASS).distinct().collect() if r[0] is not None]
    found = [table.where(around(minx, miny, maxx, maxy, [power])) for power in sorted(classes)]
    empty = table.where(F.lit(False))
    return reduce(DataFrame.unionByName, found, empty).drop(CLASS, CODE)
