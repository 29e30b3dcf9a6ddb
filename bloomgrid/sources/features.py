"""Features of GeoJSON collections of any size, read by many tasks.

Spark reads a file in byte ranges, as text cut behind every closing brace. Where a range begins
inside of the document is not known to the task that reads it, so this takes two passes. The first
tells of each range what it does to the nesting, once for a beginning inside a string and once for
one outside. These few numbers per range, in file order, give the state in which each range begins.
The second pass cuts the objects of the third level out, which is where features lie; one that
reaches over the end of its range is put together from its pieces. A task holds one feature, or
the piece of one that lies in its range.

Escapes are two ASCII characters in JSON and never lie around a closing brace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = re.compile(rb"\\.", re.DOTALL)
QUOTE, OPEN, CLOSE = ord('"'), ord("{"), ord("}")
#: What a byte does to the nesting, outside of strings.
STEP = np.zeros(256, np.int8)
STEP[[OPEN, ord("[")]] = 1
STEP[[CLOSE, ord("]")]] = -1
#: Objects that bring the nesting to this level are taken: root, list of features, feature.
LEVEL = 3

RANGE = "file string, start long"
SUMMARY = f"{RANGE}, quotes long, inner long, inner_least long, outer long, outer_least long"
PIECE = f"{RANGE}, seq long, piece long, text string, whole boolean"


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Rows of a batch that lie in one range: first, last + 1, and their text with the braces."""
    names = batch.column("file").dictionary_encode().indices.to_numpy()
    starts = batch.column("start").to_numpy()
    changes = np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1
    cuts = [0, *changes.tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        values = batch.column("value").slice(a, b - a).to_pylist()
        yield a, b, b"".join(value.encode("utf-8") + b"}" for value in values)


def _nesting(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bytes, what each does to the nesting, and whether the text ends inside a string."""
    raw = np.frombuffer(ESCAPE.sub(b"__", text), np.uint8)
    quotes = np.cumsum(raw == QUOTE) + inside
    return raw, np.where(quotes & 1, 0, STEP[raw]), int(quotes[-1] & 1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: quotes, and level and least level at its end for both beginnings."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for a, _, text in _stretches(batch) if batch.num_rows else ():
            key = (batch.column("file")[a].as_py(), batch.column("start")[a].as_py())
            states = found.setdefault(key, [0, [0, 0, 0], [1, 0, 0]])
            for state in states[1:]:
                raw, steps, inside = _nesting(text, state[0])
                level = np.cumsum(steps, dtype=np.int64) + state[1]
                state[:] = [inside, int(level[-1]), min(state[2], int(level.min()))]
            states[0] += int((raw == QUOTE).sum())
    rows = [(*key, quotes, *inner[1:], *outer[1:]) for key, (quotes, outer, inner) in found.items()]
    names = [field.split()[0] for field in SUMMARY.split(", ")]
    if rows:
        yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), names=names)


@dataclass
class _Begin:
    """How a range begins: inside a string, level, and the range of a feature that is open."""

    inside: int
    level: int
    owner: int


def _beginnings(summaries: list) -> list[tuple]:
    """(file, start, inside, level, owner) of each range, from the summaries in file order."""
    found, file, state = [], None, None
    for row in summaries:
        if row.file != file:
            file, state = row.file, _Begin(0, 0, -1)
        found.append((file, row.start, state.inside, state.level, state.owner))
        change = row.inner if state.inside else row.outer
        least = state.level + (row.inner_least if state.inside else row.outer_least)
        owner = row.start if least < LEVEL else state.owner
        state = _Begin((state.inside + row.quotes) & 1, state.level + change, owner)
    return found


class _Cutter:
    """Cuts the objects out of one range."""

    def __init__(self, file: str, start: int, begin: _Begin):
        self.file, self.start = file, start
        self.inside, self.level, self.owner = begin.inside, begin.level, begin.owner
        self.first = begin.level >= LEVEL  # the rest of what began in an earlier range
        self.open: list[bytes] | None = [] if self.first else None
        self.seq = 0

    def take(self, text: bytes) -> list[tuple]:
        raw, steps, self.inside = _nesting(text, self.inside)
        level = np.cumsum(steps, dtype=np.int64) + self.level
        self.level = int(level[-1])
        begins = np.flatnonzero((steps > 0) & (level == LEVEL) & (raw == OPEN))
        ends = np.flatnonzero((steps < 0) & (level == LEVEL - 1))
        rows, at = [], 0
        while True:
            if self.open is not None:
                end = ends[np.searchsorted(ends, at) :][:1]
                if not len(end):
                    self.open.append(text[at:])
                    return rows
                self.open.append(text[at : int(end[0]) + 1])
                rows.append(self.row(not self.first))
                self.open, self.first, at = None, False, int(end[0]) + 1
            begin = begins[np.searchsorted(begins, at) :][:1]
            if not len(begin):
                return rows
            self.open, at = [], int(begin[0])
            self.seq += 1

    def row(self, whole: bool) -> tuple:
        owner, seq = (self.owner, None) if self.first else (self.start, self.seq)
        return self.file, owner, seq, self.start, b"".join(self.open).decode("utf-8"), whole

    def rest(self) -> list[tuple]:
        return [] if self.open is None else [self.row(False)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("piece", pa.int64()),
        ("text", pa.string()), ("whole", pa.bool_()),
    ])

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    cutter = None
    for batch in batches:
        for a, _, text in _stretches(batch) if batch.num_rows else ():
            file, start, inside, level, owner = (
                batch.column(name)[a].as_py() for name in ("file", "start", "inside", "level", "owner"))
            if cutter is None or (cutter.file, cutter.start) != (file, start):
                if cutter is not None:
                    yield from told(cutter.rest())
                cutter = _Cutter(file, start, _Begin(inside, level, owner))
            yield from told(cutter.take(text))
    if cutter is not None:
        yield from told(cutter.rest())


def read_feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """Features of the collections in these files: position and text.

    position: file, byte range and number in the range, which sorts in file order. Objects of the
    third level that are no features are among them; whoever parses them tells by their `type`.
    """
    chunks = _chunks(spark, path)
    summaries = chunks.mapInArrow(_summaries, SUMMARY).orderBy("file", "start").collect()
    state = "file string, start long, inside int, level int, owner long"
    begins = spark.createDataFrame(_beginnings(summaries), state)
    # one small row per range; joined by broadcast, so that the rows of a range stay in order
    ready = chunks.join(F.broadcast(begins), ["file", "start"])
    pieces = ready.mapInArrow(_pieces, PIECE)
    whole = pieces.where("whole").select("file", "start", "seq", "text")
    # what reaches over ranges: the beginning has a number, the rest lies in the ranges behind it
    parts = F.array_sort(F.collect_list(F.struct("piece", "text")))["text"]
    joined = pieces.where("NOT whole").groupBy("file", "start").agg(
        F.max("seq").alias("seq"), F.array_join(parts, "").alias("text")
    ).where("seq IS NOT NULL")
    every = whole.unionByName(joined.select("file", "start", "seq", "text"))
    return every.select(F.struct("file", "start", "seq").alias("position"), "text")
