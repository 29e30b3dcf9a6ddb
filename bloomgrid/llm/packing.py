"""Packing token sequences into windows: bounded-space online best fit, leftovers merged in a tree.

A task keeps a fixed number of open windows. A document's whole windows are closed at once; what
is left of it goes into the open window it fills best. When none has room and all windows are
open, the fullest is emitted: with padding where only `slack` places or fewer are free, otherwise
filled with the head of the document, whose rest is placed on.

Every task leaves at most `open_windows` windows. They are merged in groups of FAN tasks, groups
of groups and so on, each group by the same rule over whole windows, longest first; what a group
holds is bounded by FAN x open_windows windows whatever the size of the table. The last group
closes all: the emptiest windows fill up the fullest, and the last window is cut to powers of two,
which need no padding.

A NULL or empty text is a document of one id, the end token. Documents are rows: doc_id may be
NULL or repeated, and each row's ids are packed. An empty table gives no piece. Further columns are
not used. The pieces depend on the order and the partitions of the rows; what always holds is that
each id of each row lies in exactly one piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import piece_ids, wordbpe
from bloomgrid.llm.batches import gathered, keep_batches_small
from bloomgrid.session import cut_lineage

#: Groups of this many tasks (or groups) are merged by one task.
FAN = 16
#: Pieces that are sent on in one Arrow batch.
BATCH = 2_000
ID_BYTES = 4
#: Texts are encoded in slices of about this many bytes, whose pieces are looked up together.
SLICE_BYTES = 8 << 20
#: The id behind each document, packed.
END = (1).to_bytes(ID_BYTES, "little")

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, lane long"
)
ARROW = pa.schema([
    (name, pa.binary() if kind == "binary" else pa.int64())
    for name, kind in (x.split() for x in SCHEMA.split(", "))
])

#: (doc_id, start, packed ids, doc_tokens)
Piece = tuple[int | None, int, bytes, int]


def tokens(item: list[Piece]) -> int:
    return sum(len(piece[2]) for piece in item) // ID_BYTES


def cut(item: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first `at` ids of an item, and the rest."""
    head, at = [], at * ID_BYTES
    for place, (doc_id, start, ids, total) in enumerate(item):
        if len(ids) > at:
            rest = [(doc_id, start + at // ID_BYTES, ids[at:], total), *item[place + 1 :]]
            return ([*head, (doc_id, start, ids[:at], total)] if at else head), rest
        head.append(item[place])
        at -= len(ids)
    return head, []


class Windows:
    """Open windows of a task; emitted ones wait in `ready` as rows."""

    def __init__(self, size: int, most: int, slack: int, first_id: int):
        self.size, self.most, self.slack, self.next_id = size, most, slack, first_id
        self.room: list[tuple[int, int]] = []  # (free places, window), least first
        self.held: dict[int, list[Piece]] = {}
        self.ready: list[tuple] = []

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def rows(self, item: list[Piece], sequence: int, lane: int | None) -> None:
        at = 0
        for doc_id, start, ids, total in item:
            length = len(ids) // ID_BYTES
            self.ready.append((doc_id, start, length, ids, total, sequence, at, lane))
            at += length

    def emit(self, place: int) -> None:
        window = self.room.pop(place)[1]
        self.rows(self.held.pop(window), window, None)

    def add(self, place: int, item: list[Piece], length: int) -> None:
        free, window = self.room.pop(place)
        self.held[window] += item
        insort(self.room, (free - length, window))
        if free == length:
            self.emit(0)

    def place(self, item: list[Piece], length: int) -> None:
        """Best fit; without a fit a new window, or the fullest goes."""
        while length:
            fit = bisect_left(self.room, (length, -1))
            if fit < len(self.room):
                self.add(fit, item, length)
                return
            if len(self.room) < self.most:
                window = self.new_id()
                self.held[window] = []
                self.room.append((self.size, window))
            elif self.room[0][0] <= self.slack:
                self.emit(0)
            else:
                free = self.room[0][0]
                head, item = cut(item, free)
                self.add(0, head, free)
                length -= free

    def document(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // ID_BYTES, self.size * ID_BYTES
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            piece = (doc_id, at // ID_BYTES, ids[at : at + step], total)
            self.rows([piece], self.new_id(), None)
        if whole < len(ids):
            piece = (doc_id, whole // ID_BYTES, ids[whole:], total)
            self.place([piece], total - whole // ID_BYTES)

    def leave(self, lane: int) -> None:
        """The open windows go on to the group that merges this lane."""
        for _, window in self.room:
            self.rows(self.held.pop(window), window, lane)
        self.room = []

    def close(self) -> None:
        """Emit all: the emptiest fill up the fullest, the last is cut to powers of two."""
        while len(self.room) > 1:
            free = self.room[0][0]
            if free <= self.slack:
                self.emit(0)
                continue
            given, window = self.room.pop()
            taken = min(free, self.size - given)
            head, rest = cut(self.held.pop(window), taken)
            self.add(0, head, taken)
            if rest:
                self.held[window] = rest
                insort(self.room, (given + taken, window))
        if not self.room:
            return
        free, window = self.room.pop()
        rest, length = self.held.pop(window), self.size - free
        if free <= self.slack:
            self.rows(rest, window, None)
            return
        while length:
            part = 1 << (length.bit_length() - 1)
            head, rest = cut(rest, part)
            self.rows(head, self.new_id(), None)
            length -= part

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        """What is ready, in batches, once there are `least` rows."""
        if len(self.ready) < least:
            return
        rows, self.ready = self.ready, []
        for at in range(0, len(rows), BATCH):
            columns = zip(*rows[at : at + BATCH], strict=True)
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW
            )


def first_id(level: int, lane: int) -> int:
    """Where the sequence ids of a task begin: no two tasks of any level share ids."""
    return (level << 58) + (lane << 32)


def packer(path: str, size: int, most: int, slack: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        windows = Windows(size, most, slack, first_id(0, lane))
        encoder = piece_ids.pieces(path)
        for piece in gathered(batches, "text", SLICE_BYTES):
            ids, borders = encoder.encoded(piece.column("text"))
            packed, borders = ids.tobytes(), (borders * ID_BYTES).tolist()
            for key, start, end in zip(
                piece.column("doc_id").to_pylist(), borders, borders[1:], strict=False
            ):
                windows.document(key, packed[start:end] + END)
            yield from windows.batches(BATCH)
        windows.leave(lane)
        yield from windows.batches(1)

    return run


def merger(level: int, last: bool, size: int, most: int, slack: int) -> Callable:
    """Merges the windows of one group of lanes; the last group closes all of them."""

    def run(table: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        rows = table.to_pydict()
        lane = rows["lane"][0]
        for *piece, window, at in zip(
            rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"],
            rows["sequence_id"], rows["offset"], strict=True,
        ):
            held.setdefault(window, []).append((at, tuple(piece)))
        items = [[p for _, p in sorted(x, key=lambda y: y[0])] for _, x in sorted(held.items())]
        windows = Windows(size, most, slack, first_id(level, lane))
        for length, item in sorted(((tokens(x), x) for x in items), key=lambda y: -y[0]):
            windows.place(item, length)
        if last:
            windows.close()
        else:
            windows.leave(lane)
        return pa.Table.from_batches(windows.batches(0), ARROW)

    return run


def pack(documents: DataFrame, size: int = 2048, open_windows: int = 32, slack: int = 8,
         path: str | None = None) -> DataFrame:
    """Pieces of documents and where they lie.

    doc_id, start (ids of the document before the piece), length, ids (packed little-endian 32-bit
    integers), doc_tokens (the document's ids, end token included), sequence_id, offset (place in
    the sequence). A sequence with fewer than `size` ids is to be padded, unless its length is a
    power of two.
    """
    path = path or wordbpe.default_path()
    keep_batches_small(documents.sparkSession)
    made = documents.select("doc_id", "text").mapInArrow(
        packer(path, size, open_windows, slack), SCHEMA
    )
    made = cut_lineage(made)
    done = made.where("lane IS NULL")
    lanes = made.agg(F.max("lane")).first()[0]
    rest, level = made.where("lane IS NOT NULL"), 0
    while lanes is not None:
        level, last = level + 1, lanes < FAN
        grouped = rest.withColumn("lane", F.floor(F.col("lane") / FAN)).groupBy("lane")
        made = cut_lineage(
            grouped.applyInArrow(merger(level, last, size, open_windows, slack), SCHEMA)
        )
        done = done.unionByName(made.where("lane IS NULL"))
        rest, lanes = made.where("lane IS NOT NULL"), None if last else lanes // FAN
    return done.drop("lane")
