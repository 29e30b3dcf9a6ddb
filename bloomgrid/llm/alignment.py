"""Tokens of two tokenizers side by side, scored by inverted pair bitmaps.

Tokenizer A (byte-level BPE) and B (sentencepiece BPE) cut the same bytes, a blank and the text.
Offsets where tokens of both end cut them into groups; every A token of a group is linked with
every B token of it.

*Groups.* No token of either crosses from a character that is not white space to a blank or a line
feed (B's vocabulary is searched for such a piece once per process; if it had one, texts would not
be cut). So a text's groups are those of its segments between such places. Slices of texts are cut
at once, Arrow tells their distinct segments, and a process remembers segments in Arrow arrays,
within a bound. Texts with a segment whose bytes do not come back are encoded whole.

*Inverted pair bitmaps.* Documents are numbered inside blocks of a task. For every id pair and
block there is one row with the pair's multiplicity planes: plane k is the bitmap of the documents
in whose link count bit k is set, compressed (a sorted array of 16-bit numbers where that is
shorter). The planes OR-merged are the documents that hold the pair: their popcount is its
document count, and the planes' popcounts times 2**k its links. Counts and the highest count of each A
id are joined to the rows, which then return, block by block, each document's scores.

Rows are documents: doc_id may be NULL or repeated. NULL and empty texts, and texts whose joined
token bytes differ from blank and text, have no tokens. Further columns are not used.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm.batches import gathered, keep_batches_small, slices
from bloomgrid.llm.kept import KEYS, Generation, joined, known, string_buffers, strings_at, upto
from bloomgrid.llm.wordbpe import byte_letters
from bloomgrid.session import cut_lineage

#: A block ends at this many documents, bytes of text or pairs of documents; then its rows go out.
SLOT_BITS = 16
BLOCK_DOCUMENTS = 1 << SLOT_BITS
BLOCK_BYTES = 8 << 20
BLOCK_PAIRS = 4 << 20
#: Segments that a process keeps, in each of two generations.
KEPT_SEGMENTS = 150_000
#: Segments of at most this many bytes are encoded together, so many at a time; what stands before
#: them there.
SHORT, TOGETHER = 128, 1 << 14
GUARD = " a"
#: Texts are worked on in slices of about this many bytes, and rows sent on with so much of groups.
SLICE_BYTES = 1 << 20
SENT_BYTES = 8 << 20

BLANK = "▁"
#: White space as str.isspace knows it: single bytes, and longer ones as big-endian numbers.
SPACES = np.array([i < 128 and chr(i).isspace() for i in range(256)])
WIDE_SPACES = np.array([
    int.from_bytes(chr(i).encode(), "big") for i in range(128, 0x10000)
    if chr(i).isspace()
])

#: Of a segment: groups as text with a `;` behind each, figures (A tokens, B tokens, groups, links),
#: its pairs (A id << 32 | B id) with the links of each, and whether its bytes come back.
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
FOUND = pa.struct([
    ("groups", KEYS), *[(name, pa.int64()) for name in FIGURES],
    ("pairs", pa.large_list(pa.int64())), ("links", pa.large_list(pa.int64())), ("whole", pa.bool_()),
])
#: Pairs of a document and the links of each; a pair may occur more than once.
Counted = tuple[np.ndarray, np.ndarray]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def grouped(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]):
    """Groups as ([A ids], [B ids]) between the offsets where tokens of both end."""
    found, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a).intersection(ends_b)):
        to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
        found.append((a[at_a:to_a], b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    return found


def counted(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> dict:
    """A segment of any length: its pairs are counted group by group."""
    groups = grouped(a, ends_a, b, ends_b)
    links: Counter = Counter()
    for x, y in groups:
        many = Counter(y)
        for one, times in Counter(x).items():
            for other, more in many.items():
                links[one << 32 | other] += times * more
    told = "".join(f"{','.join(map(str, x))}|{','.join(map(str, y))};" for x, y in groups)
    return {
        "groups": told, "n_a": len(a), "n_b": len(b), "n_groups": len(groups),
        "n_links": links.total(), "pairs": list(links.keys()), "links": list(links.values()),
        "whole": True,
    }


#: What is known of a segment whose bytes differ.
BROKEN = {
    "groups": "", **dict.fromkeys(FIGURES, 0), "pairs": [], "links": [], "whole": False,
}


def after_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space ends before these places of UTF-8, of which none is the first."""
    before = raw[at - 1]
    found = SPACES[before]
    wide = np.flatnonzero(before >= 128)
    two = raw[at[wide] - 2].astype(np.int64) << 8 | before[wide]
    three = raw[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16 | two
    found[wide] = np.isin(two, WIDE_SPACES) | np.isin(three, WIDE_SPACES)
    return found


class Slice:
    """Groups, figures and pairs of the texts of a slice."""

    def __init__(self, found: pa.StructArray, places: np.ndarray, of: np.ndarray, texts: int):
        """`places` has the segments of all texts in order, `of` the text of each."""
        borders = np.searchsorted(of, np.arange(texts + 1))
        told = found.field("groups").take(pa.array(places))
        starts, _ = string_buffers(told)
        groups = strings_at(starts[borders], told.buffers()[2] or pa.py_buffer(b""))
        self.groups = pc.ascii_rtrim(groups, characters=";").cast(pa.string())
        self.figures = {
            name: np.diff(upto(found.field(name).to_numpy()[places])[borders]) for name in FIGURES
        }
        # distinct segments of each text
        key, times = np.unique(of << 32 | places, return_counts=True)
        own = pa.array(key & 0xFFFFFFFF)
        pairs, links = found.field("pairs").take(own), found.field("links").take(own)
        upto_pairs = np.asarray(pairs.offsets)
        self.pairs = np.asarray(pairs.flatten())
        self.links = np.asarray(links.flatten()) * np.repeat(times, np.diff(upto_pairs))
        self.borders = upto_pairs[np.searchsorted(key >> 32, np.arange(texts + 1))].tolist()

    def counted(self, text: int) -> Counted:
        own = slice(self.borders[text], self.borders[text + 1])
        return self.pairs[own], self.links[own]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[number] = bytes(letters[x] for x in token if x in letters)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.blank = self.b.piece_to_id(BLANK)
        self.cuts = not any(
            c in BLANK + "\n" and (p[i] not in BLANK + "\n" or c == "\n")
            for p in pieces for i, c in enumerate(p[1:])
        )
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # an id with the sign behind it: between ids of a side, between sides, between groups
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.signed = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(most)], KEYS)
        self.spelled_a = pa.array(self.bytes_a, pa.large_binary())
        self.spelled_b = pa.array(self.bytes_b, pa.large_binary())
        self.kept, self.older = Generation(FOUND), Generation(FOUND)

    def segment(self, text: str) -> dict:
        """What is found of a stretch that begins with a blank or a line feed."""
        whole = text.encode("utf-8")
        a = self.a.encode(text, add_special_tokens=False).ids
        if text[0] == " ":
            b = self.b.encode(text[1:], num_threads=1)
        else:
            b = self.b.encode(text, num_threads=1)
            if b[0] != self.blank:
                return BROKEN
            b = b[1:]
        if text == " ":  # the library gives no pieces for an empty text
            b = [self.blank]
        bytes_a = [self.bytes_a[i] for i in a]
        bytes_b = [self.bytes_b[i] for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return BROKEN
        ends_a, ends_b = accumulate(map(len, bytes_a)), accumulate(map(len, bytes_b))
        return counted(a, list(ends_a), b, list(ends_b))

    def learned(self, new: pa.Array) -> pa.Array:
        """What is found of these segments."""
        borders, raw = string_buffers(new)
        short = (np.diff(borders) <= SHORT) & ~after_space(raw, borders[1:])
        others = np.flatnonzero(~short)
        short = np.flatnonzero(short)
        found = [
            self.short(new.take(pa.array(short[at : at + TOGETHER])))
            for at in range(0, len(short), TOGETHER)
        ]
        order = np.empty(len(new), np.int64)
        order[np.concatenate([short, others])] = np.arange(len(new))
        alone = [self.segment(text) for text in new.take(pa.array(others)).to_pylist()]
        return pa.concat_arrays([*found, pa.array(alone, FOUND)]).take(pa.array(order))

    def short(self, texts: pa.Array) -> pa.Array:
        """Short segments, put together and encoded in one piece: no token crosses their borders.

        Where bytes differ, the half that is at fault is found by halving.
        """
        if len(texts) < 2:
            return pa.array([self.segment(text) for text in texts.to_pylist()], FOUND)
        whole = GUARD + joined(texts, "")
        raw = whole.encode("utf-8")
        list_a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        list_b = self.b.encode(whole[1:], num_threads=1)
        a, b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = string_buffers(texts)[0]
        ends = ends - ends[0] + len(GUARD)
        common = ends_a[_among(ends_a, ends_b)]
        if (
            self.spelled_a.take(pa.array(a)).buffers()[2] != pa.py_buffer(raw)
            or self.spelled_b.take(pa.array(b)).buffers()[2] != pa.py_buffer(raw)
            or not _among(ends, common).all()
        ):
            half = len(texts) // 2
            return pa.concat_arrays([self.short(texts[:half]), self.short(texts[half:])])
        count = len(common)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        links = n_a * n_b
        group = np.repeat(np.arange(count), links)
        place = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        first_a, first_b = upto_a - n_a, upto_b - n_b
        pairs = a[first_a[group] + place // n_b[group]] << 32 | b[first_b[group] + place % n_b[group]]
        # ids of both sides in the order in which they are told, and the sign behind each
        signed, most = np.empty(len(a) + len(b), np.int64), len(self.signed) // 3
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[upto_a - 1], sign_b[upto_b - 1] = most, 2 * most
        signed[np.arange(len(a)) + (upto_b - n_b)[group_a]] = a + sign_a
        signed[np.arange(len(b)) + upto_a[group_b]] = b + sign_b
        told = self.signed.take(pa.array(signed))
        told_upto = string_buffers(told)[0][upto_a + upto_b]
        # the sums up to each border; the stretch before the first border is the guard
        last = np.searchsorted(common, ends)
        sums = (upto_a[last], upto_b[last], last + 1, np.cumsum(links)[last])
        own = slice(sums[3][0], sums[3][-1])
        borders = sums[3] - sums[3][0]
        return pa.StructArray.from_arrays([
            strings_at(told_upto[last], told.buffers()[2]),
            *[pa.array(np.diff(x)) for x in sums],
            pa.LargeListArray.from_arrays(borders, pairs[own]),
            pa.LargeListArray.from_arrays(borders, np.ones(borders[-1], np.int64)),
            pa.array(np.ones(len(texts), bool)),
        ], fields=list(FOUND))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts and the text of each; NULL and empty texts have none."""
        texts = texts.fill_null("").cast(KEYS)
        blank = pa.scalar(" ", KEYS)
        spaced = pc.binary_join_element_wise(blank, texts, pa.scalar("", KEYS))
        spaced = pc.if_else(pc.equal(texts, ""), texts, spaced)
        borders, raw = string_buffers(spaced)
        borders, raw = borders - borders[0], raw[borders[0] : borders[-1]]
        first = np.zeros(len(raw) + 1, bool)
        if self.cuts:
            signs = np.flatnonzero((raw == 32) | (raw == 10))
            signs = signs[signs > 0]
            first[signs[~after_space(raw, signs)]] = True
        first[borders] = True
        places = np.flatnonzero(first) if len(raw) else np.zeros(1, np.int64)
        of = np.searchsorted(borders, places[:-1], side="right") - 1
        return strings_at(places, pa.py_buffer(raw)), of

    def texts(self, texts: pa.Array) -> Slice:
        segments, of = self.cut(texts)
        told = segments.dictionary_encode()
        if len(self.kept) > KEPT_SEGMENTS:
            self.kept, self.older = Generation(FOUND), self.kept
        places = known(self.kept, self.older, told.dictionary, self.learned)
        places, found = places[told.indices.to_numpy()], self.kept.found
        whole = found.field("whole").to_numpy(zero_copy_only=False)[places]
        if not whole.all():
            broken = np.unique(of[~whole])
            alone = [self.segment(" " + text) for text in texts.take(pa.array(broken)).to_pylist()]
            kept = ~np.isin(of, broken)
            places = np.append(places[kept], len(found) + np.arange(len(broken)))
            found = pa.concat_arrays([found, pa.array(alone, FOUND)])
            of = np.append(of[kept], broken)
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
        return Slice(found, places, of, len(texts))

    def text(self, text: str | None) -> tuple[str, Counted]:
        """Groups of one text, and its pairs."""
        made = self.texts(pa.array([text], pa.string()))
        return made.groups[0].as_py(), made.counted(0)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones; both in order."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


SCHEMA = (
    "block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, a int, b int, size int, documents long, links long, planes array<binary>"
)
KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(),
    "array<binary>": pa.list_(pa.binary()),
}
ARROW = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


def batch_of(rows: int, columns: dict) -> pa.RecordBatch:
    """A batch of the common schema; columns that are not given are NULL."""
    made = []
    for field in ARROW:
        own = columns.get(field.name)
        if own is None:
            own = pa.nulls(rows, field.type)
        made.append(own if isinstance(own, pa.Array) else pa.array(own, field.type))
    return pa.record_batch(made, schema=ARROW)


def container(slots: np.ndarray, size: int) -> bytes:
    """Sorted document numbers below `size`: 16-bit numbers, or a bitmap where not longer."""
    if 2 * len(slots) < (size + 7) // 8:
        return slots.astype(np.uint16).tobytes()
    dense = np.zeros(size, bool)
    dense[slots] = True
    return np.packbits(dense, bitorder="little").tobytes()


def opened(body: bytes, size: int) -> np.ndarray:
    """The document numbers of a container."""
    if len(body) < (size + 7) // 8:
        return np.frombuffer(body, np.uint16).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
    return np.flatnonzero(bits[:size])


def sorted_with(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the values beside them, neither below 0."""
    bits = int(values.max()).bit_length()
    if int(keys.max()).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]
    both = np.sort(keys << bits | values)
    return both >> bits, both & ((1 << bits) - 1)


class Block:
    """Documents of a block with their pairs, until its rows go out."""

    def __init__(self, number: int):
        self.number, self.size, self.bytes, self.entries = number, 0, 0, 0
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def full(self) -> bool:
        return (
            self.size >= BLOCK_DOCUMENTS or self.bytes >= BLOCK_BYTES
            or self.entries >= BLOCK_PAIRS
        )

    def add(self, counted: Counted, length: int) -> int:
        """Take the document with these pairs; its number in the block."""
        pairs, links = counted
        self.pairs.append(pairs)
        self.links.append(links)
        self.entries += len(pairs)
        self.bytes += length
        self.size += 1
        return self.size - 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row per pair: its documents, links and planes."""
        if not self.entries:
            return
        pairs, links = np.concatenate(self.pairs), np.concatenate(self.links)
        slots = np.repeat(np.arange(self.size), [len(x) for x in self.pairs])
        self.pairs, self.links = [], []
        # one entry per pair and document, pairs as small numbers that keep their order
        many = int((pairs & 0xFFFFFFFF).max()) + 1
        key = ((pairs >> 32) * many + (pairs & 0xFFFFFFFF)) << SLOT_BITS | slots
        del pairs, slots
        key, links = sorted_with(key, links)
        firsts = np.flatnonzero(np.diff(key, prepend=-1))
        key, total = key[firsts], np.add.reduceat(links, firsts)
        number, slots = key >> SLOT_BITS, key & ((1 << SLOT_BITS) - 1)
        firsts = np.flatnonzero(np.diff(number, prepend=-1))
        ids = number[firsts] // many << 32 | number[firsts] % many
        documents = np.diff(firsts, append=len(number))
        sums = np.add.reduceat(total, firsts)
        number = np.repeat(np.arange(len(ids)), documents)
        planes = range(int(total.max()).bit_length())
        key = np.sort(np.concatenate([
            (number[held] << 6 | k) << SLOT_BITS | slots[held]
            for k in planes for held in [np.flatnonzero(total >> k & 1)]
        ]))
        of, plane = key >> SLOT_BITS + 6, key >> SLOT_BITS & 63
        held = key & ((1 << SLOT_BITS) - 1)
        starts = np.flatnonzero(np.diff(of * 64 + plane, prepend=-1))
        ends = np.append(starts[1:], len(of))
        yield from self.packed(ids, documents, sums, of, plane, held, starts, ends)

    def packed(self, ids, documents, sums, of, plane, held, starts, ends):
        # planes below a pair's highest that hold no document are empty containers
        top = np.zeros(len(ids), np.int64)
        np.maximum.at(top, of[starts], plane[starts] + 1)
        borders = np.concatenate(([0], np.cumsum(top)))
        bodies = [b""] * int(borders[-1])
        numbers = held.astype(np.uint16)
        raw, few = numbers.tobytes(), (self.size + 7) // 8
        for place, start, end in zip(
            (borders[of[starts]] + plane[starts]).tolist(), starts.tolist(), ends.tolist(),
            strict=True,
        ):
            short = 2 * (end - start) < few
            bodies[place] = (
                raw[2 * start : 2 * end] if short else container(held[start:end], self.size)
            )
        lists = pa.ListArray.from_arrays(
            pa.array(borders, pa.int32()), pa.array(bodies, pa.binary())
        )
        for at in range(0, len(ids), 20_000):
            own = slice(at, at + 20_000)
            count = len(ids[own])
            yield batch_of(count, {
                "block": np.full(count, self.number), "a": (ids[own] >> 32).astype(np.int32),
                "b": (ids[own] & 0xFFFFFFFF).astype(np.int32),
                "size": np.full(count, self.size, np.int32), "documents": documents[own],
                "links": sums[own], "planes": lists.slice(at, count),
            })


def align(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Rows of documents (`slot` is set) and of the pair index (`slot` is NULL), see SCHEMA.

    Run it once and write the result: blocks are numbered by task.
    """
    path_a, path_b = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for piece in gathered(batches, "text", SLICE_BYTES):
            made = whole.texts(piece.column("text"))
            lengths = pc.utf8_length(piece.column("text")).fill_null(0).to_pylist()
            blocks, slots = [], []
            for place, length in enumerate(lengths):
                if block.full():
                    yield from block.rows()
                    number += 1
                    block = Block(number)
                blocks.append(number)
                slots.append(block.add(made.counted(place), length))
            rows = batch_of(piece.num_rows, {
                "block": blocks, "slot": slots, "doc_id": piece.column("doc_id"),
                **made.figures, "groups": made.groups,
            })
            yield from slices(rows, "groups", SENT_BYTES)
        yield from block.rows()

    keep_batches_small(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, documents (how many hold the pair linked), links, over the whole index."""
    return index.groupBy("a", "b").agg(
        F.sum("documents").alias("documents"), F.sum("links").alias("links")
    )


def with_counts(index: DataFrame) -> DataFrame:
    """Index rows with the pair's document count and whether it is the highest of its A id."""
    counts = pair_counts(index).select("a", "b", F.col("documents").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    told = counts.join(highest, "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    return index.select("block", "a", "b", "size", "planes").join(told, ["a", "b"])


def returned(table: pa.Table) -> pa.Table:
    """Scores of a block's documents from its index rows."""
    size = table.column("size")[0].as_py()
    counts = table.column("count").to_numpy()
    best = table.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
    planes = table.column("planes").combine_chunks()
    borders = planes.offsets.to_numpy()
    bodies = planes.flatten()
    widths = np.diff(borders)
    row = np.repeat(np.arange(len(widths)), widths)
    factor = np.int64(1) << (np.arange(len(row)) - np.repeat(borders[:-1] - borders[0], widths))
    sizes = np.asarray(pa.compute.binary_length(bodies).to_numpy(zero_copy_only=False), np.int64)
    dense = sizes >= (size + 7) // 8
    for at in np.flatnonzero(dense).tolist():
        slots = opened(bodies[at].as_py(), size)
        count_sum[slots] += factor[at] * counts[row[at]]
        n_best[slots] += factor[at] * best[row[at]]
    listed = np.flatnonzero(~dense)
    joined = b"".join(bodies.take(pa.array(listed)).to_pylist())
    slots = np.frombuffer(joined, np.uint16)
    each = np.repeat(listed, sizes[listed] // 2)
    np.add.at(count_sum, slots, factor[each] * counts[row[each]])
    np.add.at(n_best, slots, factor[each] * best[row[each]])
    return pa.table({
        "block": pa.array(np.full(size, table.column("block")[0].as_py())),
        "slot": pa.array(np.arange(size, dtype=np.int32)),
        "n_best": pa.array(n_best), "count_sum": pa.array(count_sum),
    })


def scored(documents: DataFrame, paths: tuple[str, str] | None = None,
           stored: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each document.

    groups: `a1,a2|b1;a3|b2,b3` in order. `stored` may shorten it before it is written.
    """
    whole = align(documents, paths).withColumn("groups", stored(F.col("groups")))
    whole = cut_lineage(whole)
    index = whole.where("slot IS NULL").select(
        "block", "a", "b", "size", "documents", "links", "planes"
    )
    scores = with_counts(index).groupBy("block").applyInArrow(
        returned, "block long, slot int, n_best long, count_sum long"
    )
    figures = ("n_a", "n_b", "n_groups", "n_links", "groups")
    rows = whole.where("slot IS NOT NULL").select("block", "slot", "doc_id", *figures)
    return rows.join(scores, ["block", "slot"], "left").select(
        "doc_id", *figures, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_best", "count_sum")]
    )
