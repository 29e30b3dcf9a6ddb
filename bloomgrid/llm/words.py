"""Words of many texts at once, found and hashed on their UTF-8 bytes.

Separators are ASCII in every contract used here, and no byte of a longer UTF-8 sequence is
ASCII, so words can be cut on bytes. A word's 64-bit hash is a polynomial over random byte
values, taken from running sums; windows of words combine word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
PLACE_VALUES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: str) -> np.ndarray:
    """A table that is True for bytes of words, given the separating ASCII characters."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators.encode("ascii"), np.uint8)] = False
    return table


#: Words [^\x20\x09-\x0D]+
SPACED = byte_class(" \t\n\x0b\x0c\r")
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
PLAIN = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> U(32))
    values = values * U(0xD6E8FEB86659FD93)
    values = values ^ (values >> U(32))
    values = values * U(0xD6E8FEB86659FD93)
    return values ^ (values >> U(32))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: np.uint64) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return series(BASE), series(BASE_INVERSE)


@dataclass
class Words:
    """Words in text order: byte borders, row of each, and the row borders in this list."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    borders: np.ndarray
    hashes: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.diff(self.borders)


def find(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    """All words of the rows whose bytes lie between consecutive offsets."""
    size = len(raw)
    if lower:
        raw = LOWER[raw]
    inside = table[raw]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    borders = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(borders))
    room = 1 << max(18, int(size + 1).bit_length())
    powers, inverse = _powers(room)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * powers[:size], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    return Words(starts, ends, rows, borders, hashes)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a row, and the borders of each row's runs."""
    count = len(words.hashes) - width + 1
    per_row = np.maximum(words.per_row() - width + 1, 0)
    borders = np.concatenate(([0], np.cumsum(per_row)))
    if count <= 0:
        return np.empty(0, np.uint64), borders
    total = np.zeros(count, np.uint64)
    for place in range(width):
        total += words.hashes[place : place + count] * PLACE_VALUES[place]
    keep = words.rows[:count] == words.rows[width - 1 :]
    return mixed(total[keep]), borders


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), but a row of fewer words (not none) has its whole sequence as one run."""
    runs, borders = windows(words, width)
    per_row = words.per_row()
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if not len(short):
        return runs, borders
    whole = np.zeros(len(short), np.uint64)
    for place in range(width - 1):
        has = per_row[short] > place
        at = words.borders[:-1][short[has]] + place
        whole[has] += words.hashes[at] * PLACE_VALUES[place]
    whole = mixed(whole + per_row[short].astype(np.uint64) * PLACE_VALUES[63])
    runs = np.insert(runs, borders[short], whole)
    counts = np.diff(borders)
    counts[short] = 1
    return runs, np.concatenate(([0], np.cumsum(counts)))
