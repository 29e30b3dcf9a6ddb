"""Strings that a process remembers, in Arrow arrays: a few bytes each, looked up many at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEYS = pa.large_string()


def upto(counts: np.ndarray) -> np.ndarray:
    """Borders of stretches of these lengths."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def string_buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Borders and bytes of an array of large strings without NULL."""
    _, borders, data = strings.buffers()
    borders = np.frombuffer(borders, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return borders, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def strings_at(borders: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Large strings between these borders of a buffer, which is not copied."""
    borders = np.ascontiguousarray(borders, np.int64)
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), data)


def joined(strings: pa.Array, sign: str) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)
    return pc.binary_join(whole, pa.scalar(sign, KEYS))[0].as_py()


class Generation:
    """Distinct strings and what is known of each."""

    def __init__(self, kind: pa.DataType):
        self.keys, self.found = pa.array([], KEYS), pa.array([], kind)

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: pa.Array, found: pa.Array) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.found = pa.concat_arrays([self.found, found])

    def find(self, keys: pa.Array) -> np.ndarray:
        """Where each of these strings stands; below 0 if nowhere."""
        return pc.index_in(keys, self.keys).fill_null(-1).to_numpy().astype(np.int64)


def known(own: Generation, older: Generation, keys: pa.Array,
          learned: Callable[[pa.Array], pa.Array]) -> np.ndarray:
    """Where these distinct strings stand in `own`, to which the missing ones are added."""
    places = own.find(keys)
    missing = np.flatnonzero(places < 0)
    if not len(missing):
        return places
    places[missing] = len(own) + np.arange(len(missing))
    keys = keys.take(pa.array(missing))
    order = older.find(keys) if len(older) else np.full(len(missing), -1)
    new = np.flatnonzero(order < 0)
    order[new] = len(older) + np.arange(len(new))
    found = pa.concat_arrays([older.found, learned(keys.take(pa.array(new)))])
    own.add(keys, found.take(pa.array(order)))
    return places
