"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last WINDOW bytes meets a condition, so that passages
shared by documents give the same chunks wherever they stand. A process encodes each chunk once
(up to a bound on what it keeps) and reuses it for every later document.

A join may cut a word. The two parts around it are put together and encoded again, together with
one whole word on each side. The repair ends when the outer words come out with exactly the ids
that their chunks had; should they not, the word is encoded alone. Its ends are white space, over
which the tokenizer never reaches (see wordbpe), so the result agrees exactly with encoding the
text in one piece.

NULL and empty texts have no ids and decode to an empty text; doc_id may be NULL or repeated,
other columns are not used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bloomgrid.llm import wordbpe
from bloomgrid.llm.batches import map_texts, text_buffers

WINDOW = 32
#: A cut needs this many zero bits: chunks of about 512 bytes.
ZERO_BITS = 9
#: Bytes of chunks that a process keeps, in each of two generations.
KEPT_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"

_rng = np.random.default_rng(496)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Byte positions that start a new chunk: the WINDOW bytes before each decide."""
    rolled = GEAR[raw]
    width = 1
    while width < WINDOW:
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width) if width < len(rolled) else 0
        rolled, width = longer, width * 2
    found = np.flatnonzero((rolled >> np.uint32(32 - ZERO_BITS)) == 0) + 1
    found = found[(found >= WINDOW) & (found < len(raw))]
    return found[(raw[found] & 0xC0) != 0x80]  # never inside a character


@dataclass(slots=True)
class Chunk:
    """A chunk's ids (packed), with the words at its two ends that a join may have cut.

    `first` and `last` are the outermost words that are whole inside the chunk, with their ids.
    A chunk without white space is only a head.
    """

    head: str
    first: tuple[str, bytes] | None
    inner: bytes
    last: tuple[str, bytes] | None
    tail: str
    spaced: bool


class Encoder:
    """Encodes texts chunk by chunk; `made` and `asked` count chunks, `repaired` joins."""

    def __init__(self, path: str):
        self.path = path
        self.store = wordbpe.store(path)
        self.chunks = wordbpe.Kept(self.encoded, KEPT_BYTES, len)
        self.made = self.asked = self.repaired = 0

    def words(self, text: str) -> bytes:
        """Packed ids of a text that no join cuts."""
        return b"".join(map(self.store.__getitem__, wordbpe.units(self.path, text)))

    def encoded(self, content: bytes) -> Chunk:
        self.made += 1
        text = content.decode("utf-8")
        borders = BORDERS.search(text)
        if not borders:
            return Chunk(text, None, b"", None, "", False)
        head = text[: borders.start()]
        end = max(text.rfind(x) for x in SPACE) + 1
        inner, tail = text[len(head) : end], text[end:]
        first = PIECES.search(inner)
        stripped = inner.rstrip(SPACE)
        last = stripped[max(stripped.rfind(x) for x in SPACE) + 1 :]
        return Chunk(
            head,
            (first[0], self.words(first[0])) if first else None,
            self.words(inner),
            (last, self.words(last)) if last else None,
            tail,
            True,
        )

    def joined(self, word: str, left: Chunk | None, right: Chunk | None) -> bytes:
        """Ids of a word put together over a join, checked against its whole neighbours."""
        before, after = left.last if left else None, right.first if right else None
        self.repaired += 1
        text = " ".join(x for x in (before and before[0], word, after and after[0]) if x)
        found = self.words(text)
        start = len(before[1]) if before else 0
        end = len(found) - (len(after[1]) if after else 0)
        agrees = (not before or found[:start] == before[1]) and (
            not after or found[end:] == after[1]
        )
        return found[start:end] if agrees else self.words(word)

    def text(self, content: bytes, borders: list[int]) -> np.ndarray:
        ids: list[bytes] = []
        word, left = "", None
        for start, end in zip(borders, borders[1:], strict=False):
            self.asked += 1
            chunk = self.chunks[content[start:end]]
            word += chunk.head
            if chunk.spaced:
                if word:
                    ids.append(self.joined(word, left, chunk))
                ids.append(chunk.inner)
                word, left = chunk.tail, chunk
        if word:
            ids.append(self.joined(word, left, None))
        return np.frombuffer(b"".join(ids), np.int32)


BORDERS = re.compile(r"[ \t-\r]")
PIECES = wordbpe.PIECES


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batch(path: str, column: pa.Array) -> list[np.ndarray]:
    """The ids of each text."""
    raw, offsets = text_buffers(column)
    whole, made = encoder(path), []
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        own = raw[start:end]
        borders = [0, *cuts(own).tolist(), len(own)] if len(own) else [0]
        made.append(whole.text(own.tobytes(), borders))
    return made


def decode(path: str, ids: np.ndarray) -> str:
    """What the tokenizer's decode gives: it has no decoder, so token strings with blanks."""
    return " ".join(map(wordbpe.token_strings(path).__getitem__, ids.tolist()))


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded (the text decoded from ids)."""
    path = path or wordbpe.default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = encode_batch(path, batch.column("text"))
        borders = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
        flat = np.concatenate(made) if made else np.empty(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))
        decoded = pa.array([decode(path, x) for x in made], pa.string())
        return pa.record_batch(
            [batch.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"]
        )

    return map_texts(
        documents.select("doc_id", "text"), "doc_id long, ids array<int>, decoded string", run
    )
