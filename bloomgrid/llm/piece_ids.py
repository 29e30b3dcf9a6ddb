"""Token ids of many texts at once for a word-BPE file, by pieces between ASCII white space.

The encoding of a text is the encodings of its pieces one after the other (see wordbpe). A slice
of texts is split into pieces by Arrow, which also tells the distinct ones; a process remembers
the ids of pieces and words in Arrow arrays, within a bound, and only those it has not met go
through the merges: the words are columns of one matrix of symbols, and each step merges the
lowest-ranked, leftmost pair of every word, as the model itself does. Words too long for that, and
pieces that are not simple text, are left to the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bloomgrid.llm import wordbpe
from bloomgrid.llm.kept import KEYS, Generation, joined, known, string_buffers, upto

#: Pieces whose ids a process keeps, in each of two generations; as many words.
KEPT_PIECES = 500_000
#: Bytes of words that are merged in a matrix; longer ones are merged by the library.
WIDEST = 48
#: Words of a matrix, and the bits that tell a place in it.
WORDS = 1 << 13
PLACE_BITS = 6
NONE = np.int32(1 << 30)
#: The table of pairs has 2**TABLE_BITS places.
TABLE_BITS = 18
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SEPARATED_UNITS = re.compile(wordbpe.SIMPLE_UNITS.pattern + r"|\n")
IDS = pa.large_list(pa.int32())


class Merges:
    """The merge table of a tokenizer file: pairs of symbols, their rank and what they become."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        # no symbol has this number: it stands before, behind and instead of merged ones
        self.size = max(vocab.values()) + 1
        keys = np.array([self.key(vocab[a], vocab[b]) for a, b in pairs], np.int64)
        keys, ranks = np.unique(keys, return_index=True)
        self.table = np.full(1 << TABLE_BITS, -1, np.int64)
        self.ranks = np.zeros(1 << TABLE_BITS, np.int32)
        places = self.places(keys).tolist()
        for key, rank, place in zip(keys.tolist(), ranks.tolist(), places, strict=True):
            while self.table[place] >= 0:
                place = (place + 1) % len(self.table)
            self.table[place], self.ranks[place] = key, rank
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        letters = wordbpe.LETTER_OF_BYTE
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)

    def key(self, left, right):
        return left * (self.size + 1) + right

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        """Where the search for a pair begins in the table."""
        return (keys.astype(np.uint64) * FACTOR >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge or a side is missing (`size`)."""
        keys = self.key(left.astype(np.int64), right)
        places = self.places(keys)
        found = self.table[places]
        ranks = np.where(found == keys, self.ranks[places], NONE)
        going = np.flatnonzero((found != keys) & (found >= 0))
        while len(going):
            places[going] = (places[going] + 1) % len(self.table)
            found = self.table[places[going]]
            here = found == keys[going]
            ranks[going[here]] = self.ranks[places[going[here]]]
            going = going[~here & (found >= 0)]
        return ranks

    def coded(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        """The rank with the place of the left symbol behind it, so that the least is leftmost."""
        ranks = self.rank(left, right)
        return np.where(ranks < NONE, ranks << PLACE_BITS | place, NONE)

    def matrix(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Symbols (one row per word, `size` where none) of the words at these bytes."""
        count, width = len(starts), int(sizes.max())
        # word n has its symbols in rows 1 to its size of column n; row 0 and those behind are empty
        columns = np.arange(count)
        symbols = np.full((width + 2, count), self.size, np.int32)
        for at in range(width):
            here = columns if at < sizes.min() else np.flatnonzero(sizes > at)
            symbols[at + 1, here] = self.inner[raw[starts[here] + at]]
        symbols[sizes, columns] = self.last[raw[starts + sizes - 1]]
        after = np.repeat(np.arange(1, width + 3, dtype=np.int32)[:, None], count, axis=1)
        before = after - 2
        codes = np.full((width + 1, count), NONE, np.int32)
        for at in range(1, width):
            codes[at] = self.coded(symbols[at], symbols[at + 1], at)
        flat, flat_after, flat_before = symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
        flat_codes = codes.reshape(-1)
        while True:
            least = codes.min(axis=0)
            live = np.flatnonzero(least < NONE)
            if not len(live):
                return symbols[1:-1].T
            least = least[live]
            place = least & ((1 << PLACE_BITS) - 1)
            left = place * count + live
            right = flat_after[left].astype(np.int64) * count + live
            following = flat_after[right]
            next_one = following.astype(np.int64) * count + live
            made = self.made[least >> PLACE_BITS]
            flat[left], flat[right], flat_after[left] = made, self.size, following
            flat_before[next_one] = place
            flat_codes[right] = NONE
            flat_codes[left] = self.coded(made, flat[next_one], place)
            previous = flat_before[left]
            last_one = previous.astype(np.int64) * count + live
            flat_codes[last_one] = self.coded(flat[last_one], made, previous)

    def merged(self, words: pa.Array) -> pa.Array:
        """Ids of words of 1 to WIDEST bytes."""
        borders, raw = string_buffers(words)
        starts, sizes = borders[:-1], np.diff(borders)
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(words), np.int64)
        found = []
        for at in range(0, len(order), WORDS):
            own = order[at : at + WORDS]
            symbols = self.matrix(raw, starts[own], sizes[own])
            held = symbols < self.size
            counts[own] = held.sum(axis=1)
            found.append(symbols[held])
        # from the order of sizes to that of the words
        ids = pa.LargeListArray.from_arrays(
            upto(counts[order]), np.concatenate([np.empty(0, np.int32), *found])
        )
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids.take(pa.array(back))


def list_of(found: list[list[int]]) -> pa.Array:
    return pa.array(found, IDS)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Pieces:
    """Ids (32-bit integers) of pieces, remembered within a bound."""

    def __init__(self, path: str):
        self.path = path
        self.special = wordbpe.special_strings(path)
        self.pieces, self.older = Generation(IDS), Generation(IDS)
        self.words, self.older_words = Generation(IDS), Generation(IDS)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text, given as UTF-8."""
        ids, borders = self.encoded(pa.array([text.decode("utf-8") for text in texts], KEYS))
        borders = borders.tolist()
        return [ids[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the borders of each text's; NULL is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(KEYS))
        told = split.flatten().dictionary_encode()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.older = Generation(IDS), self.pieces
        if len(self.words) > KEPT_PIECES:
            self.words, self.older_words = Generation(IDS), self.words
        places = known(self.pieces, self.older, told.dictionary, self.learned)
        ids = self.pieces.found.take(pa.array(places[told.indices.to_numpy()]))
        pieces = np.asarray(split.offsets) - np.asarray(split.offsets)[:1]
        borders = np.asarray(ids.offsets)[pieces]
        return np.asarray(ids.flatten()), borders - borders[:1]

    def learned(self, new: pa.Array) -> pa.Array:
        """The ids of pieces."""
        text, odd = joined(new, "\n"), []
        if not wordbpe.SIMPLE.fullmatch(text) or any(x in text for x in self.special):
            pieces = new.to_pylist()
            odd = [place for place, piece in enumerate(pieces) if self.is_odd(piece)]
            library = wordbpe.load(self.path)
            by_library = list_of([
                library.encode(pieces[place], add_special_tokens=False).ids for place in odd
            ])
            for place in odd:
                pieces[place] = ""
            text = "\n".join(pieces)
        # cut as the tokenizer cuts them; a line feed is a unit without ids between two pieces
        units = pa.array(["\n", *SEPARATED_UNITS.findall(text.lower())], KEYS).dictionary_encode()
        places = known(self.words, self.older_words, units.dictionary, self.learned_words)
        codes = units.indices.to_numpy()
        ids = self.words.found.take(pa.array(places[codes]))
        starts = np.flatnonzero(codes == codes[0])
        borders = np.append(np.asarray(ids.offsets)[starts], ids.offsets[-1].as_py())
        found = pa.LargeListArray.from_arrays(borders - borders[0], ids.flatten())
        if odd:
            order = np.arange(len(new))
            order[odd] = len(new) + np.arange(len(odd))
            found = pa.concat_arrays([found, by_library]).take(pa.array(order))
        return found

    def is_odd(self, piece: str) -> bool:
        """Whether a piece that is not simple text is left to the library."""
        return not wordbpe.SIMPLE.fullmatch(piece) or any(x in piece for x in self.special)

    def learned_words(self, new: pa.Array) -> pa.Array:
        """The ids of words; a line feed has none."""
        sizes = np.diff(string_buffers(new)[0])
        feed = pc.equal(new, "\n").to_numpy(zero_copy_only=False)
        short = np.flatnonzero((sizes <= WIDEST) & ~feed)
        others = np.flatnonzero((sizes > WIDEST) | feed)
        by_library = [
            [] if word == "\n" else wordbpe.merged(self.path, word)
            for word in new.take(pa.array(others)).to_pylist()
        ]
        order = np.empty(len(new), np.int64)
        order[np.concatenate([short, others])] = np.arange(len(new))
        made = merges(self.path).merged(new.take(pa.array(short)))
        return pa.concat_arrays([made, list_of(by_library)]).take(pa.array(order))


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)
