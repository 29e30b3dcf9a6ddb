"""The word-BPE tokenizer file, loaded once per process, and what is known about its words.

Its model works inside pre-tokens, and no pre-token, normalisation step or special string
reaches over ASCII white space. So the encoding of a text is the encodings of its pieces between
ASCII white space, one after the other.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

PIECES = re.compile(r"[^ \t-\r]+")
#: Texts of these characters are normalised by lower-casing alone (their letters are composed).
SIMPLE = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: The tokenizer file's own pre-token pattern, written for those characters.
SIMPLE_UNITS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
    r"|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
)
#: Encoded units that a process keeps, in each of two generations.
KEPT_UNITS = 60_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(token.content for token in load(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def token_strings(path: str) -> list[str]:
    tokenizer = load(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]


def units(path: str, text: str) -> list[str]:
    """The text's pre-tokens in order; a piece that holds a special string is one unit.

    Encoding the text is encoding its units one by one.
    """
    special = special_strings(path)
    marked = any(x in text for x in special)
    if not marked and SIMPLE.fullmatch(text):
        return SIMPLE_UNITS.findall(text.lower())
    tokenizer, letters, found = load(path), byte_letters(), []
    for piece in PIECES.findall(text):
        if marked and any(x in piece for x in special):
            found.append(piece)
        elif SIMPLE.fullmatch(piece):
            found += SIMPLE_UNITS.findall(piece.lower())
        else:
            normal = tokenizer.normalizer.normalize_str(piece)
            for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                found.append(bytes(letters[x] for x in part).decode("utf-8"))
    return found


def merged(path: str, unit: str) -> list[int]:
    """Ids of one unit: the model's merges, or the whole library for a special string."""
    tokenizer = load(path)
    if any(x in unit for x in special_strings(path)):
        return tokenizer.encode(unit, add_special_tokens=False).ids
    letters = unit.encode("utf-8").decode("latin-1").translate(LETTER_OF_BYTE)
    return [token.id for token in tokenizer.model.tokenize(letters)]


class Kept(dict):
    """Results by key, made when first asked for and kept within a bound.

    When a generation has reached `most` (in the weight of its keys), it becomes the older one
    and the one before is let go; what is asked for again moves to the new one.
    """

    def __init__(self, make, most: int, weigh=lambda key: 1):
        super().__init__()
        self.make, self.most, self.weigh = make, most, weigh
        self.older: dict = {}
        self.weight = 0

    def __missing__(self, key):
        found = self.older[key] if key in self.older else self.make(key)
        if self.weight >= self.most:
            self.older = dict(self)
            self.clear()
            self.weight = 0
        self[key] = found
        self.weight += self.weigh(key)
        return found


@lru_cache(maxsize=2)
def store(path: str) -> Kept:
    """Packed ids (32-bit integers) of units."""

    def packed(unit: str) -> bytes:
        ids = merged(path, unit)
        return struct.pack(f"={len(ids)}i", *ids)

    return Kept(packed, KEPT_UNITS)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Texts proved to be encoded alone as the one token that spells them.

    Every vocabulary string that ends a word is spelled out and encoded alone; it counts only if
    the library returns that single token for it.
    """
    tokenizer = load(path)
    end = tokenizer.model.end_of_word_suffix or ""
    spelled = byte_letters()
    candidates = []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(end):
            letters = token[: len(token) - len(end)]
            try:
                text = bytes(spelled[x] for x in letters).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text:
                candidates.append((number, text))
    found = tokenizer.encode_batch_fast([x[1] for x in candidates], add_special_tokens=False)
    return frozenset(
        text
        for (number, text), result in zip(candidates, found, strict=True)
        if result.ids == [number]
    )


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that byte-level tokenizers write for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, get the
    characters from U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTER_OF_BYTE = {byte: letter for letter, byte in byte_letters().items()}
