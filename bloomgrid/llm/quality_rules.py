"""Quality rules: word and line statistics, and divergence from language references.

Words are [^\\x20\\x09-\\x0D]+. Base statistics per text: n_words; word_chars, the code points in
words; n_symbols, characters of [#*$%&|<>]; n_dup_lines, \\n-split lines with a word that equal an
earlier line of the text; n_repeat_words, words inside 8-word windows found twice or more.

The method compares two histograms of a text with references of each language: shares of
character classes, and shares of hashed word slots among the language's common ones. References
come from all documents with a language that pass the base rules. For words they are sums; for
character classes geometric means over documents of MIN_CHARS and more, so that a minority of junk
does not move them. The Jensen-Shannon distances (base 2) to the nearest language decide; texts
of fewer than MIN_CHARS characters or MIN_WORDS words are too short for the respective comparison
and pass it.

NULL and empty texts have no words and fail the base rule. Rows with NULL doc_id or repeated rows
are judged like any other. Without any reference (an empty table) only base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import words
from bloomgrid.llm.batches import keep_batches_small, map_texts, slices, text_buffers

SLOTS = 4096
COMMON = 64
MIN_WORDS, MIN_CHARS = 100, 300
LEAST_SHARE = 1e-4
#: Largest distances of an accepted text to the nearest language's references.
CLASS_DISTANCE, WORD_DISTANCE = 0.28, 0.40

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: Character classes by byte; bytes that continue a character are not counted.
CLASSES = 9
CLASS_OF_BYTE = np.full(256, 8, np.uint8)  # other ASCII
CLASS_OF_BYTE[97:123] = 0
CLASS_OF_BYTE[np.frombuffer(b"aeiou", np.uint8)] = 1
CLASS_OF_BYTE[65:91] = 2
CLASS_OF_BYTE[48:58] = 3
CLASS_OF_BYTE[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 4
CLASS_OF_BYTE[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 5
CLASS_OF_BYTE[np.frombuffer(b"#*$%&|<>", np.uint8)] = 6
CLASS_OF_BYTE[192:] = 7
CONTINUED = np.arange(256) & 0xC0 == 0x80


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_statistics(raw: np.ndarray, offsets: np.ndarray, found: words.Words) -> dict:
    """The base statistics of each row, as arrays."""
    inside = words.SPACED[raw] & ~CONTINUED[raw]
    runs, borders = words.windows(found, 8)
    repeats = np.zeros(len(offsets) - 1, np.int64)
    for row in np.flatnonzero(np.diff(borders) > 1):
        own = runs[borders[row] : borders[row + 1]]
        ordered = np.argsort(own, kind="stable")
        same = own[ordered][1:] == own[ordered][:-1]
        if same.any():
            twice = np.zeros(len(own) + 8, np.int64)
            hit = np.zeros(len(own), bool)
            hit[ordered[1:][same]] = True
            hit[ordered[:-1][same]] = True
            at = np.flatnonzero(hit)
            twice[at] += 1
            twice[at + 8] -= 1
            repeats[row] = np.count_nonzero(np.cumsum(twice))
    return {
        "n_words": found.per_row(),
        "word_chars": row_sums(inside, offsets),
        "n_symbols": row_sums(SYMBOLS[raw], offsets),
        "n_dup_lines": repeated_lines(raw, offsets),
        "n_repeat_words": repeats,
    }


def repeated_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(offsets) - 1, np.int64)
    content = raw.tobytes()
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        lines = content[start:end].split(b"\n")
        if len(lines) > 1:
            told = [line for line in lines if line.strip(b" \t\x0b\x0c\r")]
            counts[row] = len(told) - len(set(told))
    return counts


def histograms(raw, offsets, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and word slots of each row."""
    rows = len(offsets) - 1
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    counted = ~CONTINUED[raw]
    cell = row_of_byte[counted] * CLASSES + CLASS_OF_BYTE[raw[counted]]
    classes = np.bincount(cell, minlength=rows * CLASSES).reshape(rows, CLASSES)
    return classes, (found.hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def log_shares(classes: np.ndarray) -> np.ndarray:
    """Logarithms of class shares, in millionths; a class that is missing counts as LEAST_SHARE."""
    shares = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    return np.rint(np.log(np.maximum(shares, LEAST_SHARE)) * 1e6).astype(np.int64)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def references(documents: DataFrame) -> DataFrame:
    """lang, kind, place, n: per language, sums of the log shares of the classes with the number of
    documents as last place ('class'), and of word slots ('slot'). All are whole numbers.

    Tasks add up their own documents, so what is shuffled is bounded per task and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, offsets = text_buffers(piece.column("text"))
                found = words.find(raw, offsets, words.SPACED, lower=False)
                facts = base_statistics(raw, offsets, found)
                good = ~base_failed(facts["n_words"], facts["n_repeat_words"])
                classes, slots = histograms(raw, offsets, found)
                logs = log_shares(classes)
                for row, lang in enumerate(piece.column("lang").to_pylist()):
                    if lang is None or not good[row]:
                        continue
                    a, b = sums.setdefault(lang, (np.zeros(CLASSES + 1, int), np.zeros(SLOTS, int)))
                    if classes[row].sum() >= MIN_CHARS:
                        a[:CLASSES] += logs[row]
                        a[CLASSES] += 1
                    own = slots[found.borders[row] : found.borders[row + 1]]
                    b += np.bincount(own, minlength=SLOTS)
        for lang, (a, b) in sums.items():
            both = np.concatenate((a, b))
            yield pa.record_batch(
                [
                    pa.array([lang] * len(both)),
                    pa.array(["class"] * (CLASSES + 1) + ["slot"] * SLOTS),
                    pa.array([*range(CLASSES + 1), *range(SLOTS)], pa.int32()),
                    pa.array(both, pa.int64()),
                ],
                names=["lang", "kind", "place", "n"],
            )

    known = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    keep_batches_small(documents.sparkSession)
    parts = known.mapInArrow(run, "lang string, kind string, place int, n long")
    return parts.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n"))


def nearest_distances(classes, slots, borders, known) -> tuple[np.ndarray, np.ndarray]:
    """Jensen-Shannon distances to the language with the least sum of both."""
    rows = len(classes)
    best = np.full((2, rows), np.inf)
    counted = np.zeros((rows, SLOTS))
    for row in range(rows):
        counted[row] = np.bincount(slots[borders[row] : borders[row + 1]], minlength=SLOTS)
    for class_share, common, word_share in known:
        first = distance(classes, class_share)
        inside = counted[:, common]
        rest = counted.sum(axis=1, keepdims=True) - inside.sum(axis=1, keepdims=True)
        second = distance(np.concatenate((inside, rest), axis=1), word_share)
        nearer = first + second < best.sum(axis=0)
        best[0, nearer], best[1, nearer] = first[nearer], second[nearer]
    return best[0], best[1]


def distance(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row's shares to the given ones."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(share > 0, share * np.log2(share / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def known_languages(frame: DataFrame) -> list[tuple]:
    """References as shares: classes, places of the COMMON most frequent slots, their shares.

    Reads at most CLASSES + 1 + COMMON rows of each language.
    """
    top = F.slice(
        F.sort_array(F.collect_list(F.struct("n", "place")), asc=False), 1,
        F.when(F.first("kind") == "class", F.lit(CLASSES + 1)).otherwise(F.lit(COMMON)),
    )
    rows = frame.groupBy("lang", "kind").agg(top.alias("top"), F.sum("n").alias("n")).collect()
    by = {(row.lang, row.kind): row for row in rows}
    found = []
    for lang in sorted({row.lang for row in rows}):
        sums = {x.place: x.n for x in by[lang, "class"].top}
        slots = by[lang, "slot"]
        if not sums[CLASSES] or not slots.n:
            continue
        share = np.exp([sums[k] / sums[CLASSES] / 1e6 for k in range(CLASSES)])
        common = np.array([x.place for x in slots.top])
        counts = np.array([x.n for x in slots.top], float)
        word_share = np.append(counts, slots.n - counts.sum()) / slots.n
        found.append((share / share.sum(), common, word_share))
    return found


class Judge:
    """Judges slices of texts against the known languages."""

    def __init__(self, known: list[tuple]):
        self.known = known

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        raw, offsets = text_buffers(column)
        found = words.find(raw, offsets, words.SPACED, lower=False)
        facts = base_statistics(raw, offsets, found)
        failed = base_failed(facts["n_words"], facts["n_repeat_words"])
        told = {name: pa.array(values, pa.int64()) for name, values in facts.items()}
        none = pa.nulls(len(failed), pa.float64())
        if not self.known:
            return told | {
                "base_failed": pa.array(failed), "kept": pa.array(~failed),
                "class_distance": none, "word_distance": none,
            }
        classes, slots = histograms(raw, offsets, found)
        first, second = nearest_distances(classes, slots, found.borders, self.known)
        unlike = (classes.sum(axis=1) >= MIN_CHARS) & (first > CLASS_DISTANCE)
        unlike |= (facts["n_words"] >= MIN_WORDS) & (second > WORD_DISTANCE)
        return told | {
            "base_failed": pa.array(failed), "kept": pa.array(~failed & ~unlike),
            "class_distance": pa.array(first), "word_distance": pa.array(second),
        }


def judged(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, base statistics, base_failed, kept, class_distance, word_distance."""
    judge = Judge(known_languages(references(documents)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = judge(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), *told.values()], names=["doc_id", *told])

    return map_texts(
        documents.select("doc_id", "text"),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, "
        "word_distance double",
        run,
    )


def accepted(documents: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    judge = Judge(known_languages(references(documents)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(judge(batch.column("text"))["kept"])

    return map_texts(documents, documents.schema, run)
