"""Target-distribution importance resampling over hashed word runs.

Features of a text are all runs of one to three consecutive words, joined by one blank, repeats
counted; a feature's bucket is the crc32 of its bytes modulo BUCKETS. Buckets are computed by
length-bucketed CRC matrices: the distinct features of a slice of texts are grouped by equal
length into two-dimensional byte arrays, all CRCs of a group are updated column by column, and the
buckets are scattered back to the occurrences.

Counts of the whole corpus and of the whole target give each bucket a gain, the scaled logarithm
of the ratio of smoothed shares; a text's weight is the sum of its features' gains. With Gumbel
noise from a hash of the id, the highest scores are a draw without replacement by those weights.
Ranks are given by range partitions, so no task sees more than its own range.

A NULL or empty text, or one without words, has no features, weight 0 and is never drawn. doc_id
may be NULL (its hash is that of an empty id) or repeated; rows are scored one by one, and of rows
with equal score and doc_id any order may hold. Empty tables count as no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm.batches import keep_batches_small, slices
from bloomgrid.session import cut_lineage

BUCKETS = 10_000
LONGEST_RUN = 3
#: Features of more bytes are alone in their length as a rule: zlib computes them one by one.
MATRIX_BYTES = 256
MATRIX_ROWS = 1 << 16
#: Texts are worked on in slices of about this many bytes; features of a slice are made distinct.
SLICE_BYTES = 1 << 20

#: Bytes of words stay (A-Z as a-z); all other ASCII becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def crc_matrix(features: np.ndarray) -> np.ndarray:
    """crc32 of every row of a byte matrix, column by column."""
    table = crc_table()
    state = np.full(len(features), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(features.T):
        state = (state >> np.uint32(8)) ^ table[(state ^ column) & np.uint32(0xFF)]
    return state ^ np.uint32(0xFFFFFFFF)


def crcs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the stretches of `raw`, grouped by their length."""
    found = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for size, group in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if size <= MATRIX_BYTES:
            for at in range(0, len(group), MATRIX_ROWS):
                rows = group[at : at + MATRIX_ROWS]
                found[rows] = crc_matrix(raw[starts[rows][:, None] + np.arange(size)])
        else:
            for at in group.tolist():
                found[at] = zlib.crc32(raw[starts[at] : starts[at] + size])
    return found


class Features:
    """Buckets of all features of some texts, with the row of each."""

    def __init__(self, texts: list[bytes | None]):
        split = [(text or b"").translate(WORD_BYTES).split() for text in texts]
        self.words = np.fromiter(map(len, split), np.int64, len(split))
        numbers: dict[bytes, int] = {}
        flat = [numbers.setdefault(word, len(numbers)) for words in split for word in words]
        row = np.repeat(np.arange(len(split)), self.words)
        raw = np.frombuffer(b" ".join(b" ".join(words) for words in split if words), np.uint8)
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        ids = np.array(flat, np.int64)
        ends = np.cumsum(sizes[ids] + 1) - 1
        starts = ends - sizes[ids]
        buckets, rows, key = [], [], ids
        for width in range(1, LONGEST_RUN + 1):
            count = len(ids) - width + 1
            if count <= 0:
                break
            if width > 1:  # a run is its first words' number and the last word: an exact key
                key = key[:count] * len(numbers) + ids[width - 1 :]
            _, one, key = np.unique(key, return_index=True, return_inverse=True)
            first = starts[one]
            found = crcs(raw, first, ends[one + width - 1] - first) % np.uint32(BUCKETS)
            inside = row[:count] == row[width - 1 :]
            buckets.append(found[key[inside]].astype(np.int64))
            rows.append(row[:count][inside])
        self.buckets = np.concatenate(buckets) if buckets else np.empty(0, np.int64)
        self.rows = np.concatenate(rows) if rows else np.empty(0, np.int64)


def features(batch: pa.RecordBatch) -> Features:
    return Features(batch.column("text").cast(pa.large_binary()).to_pylist())


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts by bucket. A task sends on one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                total += np.bincount(features(piece).buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    keep_batches_small(texts.sparkSession)
    counted = texts.select("text").mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain for every bucket, from the counts of corpus and target (bucket, n)."""
    spark = corpus.sparkSession
    both = (
        spark.range(BUCKETS).withColumnRenamed("id", "bucket")
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    both = cut_lineage(both)  # BUCKETS rows; the counts behind them are taken once
    all_s, all_t = map(float, both.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1.0) * F.lit(all_s + BUCKETS)) / (
        (F.col("s") + 1.0) * F.lit(all_t + BUCKETS)
    )
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(documents: DataFrame, gain: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight. `gain` has BUCKETS rows and is sent to the tasks."""
    table = np.zeros(BUCKETS, np.int64)
    for bucket, value in gain.collect():
        table[bucket] = value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                found, size = features(piece), piece.num_rows
                weight = np.zeros(size, np.int64)
                np.add.at(weight, found.rows, table[found.buckets])
                counts = np.bincount(found.rows, minlength=size)
                yield pa.record_batch(
                    [piece.column("doc_id"), *map(pa.array, (found.words, counts, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    keep_batches_small(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def gumbel(seed: int = 42) -> Column:
    """Scaled Gumbel noise of a row, from a hash of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    inner = F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))
    return F.floor(F.lit(-1000.0) * F.ln(-inner))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their place (1, 2, ...) in the given order, as column `place`.

    Rows are dealt to ordered ranges, numbered inside each, and shifted by what the ranges before
    hold (one number per range).
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # the id of a row is its partition, 33 bits up, and its number there
    dealt = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    before, shift = 0, []
    for number, count in sizes:
        shift.append((number, before))
        before += count
    shifts = rows.sparkSession.createDataFrame(shift, "_part long, _before long")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        dealt.withColumn("_part", part).join(F.broadcast(shifts), "_part")
        .withColumn("place", F.col("_before") + inside + 1).drop("_at", "_part", "_before")
    )


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20,
              seed: int = 42) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score, rank (NULL where not drawn).

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn: those of
    the highest score, ties to the smaller doc_id.
    """
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = weights(documents, gain).withColumn("score", F.col("weight") + gumbel(seed))
    scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    places = ranked(
        able.select("_row", "doc_id", "score"),
        [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row").asc()],
    )
    ranks = places.where(F.col("place") <= drawn).select("_row", F.col("place").alias("rank"))
    return scored.join(ranks, "_row", "left").drop("_row")
