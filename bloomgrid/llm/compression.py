"""Quality by compression: which labelled text helps to compress a document?

From a bounded sample of labelled texts (2 * SAMPLE_TEXTS of each label) a zstandard dictionary is
built for good and one for bad text: half of the sample gives up to TEXT_BLOCKS blocks of each
text, wherever in it they stand. A document is cut into blocks of BLOCK bytes, all of which are
compressed with either dictionary, and the difference of the compressed sizes over the text's
size is the raw measure. A logistic curve fitted on the other half of the sample, whole texts that
are measured where they lie, turns it into a score; it also knows the text's size, as a short text
says little. Sample and label weights come from the documents that the model is trained for, not
from labels of others.

Every text is scored whole. NULL and empty texts have measure 0. Rows without a label are scored
like others; when one label is missing altogether every score is 0.5. NULL doc_ids are not held
out and not learned from; of repeated labels each counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import hashing
from bloomgrid.llm.batches import map_texts, text_buffers
from bloomgrid.session import cut_lineage

SAMPLE_TEXTS = 500
#: Blocks of a text that may go into a dictionary.
TEXT_BLOCKS = 2
DICTIONARY_BYTES = 112 << 10
BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    short: float
    shift: float

    def scores(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        line = self.slope * values + self.short * shortness(sizes) + self.shift
        return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


@lru_cache(maxsize=8)
def compressor(content: bytes):
    import zstandard

    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False
    )


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where the blocks are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(pieces)[-DICTIONARY_BYTES:]


def some_blocks(content: bytes, most: int = TEXT_BLOCKS) -> list[bytes]:
    """Blocks of a text of least checksum, so from anywhere in it."""
    pieces = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
    return sorted(pieces, key=lambda x: (zlib.crc32(x), x))[:most]


def measure(good: bytes, bad: bytes, content: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / size of the text."""
    if not content:
        return 0.0
    first, second = compressor(good), compressor(bad)
    difference = 0
    for start in range(0, len(content), BLOCK):
        block = content[start : start + BLOCK]
        difference += len(second.compress(block)) - len(first.compress(block))
    return difference / len(content)


def shortness(sizes: np.ndarray) -> np.ndarray:
    """1 for an empty text, falling with its bytes: little text is little evidence."""
    return 64 / (64 + sizes)


def fit_curve(
    values: np.ndarray, sizes: np.ndarray, good: np.ndarray, weight: np.ndarray
) -> tuple[float, float, float]:
    """Slope, weight of shortness and shift of a logistic curve, by Newton steps.

    Each row weighs as many rows as its label's sample stands for.
    """
    spread = values.std() or 1.0
    x = np.stack((values / spread, shortness(sizes), np.ones(len(values))), axis=1)
    weight = weight / weight.mean()
    found = np.zeros(3)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        gradient = x.T @ (weight * (chance - good)) + 0.1 * found
        bend = (x * (weight * chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(bend, gradient)
        found = found - step
        if np.abs(step).max() < 1e-8:
            break
    return float(found[0] / spread), float(found[1]), float(found[2])


def train(documents: DataFrame, labels: DataFrame, size: int = SAMPLE_TEXTS) -> Model | None:
    """Fit on labelled documents of this table; of bounded number, they alone reach the driver.

    Ids and checksums of texts are joined with the labels, and the sample is drawn among them, so
    texts are not moved; the sample, about 4 * size rows of a few numbers, goes to all tasks.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id"), F.col("quality").alias("label"))
    texts = documents.where("text IS NOT NULL").select(
        "doc_id", "text", F.xxhash64("text").alias("mark")
    )
    labelled = texts.select("doc_id", "mark").join(known, "doc_id")
    many = {row.label: row.n for row in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(many) != {0, 1}:
        return None
    chosen = cut_lineage(hashing.sample(labelled, "label", 2 * size))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "mark"), F.lit(2)) == 0
    parts = chosen.groupBy("label").agg(F.count_if(half).alias("a"), F.count_if(~half).alias("b")).collect()
    if any(row.a == 0 or row.b == 0 for row in parts):  # too few to part
        half = F.lit(None).cast("boolean")
    chosen = F.broadcast(chosen.withColumn("first", half))

    def gathered(which: Column, work, schema: str) -> list:
        """What `work` makes of the sampled texts of one half; equal texts once."""
        rows = texts.join(chosen.where(F.coalesce(which, F.lit(True))), ["doc_id", "mark"])
        made = map_texts(rows.select("label", "mark", "text"), schema, work)
        return made.distinct().collect()

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [
            (label, piece)
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for piece in some_blocks(text.encode("utf-8"))
        ]
        return pa.record_batch(
            [pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())],
            names=["label", "piece"],
        )

    pieces = gathered(F.col("first"), blocks, "label long, piece binary")
    pieces = sorted((row.label, bytes(row.piece)) for row in pieces)
    good, bad = (dictionary([x for own, x in pieces if own == label]) for label in (1, 0))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        content = [text.encode("utf-8") for text in batch.column("text").to_pylist()]
        return pa.record_batch(
            [
                batch.column("label").cast(pa.int64()), batch.column("mark"),
                pa.array([measure(good, bad, x) for x in content], pa.float64()),
                pa.array(list(map(len, content)), pa.int64()),
            ],
            names=["label", "mark", "value", "size"],
        )

    rows = gathered(~F.col("first"), measured, "label long, mark long, value double, size long")
    rows.sort(key=lambda x: (x.mark, x.label))
    rest = np.array([x.label for x in rows], float)
    stands_for = {label: many[label] / max((rest == label).sum(), 1) for label in (1, 0)}
    curve = fit_curve(
        np.array([x.value for x in rows]), np.array([x.size for x in rows]), rest,
        np.array([stands_for[int(x)] for x in rest]),
    )
    return Model(good, bad, *curve)


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out (as given), score, predicted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch.column("text"))
        content = raw.tobytes()
        if model:
            values = np.array([
                measure(model.good, model.bad, content[a:b])
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ])
            scores = model.scores(values, np.diff(offsets))
        else:
            scores = np.full(batch.num_rows, 0.5)
        return pa.record_batch(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                pa.array((scores >= 0.5).astype(np.int32)),
            ],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return map_texts(
        documents.select("doc_id", "held_out", "text"),
        "doc_id long, held_out boolean, score double, predicted int", run,
    )


def accepted(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns, whose score is at least 0.5; without a model, all of them."""
    if model is None:
        return documents

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch.column("text"))
        content = raw.tobytes()
        values = np.array([
            measure(model.good, model.bad, content[a:b])
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ])
        return batch.filter(pa.array(model.scores(values, np.diff(offsets)) >= 0.5))

    return map_texts(documents, documents.schema, run)


def classified(
    documents: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, size: int = SAMPLE_TEXTS
) -> DataFrame:
    """Learn labels of rows whose crc32(doc_id) mod `modulus` is not `held`, score every row."""
    part = hashing.remainder("doc_id", modulus)
    model = train(documents, labels.where(part != held), size)
    return scored(
        documents.select("doc_id", "text", F.coalesce(part == held, F.lit(False)).alias("held_out")),
        model,
    )
