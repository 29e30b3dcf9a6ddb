"""Token counts by the whole-token shortcut.

Before the texts are read, each vocabulary string is encoded alone; those that come back as the
single token they spell are whole tokens. In a text, pre-tokens that are whole tokens count one
each; only the others go through the merges, and their counts are remembered inside a process, up
to a bound.

NULL and empty texts have no tokens; doc_id may be NULL or repeated, other columns are not used.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import wordbpe
from bloomgrid.llm.batches import map_texts


class Counting:
    """Counts tokens of texts; `shortcut` and `merged` say how many units went which way."""

    def __init__(self, path: str):
        self.path = path
        self.whole = wordbpe.whole_tokens(path)
        self.merges = wordbpe.Kept(
            lambda unit: len(wordbpe.merged(path, unit)), wordbpe.KEPT_UNITS
        )
        self.shortcut = self.merged = 0

    def text(self, text: str | None) -> int:
        """Units that are whole tokens count one each, the others as the merges leave them."""
        units = Counter(wordbpe.units(self.path, text or ""))
        rest = units.keys() - self.whole
        merged = sum(units[unit] for unit in rest)
        single = units.total() - merged
        self.merged += merged
        self.shortcut += single
        return single + sum(self.merges[unit] * units[unit] for unit in rest)


@lru_cache(maxsize=1)
def counting(path: str) -> Counting:
    return Counting(path)


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens)."""
    path = path or wordbpe.default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [counting(path).text(text) for text in batch.column("text").to_pylist()]
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    texts = documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    counted = map_texts(texts, "doc_id long, n_bytes long, n_tokens long", run)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
