"""A training-text pipeline: quality rules, quality classifier, near-dedup, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns what encoding and decoding give. run() writes each stage's result as
Parquet to the shared folder and reads it again as the next stage's docs.

Rows with NULL doc_id or text, empty tables and repeated rows go through like in the operators:
a NULL or empty text fails the base rules; repeated rows of one doc_id stay or go together.
Further columns of docs are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.llm import bpe, compression, decontaminate, neardup, quality_rules
from bloomgrid.llm.queries import digests, table
from bloomgrid.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys up to this number are sent to every task, so that texts need not move.
FEW_KEYS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The documents whose key is not among the dropped ones."""
    dropped = cut_lineage(dropped.select(key).distinct())
    if dropped.count() <= FEW_KEYS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, key, "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs.select(*COLUMNS))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for bad ones go."""
    model = compression.train(docs, table(spark, sf_dir, "labels"))
    return compression.accepted(docs.select(*COLUMNS), model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    return without(docs, found.where("NOT kept"), "doc_id")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    keyed = docs.withColumn("key", decontaminate.row_key())
    return without(keyed, found.where("contaminated"), "key")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded texts."""
    return digests(bpe.encode_decode(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe encoding and decoding", encoding_stage),
]

#: Models trained from the tables and the tokenizer library are beyond SQL; tests/llm compares
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
