"""Benchmark decontamination with a positional inverted index of the training documents.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is WINDOW consecutive
words of an item; an item with fewer words (not none) is one window.

1. Postings: each document's positions of test terms are stored, by term, as a table. Positions
   in runs of test terms shorter than the shortest window cannot be part of a window and are left
   out, so the table follows the overlap with the tests, not the size of the texts.
2. The table's own counts order each window's terms from the rarest on.
3. Postings of the rarest term are joined with the windows; each position less the term's offset
   is a possible begin, and the other terms' lists are intersected in turn, adjusted by their
   offsets. Windows with a term that occurs nowhere are not looked up.

With `slack` above 0 the same lists give proximity matches as well: every term within that many
words of its place. Terms of such a match stand in a run with gaps of at most 1 + 2 x slack, and a
term that a window repeats may stand only once, so runs are cut at larger gaps and kept from the
least number of different terms on. The columns on exact matches stay the same. Distinct windows of the tests are worked off in blocks of at most BLOCK_WINDOWS, which
bounds what is sent to tasks; every block meets all documents.

NULL and empty texts have no words and no hits. Rows are told apart by doc_id and text, so NULL
and repeated doc_ids are answered row by row. Items with NULL text or NULL id are left out; of
repeated items one counts. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import words
from bloomgrid.llm.batches import map_texts, text_buffers
from bloomgrid.session import cut_lineage

WINDOW = 10
BLOCK_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def row_key() -> Column:
    """Tells rows of different doc_id or text apart, NULLs included."""
    return F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.hex(F.xxhash64("text")), F.length("text").cast("string"),
    )


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id and terms of every distinct window."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), 1)
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(
        "item_id", found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return (
        items.select("item_id", "w", F.explode(starts).alias("i"))
        .select("item_id", F.slice("w", F.col("i"), F.lit(width)).alias("terms")).distinct()
    )


class Vocabulary:
    """The terms of one block of windows, found by the hash of a word and then compared."""

    def __init__(self, terms: list[str]):
        data = [term.encode("utf-8") for term in terms]
        lengths = np.array([0, *map(len, data)], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        every = np.ones(256, bool)
        hashes = words.find(raw, np.cumsum(lengths), every, lower=False).hashes
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.terms = data

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word hash, -1 for other words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def long_runs(member: np.ndarray, rows: np.ndarray, least: int, gap: int = 1) -> np.ndarray:
    """Which words are members in runs, within a row, of at least that many.

    Neighbouring members of a run are at most `gap` words apart.
    """
    if not len(member):
        return member
    if gap > 1:
        at = np.flatnonzero(member)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > gap) | (rows[at[1:]] != rows[at[:-1]])
        run = np.cumsum(fresh) - 1
        kept = np.zeros(len(member), bool)
        kept[at[np.bincount(run)[run] >= least]] = True
        return kept
    fresh = np.ones(len(member), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (member[1:] != member[:-1])
    run = np.cumsum(fresh) - 1
    return member & (np.bincount(run)[run] >= least)


def postings(documents: DataFrame, terms: list[str], least: int, slack: int = 0) -> DataFrame:
    """key, doc_id, n_words and the row's positions by term number, as a stored table."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = shared.value
        raw, offsets = text_buffers(batch.column("text"))
        found = words.find(raw, offsets, words.PLAIN, lower=True)
        numbers = vocabulary.numbers(found.hashes)
        at = np.flatnonzero(long_runs(numbers >= 0, found.rows, least, 1 + 2 * slack))
        lower = words.LOWER[raw]
        same = [
            lower[found.starts[i] : found.ends[i]].tobytes() == vocabulary.terms[numbers[i]] for i in at
        ]
        at = at[np.array(same, bool)]
        term, row = numbers[at], found.rows[at]
        place = at - found.borders[:-1][row]
        order = np.lexsort((place, term, row))
        term, row, place = term[order], row[order], place[order]
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(begin, len(term)).astype(np.int32)), pa.array(place.astype(np.int32)))
        borders = np.searchsorted(row[begin], np.arange(batch.num_rows + 1)).astype(np.int32)
        by_term = pa.MapArray.from_arrays(
            pa.array(borders), pa.array(term[begin].astype(np.int32)), lists)
        return pa.record_batch(
            [batch.column("key"), batch.column("doc_id"), pa.array(found.per_row(), pa.int64()), by_term],
            names=["key", "doc_id", "n_words", "places"],
        )

    return cut_lineage(map_texts(
        documents.select(row_key().alias("key"), "doc_id", "text"),
        "key string, doc_id long, n_words long, places map<int,array<int>>", run,
    ))


def matches(index: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    """key, window, start, size: where the terms of a window stand in a row, in order.

    `windows` has window and terms (numbers); it is one block, so it may be sent to every task.
    """
    counts = (
        index.select(F.explode("places").alias("term", "at"))
        .groupBy("term").agg(F.sum(F.size("at")).alias("n"))
    )
    placed = windows.select("window", F.posexplode("terms").alias("offset", "term"))
    ordered = (
        placed.join(F.broadcast(counts), "term", "left")
        .groupBy("window")
        .agg(
            F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("t"),
            F.count("*").alias("size"), F.count("n").alias("known"),
        )
        .where("size = known")
        .select("window", "size", F.col("t")[0]["term"].alias("rarest"), "t")
    )
    anchored = (
        index.where(F.size("places") > 0)
        .select("key", "places", F.explode(F.map_keys("places")).alias("rarest"))
        .join(F.broadcast(ordered), "rarest")
    )
    begins = F.transform(
        F.try_element_at("places", F.col("rarest")), lambda p: p - F.col("t")[0]["offset"])
    if slack:  # the rarest term may be off its place as well
        begins = F.array_distinct(F.flatten(F.transform(
            begins, lambda b: F.sequence(b - F.lit(slack), b + F.lit(slack)))))

    def holds(begin: Column) -> Column:
        def stands(x: Column) -> Column:
            wanted, own = begin + x["offset"], F.try_element_at("places", x["term"])
            if not slack:
                return F.coalesce(F.array_contains(own, wanted), F.lit(False))
            return F.coalesce(F.exists(own, lambda p: F.abs(p - wanted) <= slack), F.lit(False))

        return (begin >= -slack) & F.forall(F.slice("t", F.lit(2), F.size("t")), stands)

    return anchored.select(
        "key", "window", "size", F.explode(F.filter(begins, holds)).alias("start")
    ).select("key", "window", "start", "size")


def _covered(spans: Column) -> Column:
    """How many words lie in at least one of the spans (start, size), sorted by start."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(have: Column, span: Column) -> Column:
        end = (span["start"] + span["size"]).cast("int")
        fresh = F.greatest(end - F.greatest(have["upto"], span["start"]), F.lit(0))
        return F.struct(
            F.greatest(have["upto"], end).alias("upto"), (have["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, add)["n"]


def contaminated(
    documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, slack: int = 0
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key (of the row).

    With slack also n_near and near_items, the items with a proximity match (exact ones among
    them): how many, and their ids as text, sorted.
    """
    spark = documents.sparkSession
    windows = cut_lineage(item_windows(benchmark, width))
    distinct = cut_lineage(windows.select("terms").distinct())
    blocks = max(1, -(-distinct.count() // (BLOCK_WINDOWS // 2)))
    place = F.pmod(F.xxhash64("terms"), F.lit(blocks))
    rows, hits, near = None, None, None
    for block in range(blocks):
        own = [row.terms for row in distinct.where(place == block).collect()]
        terms = sorted({term for window in own for term in window})
        number = {term: i for i, term in enumerate(terms)}
        sizes = (len(set(window)) if slack else len(window) for window in own)
        index = postings(documents, terms, min(sizes, default=width), slack)
        rows = rows or index.select("key", "doc_id", "n_words")
        numbered = spark.createDataFrame(
            ((i, [number[t] for t in window], window) for i, window in enumerate(own)),
            "window int, terms array<int>, spelled array<string>",
        )
        spelled = F.broadcast(numbered.select("window", F.col("spelled").alias("terms")))
        found = matches(index, numbered.select("window", "terms")).join(
            spelled, "window").select("key", "start", "size", "terms")
        hits = found if hits is None else hits.unionByName(found)
        if slack:
            close = matches(index, numbered.select("window", "terms"), slack).join(
                spelled, "window").select("key", "terms")
            near = close if near is None else near.unionByName(close)
    hits = cut_lineage(hits)
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("s"))

    def items_of(found: DataFrame) -> DataFrame:
        return (
            found.select("key", "terms").distinct().join(windows, "terms")
            .groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("i"))
        )

    items = items_of(hits)
    known = spans.join(items, "key").select(
        "key", _covered(F.col("s")).alias("n_hit"), F.size("i").cast("long").alias("n_items"),
        F.sha2(F.array_join("i", ","), 256).alias("sha"),
    )
    further = []
    if slack:
        none = F.array().cast("array<string>")
        rows = rows.join(items_of(near).withColumnRenamed("i", "near"), "key", "left")
        further = [F.size(F.coalesce("near", none)).cast("long").alias("n_near"),
                   F.coalesce("near", none).alias("near_items")]
    return rows.join(known, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "key", *further,
    )
