"""Near-duplicates by MinHash: many universal hash minima, bands, verification, star components.

A text's set holds its distinct shingles of `width` words. Texts are linked when the Jaccard
similarity of their sets is at least `percent` / 100. The steps:

1. texts with equal sets form a class with its smallest doc_id as representative;
2. each representative gets HASHES minima of universal hashes; BANDS bands of ROWS of them make
   its bucket keys, two bits of each minimum make a sketch;
3. a round of stars: a member of a bucket is paired with few popular members of it, sketches sort
   out unlike pairs, and each member keeps its most alike partners, so the round tests a few pairs
   per text;
4. pairs are confirmed on the full sets, and confirmed links joined to components;
5. then every pair of one bucket whose members are still in different components, except pairs
   that sketches tell apart, is tested likewise. So no link that a bucket holds is lost, while the
   members of a large group of copies that is one component by now are not paired. What remains
   is (texts outside their bucket's largest component) x (texts in the bucket).

A pair at exactly 0.8 shares no bucket with probability (1 - 0.8^6)^32 = 6e-5.

doc_id identifies a text. NULL, empty and white-space texts have an empty set and no link; rows
with a NULL doc_id are returned with their set size, no component and kept = true. Repeated rows
are returned as often as they come. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import operator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import components, words
from bloomgrid.llm.batches import keep_batches_small, map_texts, text_buffers
from bloomgrid.session import cut_lineage

BANDS, ROWS = 32, 6
#: The first BANDS * ROWS minima make bucket keys, all of them make the sketch.
HASHES = 384
#: Two bits of each minimum make the sketch. At similarity 0.8 they differ for 57.6 minima in the
#: mean, with a deviation of 7.0; four deviations more are let pass.
DRAWN = tuple("abcdefghijkl")
UNLIKE = 85
#: Partners per bucket in the round of stars.
STAR_PARTS = 4
#: Ids up to this number (8 bytes each) are sent to every task, so that texts need not move.
FEW_IDS = 2_000_000

_rng = np.random.default_rng(8128)
FACTORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ROW_VALUES = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set of 64-bit members."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 4096):
        part = short[start : start + 4096]
        hashed = FACTORS[:, None] * part[None, :] + SHIFTS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = words.mixed((rows * ROW_VALUES).sum(axis=1, dtype=np.uint64))
    return (keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two well-mixed bits of each minimum, as two times six longs."""
    bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
    pair = np.stack((bits >> np.uint32(1), bits & np.uint32(1))).astype(np.uint8)
    return np.packbits(pair, axis=1).view(np.int64).ravel()


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    found = words.find(*text_buffers(batch.column("text")), words.SPACED, lower=True)
    runs, borders = words.shingles(found, width)
    return [np.unique(runs[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]


@lru_cache(maxsize=1)
def _place_factors(size: int) -> np.ndarray:
    return words.mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)


def set_key(members: np.ndarray) -> bytes:
    """128 bits that differ between different (sorted) sets."""
    room = _place_factors(1 << max(16, len(members).bit_length()))[: len(members)]
    a = (members * room).sum(dtype=np.uint64)
    b = (words.mixed(members ^ np.uint64(0x5851F42D4C957F2D)) * room).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (NULL for empty sets), keys, sketch words a, b, c."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = _sets(batch, width)
        made = [minima(s) for s in sets]
        drawn = np.array([sketch(m) for m in made]).reshape(-1, len(DRAWN))
        keys = np.concatenate([band_keys(m) for m in made])
        borders = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(borders, pa.array(keys, pa.int64())),
                *(pa.array(np.ascontiguousarray(drawn[:, i]), pa.int64()) for i in range(len(DRAWN))),
            ],
            names=["doc_id", "n_shingles", "set_key", "keys", *DRAWN],
        )

    return map_texts(
        documents.select("doc_id", "text"),
        "doc_id long, n_shingles long, set_key binary, keys array<long>, "
        + ", ".join(f"{x} long" for x in DRAWN),
        run,
    )


def _unlike(left: str, right: str):
    """The number of minima whose sketch bits differ."""

    def differ(x: str):
        return F.col(f"{left}.{x}").bitwiseXOR(F.col(f"{right}.{x}"))

    half = len(DRAWN) // 2
    pairs = zip(DRAWN[:half], DRAWN[half:], strict=True)
    return reduce(operator.add, (F.bit_count(differ(x).bitwiseOR(differ(y))) for x, y in pairs))


def full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and its sorted set (packed), for the texts named in ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in _sets(batch, width)]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "members"]
        )

    chosen = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return map_texts(chosen, "doc_id long, members binary", run).dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("x"), batch.column("y"), strict=True):
                a = np.frombuffer(left.as_py(), np.uint64)
                b = np.frombuffer(right.as_py(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("u"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("members").alias("y"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    keep_batches_small(pairs.sparkSession)
    return both.mapInArrow(run, "u long, v long")


def _bucket_members(reps: DataFrame) -> DataFrame:
    """key, id, popularity, keys and sketch of the members of buckets that hold two sets or more.

    `popularity` is the number of members in all buckets of the id.
    """
    members = reps.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    crowds = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = members.join(crowds, "key")
    popular = shared.groupBy("id").agg(F.sum("size").alias("popularity"))
    drawn = reps.select(F.col("rep").alias("id"), "keys", *DRAWN)
    return shared.select("key", "id").join(popular.join(drawn, "id"), "id")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def star_pairs(shared: DataFrame, parts: int) -> DataFrame:
    """Every member with few partners: the most alike among the popular ones of its buckets.

    A bucket's members are dealt to `parts` parts; the most popular of each part is a partner of
    all others. A member keeps the most alike partner of each part over all its buckets.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    centres = (
        shared.groupBy("key", part.alias("part"))
        .agg(F.max(F.struct("popularity", "id", *DRAWN)).alias("m"))
        .select("key", "part", "m.id", *(f"m.{x}" for x in DRAWN))
    )
    near = (
        shared.alias("s").join(centres.alias("t"), "key")
        .where((F.col("s.id") != F.col("t.id")) & (_unlike("s", "t") <= UNLIKE))
        .groupBy(F.col("s.id").alias("u"), "part")
        .agg(F.min(F.struct(_unlike("s", "t").alias("unlike"), F.col("t.id").alias("v"))).alias("m"))
    )
    return _ordered(near.select("u", F.col("m.v").alias("v")))


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component's label, of buckets that hold several components.

    `largest` is the label with most members there, the most popular one among equals.
    """
    named = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = named.groupBy("key", "label").agg(
        F.count("*").alias("n"), F.max("popularity").alias("top")
    )
    largest = (
        sizes.groupBy("key")
        .agg(F.max_by("label", F.struct("n", "top", "label")).alias("largest"), F.count("*").alias("k"))
        .where("k > 1").drop("k")
    )
    return cut_lineage(named.join(largest, "key"))


def remaining_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of one bucket in different components that their sketches do not tell apart.

    A pair that shares several buckets is made in the first of them only.
    """
    s, t = buckets.where("label <> largest").alias("s"), buckets.alias("t")
    first = F.try_element_at(
        F.filter(F.zip_with("s.keys", "t.keys", lambda x, y: F.when(x == y, x)), F.isnotnull), F.lit(1)
    )
    rest = s.join(t, "key").where(
        (F.col("s.label") != F.col("t.label"))
        & ((F.col("t.label") == F.col("t.largest")) | (F.col("s.id") < F.col("t.id")))
        & (_unlike("s", "t") <= UNLIKE)
        & (first == F.col("s.key"))
    )
    return _ordered(rest.select(F.col("s.id").alias("u"), F.col("t.id").alias("v")))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    rows = cut_lineage(signatures(documents, width))
    classes = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    first = classes.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = (
        classes.join(first, "set_key").where("doc_id = rep")
        .groupBy("rep").agg(*(F.first(x).alias(x) for x in ("keys", *DRAWN)))
    )
    shared = cut_lineage(_bucket_members(reps))
    links = _links(documents, star_pairs(shared, STAR_PARTS), width, percent)
    buckets = _open_buckets(shared, components.connected(links))
    found = _links(documents, remaining_pairs(buckets), width, percent)
    labels = components.connected(links.unionByName(found))
    named = first.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _links(documents: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    return cut_lineage(confirmed(pairs, _few_or_many_sets(documents, ids, width), percent))


def _few_or_many_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    ids = cut_lineage(ids)
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return cut_lineage(full_sets(documents, ids, width))
