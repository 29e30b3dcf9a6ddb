"""Importance resampling beside plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bloomgrid.llm import resampling
from conftest import SCHEMA, rows_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(lower)
    return words, [
        " ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
    ]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(documents, target, percent, least):
    s, t = Counter(), Counter()
    for _, text in documents:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    whole_s, whole_t = float(s.total()), float(t.total())
    gain = [
        math.floor(1000 * math.log(
            ((t[b] + 1.0) * (whole_s + 10000.0)) / ((s[b] + 1.0) * (whole_t + 10000.0))))
        for b in range(10_000)
    ]
    rows = []
    for doc_id, text in documents:
        words, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found)
        key = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = place + 1
    return sorted(map(str, rows))


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_beside_brute_force(spark, documents, corpus, percent):
    target = [corpus[3][1], corpus[50][1], None, "", "one two three"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resampling.resampled(documents, frame, percent=percent, least_words=20).collect()
    want = brute([(i, t) for i, t, _ in corpus], target, percent, 20)
    assert sorted(str(list(r)) for r in rows) == want


def test_crc_matrix_beside_zlib():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 700)
    sizes = rng.choice([0, 1, 2, 7, 30, 255, 256, 257, 900], 700)
    found = resampling.crcs(raw, starts, sizes)
    assert found.tolist() == [
        zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]


def test_places_over_many_ranges(spark):
    rng = random.Random(2)
    values = [(i, rng.choice([0, 0, 0, rng.randint(-50, 50)])) for i in range(3000)]
    frame = spark.createDataFrame(values, "id long, v long").repartition(7)
    placed = resampling.ranked(frame, [frame.v.desc(), frame.id.asc()]).collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])))}
    assert {r.id: r.place for r in placed} == want


def test_empty_tables(spark, documents, nothing):
    assert resampling.resampled(nothing, documents).count() == 0
    rows = resampling.resampled(documents, nothing).collect()
    assert len(rows) == documents.count()


def test_documents_of_few_words_are_never_drawn(spark):
    rows = rows_of([(i, "w " * 19, "en") for i in range(40)] + [(99, "w " * 20, "en")])
    frame = spark.createDataFrame(rows, SCHEMA)
    got = resampling.resampled(frame, frame, percent=100).collect()
    assert {r.doc_id for r in got if r["rank"] is not None} == {99}
