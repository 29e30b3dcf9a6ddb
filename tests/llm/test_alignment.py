"""Alignment of two tokenizers beside whole-text encoding and plain counting."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bloomgrid.llm import alignment


@pytest.fixture(scope="module")
def whole():
    return alignment.Aligner(*alignment.default_paths())


def plain(whole, text):
    """(a, b, groups) of a text by encoding it in one piece."""
    nothing = [], [], []
    if not text:
        return nothing
    a = whole.a.encode(" " + text, add_special_tokens=False).ids
    b = whole.b.encode(text)
    raw = (" " + text).encode()
    parts_a, parts_b = [whole.bytes_a[i] for i in a], [whole.bytes_b[i] for i in b]
    if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
        return nothing
    ends_a = np.cumsum([len(x) for x in parts_a]).tolist()
    ends_b = np.cumsum([len(x) for x in parts_b]).tolist()
    groups, start_a, start_b = [], 0, 0
    places = {end: j for j, end in enumerate(ends_b)}
    for i, end in enumerate(ends_a):
        if end in places:
            j = places[end]
            groups.append((a[start_a : i + 1], b[start_b : j + 1]))
            start_a, start_b = i + 1, j + 1
    return a, b, groups


def expected(whole, texts):
    rows, held = [], defaultdict(set)
    for place, text in enumerate(texts):
        a, b, groups = plain(whole, text)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in links:
            held[pair].add(place)
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((len(a), len(b), len(groups), links, told))
    count = {pair: len(docs) for pair, docs in held.items()}
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return count, [
        (n_a, n_b, n_groups, links.total(), told,
         sum(n for pair, n in links.items() if count[pair] == highest[pair[0]]),
         sum(n * count[pair] for pair, n in links.items()))
        for n_a, n_b, n_groups, links, told in rows
    ]


ODD = [
    " leading", "two  blanks   three", "tab\tand\n\nfeeds\n  x", "trailing ", " ", "\n", "\n\nx",
    "▁ in text", "a▁b", "<unk> <s> </s> <0x41> <|endoftext|>", "日本語 テキスト", "🙂🙂 🙂",
    "é ﬁ  nbsp x", "x\x00y", "\x1c \x1d\x85 z", "a\r\nb c d", "can't WE'LL 12345",
]


def test_scores_beside_brute_force(spark, documents, corpus, whole):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(extra).repartition(5)
    texts = [(i, t) for i, t, _ in corpus] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows = alignment.scored(both).collect()
    _, want = expected(whole, [t for _, t in texts])
    told = sorted((str(i), *w) for (i, _), w in zip(texts, want, strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == told


def test_small_blocks_give_the_same(documents, corpus, whole, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", 7)  # bitmaps of one byte
    texts = [t for _, t, _ in corpus]
    raw = [(i, t or "") for i, t in enumerate(texts)]
    block, rows, docs = alignment.Block(0), [], Counter()
    for _, text in raw:
        if block.full():
            rows += [b for b in block.rows()]
            block = alignment.Block(0)
        block.add(whole.text(text)[1], len(text))
    rows += [b for b in block.rows()]
    links = Counter()
    for batch in rows:
        for r in batch.to_pylist():
            pair = (r["a"], r["b"])
            planes = [alignment.opened(p, r["size"]) for p in r["planes"]]
            assert len(set(np.concatenate(planes).tolist())) == r["documents"]
            assert sum(len(p) << k for k, p in enumerate(planes)) == r["links"]
            docs[pair] += r["documents"]
            links[pair] += r["links"]
    count, _ = expected(whole, texts)
    assert docs == Counter(count)
    assert links.total() == sum(x[3] for x in expected(whole, texts)[1])


def test_pair_counts(spark, documents, corpus, whole):
    index = alignment.align(documents).where("slot IS NULL")
    found = {(r.a, r.b): r.documents for r in alignment.pair_counts(index).collect()}
    assert found == expected(whole, [t for _, t, _ in corpus])[0]


def test_containers():
    for size in (1, 8, 9, 1000, 65536):
        for step in (1, 3, 40):
            slots = np.arange(0, size, step)
            body = alignment.container(slots, size)
            assert len(body) <= max(2 * len(slots), (size + 7) // 8)
            assert alignment.opened(body, size).tolist() == slots.tolist()


def test_cuts_are_at_blanks_and_feeds_behind_other_characters(whole):
    rng = random.Random(3)
    signs = "abé ß\n\t\x1c\x85\xa0\u2003\u3000日 x \n"
    texts = [None, "", *ODD, *["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(500)]]
    segments, of = whole.cut(pa.array(texts, pa.string()))
    found = defaultdict(list)
    for segment, text in zip(segments.to_pylist(), of.tolist(), strict=True):
        found[text].append(segment)
    pattern = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
    for place, text in enumerate(texts):
        assert found[place] == (pattern.findall(" " + text) if text else [])


def test_texts_of_a_slice_beside_plain_counting(whole, corpus):
    texts = [t for _, t, _ in corpus] + ODD
    made = whole.texts(pa.array(texts, pa.string()))
    for place, text in enumerate(texts):
        a, b, groups = plain(whole, text)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        told = Counter()
        for pair, times in zip(*(x.tolist() for x in made.counted(place)), strict=True):
            told[pair >> 32, pair & 0xFFFFFFFF] += times
        figures = [int(made.figures[name][place]) for name in alignment.FIGURES]
        assert told == links and figures == [len(a), len(b), len(groups), links.total()]


def test_small_batches_are_aligned_together(documents, monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():  # noqa: N802
            return 3

    class Frame:
        sparkSession = documents.sparkSession  # noqa: N815

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    asked, texts = [], alignment.Aligner.texts
    monkeypatch.setattr(alignment, "TaskContext", Task)
    monkeypatch.setattr(alignment.Aligner, "texts", lambda self, x: asked.append(1) or texts(self, x))
    batches = [pa.record_batch({"doc_id": [i], "text": [f"text {i}"]}) for i in range(50)]
    rows = [r for b in alignment.align(Frame())(iter(batches)) for r in b.to_pylist()]
    assert sum(r["slot"] is not None for r in rows) == 50
    assert len(asked) == 1


def test_sorted_with_values_of_any_size():
    for most in (3, 1 << 40):
        keys, values = np.array([5 << 30, 1, 5 << 30, 2]), np.array([most, 1, most, 0])
        ordered, beside = alignment.sorted_with(keys, values)
        assert ordered.tolist() == [1, 2, 5 << 30, 5 << 30]
        assert beside.tolist() == [1, 0, most, most]


def test_long_text_without_blanks(spark, whole):
    text = "ab日" * 30_000
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.scored(frame).collect()}
    a, b, groups = plain(whole, text)
    assert (rows[1].n_a, rows[1].n_b, rows[1].n_groups) == (len(a), len(b), len(groups))
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, "", 0, 0)


def test_query_digests(spark, tmp_path):
    from bloomgrid.llm.queries import QUERIES

    spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op12_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    told = alignment.scored(spark.createDataFrame([(1, "one two")], "doc_id long, text string"))
    text = told.select(F.col("groups")).first()[0]
    assert rows[1].groups_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[2].groups_sha256 == "" and rows[2].n_links == 0


def test_empty_table(nothing):
    assert alignment.scored(nothing).count() == 0
