"""Packed pieces beside the tokenizer library, and bounds on padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bloomgrid.llm import packing, piece_ids, wordbpe


@pytest.fixture(scope="module")
def tokenizer():
    return wordbpe.load(wordbpe.default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def padding(rows, size):
    """Sequences' lengths are checked on the way; padded places and ids."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded, sum(r.length for r in rows)


def documents_of(rows):
    """The ids of every document, put together from its pieces (rows may repeat a doc_id)."""
    found = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint32).tolist()
        assert len(ids) == r.length
        found[r.doc_id].append((r.start, r.doc_tokens, ids))
    return found


@pytest.mark.parametrize(("size", "windows"), [(2048, 32), (64, 3)])
def test_every_id_lies_in_one_piece(documents, corpus, tokenizer, size, windows):
    rows = packing.pack(documents, size=size, open_windows=windows, slack=2).collect()
    padded, total = padding(rows, size)
    assert padded < 0.03 * total + size
    want = defaultdict(list)
    for doc_id, text, _ in corpus:
        want[doc_id].append(ids_of(tokenizer, text))
    found = documents_of(rows)
    assert found.keys() == want.keys()
    for doc_id, texts in want.items():
        if len(texts) > 1:  # repeated rows: the pieces of both
            assert sum(len(x[2]) for x in found[doc_id]) == sum(map(len, texts))
            continue
        pieces = sorted(found[doc_id])
        assert [i for _, _, ids in pieces for i in ids] == texts[0]
        at = 0
        for start, doc_tokens, ids in pieces:
            assert (start, doc_tokens) == (at, len(texts[0]))
            at += len(ids)


def test_tree_of_many_tasks_bounds_what_a_group_holds(spark, tokenizer):
    rng = random.Random(5)
    texts = [(i, " ".join(["word"] * rng.choice([0, 1, 7, 40, 300]))) for i in range(900)]
    many = spark.createDataFrame(texts, "doc_id long, text string").repartition(300)
    rows = packing.pack(many, size=256, open_windows=4, slack=4).collect()
    padded, total = padding(rows, 256)
    assert total == sum(len(ids_of(tokenizer, t)) for _, t in texts)
    assert padded <= 0.02 * total
    assert len({r.sequence_id >> 58 for r in rows}) == 4  # tasks, 300 / 16, 19 / 16, the last


def test_window_rules():
    windows = packing.Windows(size=10, most=2, slack=1, first_id=0)

    def put(name, length):
        windows.document(name, bytes(4 * length))

    put(1, 6)
    put(2, 7)
    put(3, 3)  # best fit: window of 2 is filled and goes
    assert [(r[0], r[6]) for r in windows.ready] == [(2, 0), (3, 7)]
    put(4, 5)
    put(5, 5)  # fills the window of 4
    assert [r[0] for r in windows.ready][2:] == [4, 5]
    put(6, 25)  # two whole windows, then five ids for an open one
    put(7, 6)  # fits nowhere: the head fills up the fullest
    assert [(r[0], r[1], r[2]) for r in windows.ready if r[0] == 7] == [(7, 0, 4)]
    windows.close()
    lengths = defaultdict(int)
    for r in windows.ready:
        lengths[r[5]] += r[2]
    assert sum(lengths.values()) == 6 + 7 + 3 + 5 + 5 + 25 + 6
    assert all(n == 10 or n >= 9 or n & (n - 1) == 0 for n in lengths.values())


def test_cut():
    item = [(1, 0, b"aaaabbbb", 2), (2, 5, b"cccc", 9)]
    for at in range(4):
        head, rest = packing.cut(item, at)
        assert packing.tokens(head) == at and packing.tokens(rest) == 3 - at
        assert b"".join(p[2] for p in head + rest) == b"aaaabbbbcccc"
    assert packing.cut(item, 1)[1][0] == (1, 1, b"bbbb", 2)


def test_checksum_of_ids(spark, documents, corpus, tokenizer):
    from pyspark.sql import functions as F

    rows = packing.pack(documents).withColumn("crc", F.crc32("ids")).collect()
    for r in rows:
        assert r.crc == zlib.crc32(bytes(r.ids))


def test_piece_ids_agree_with_the_library(corpus, tokenizer):
    rng = random.Random(8)
    texts = [t or "" for _, t, _ in corpus]
    texts += ["".join(rng.choices("abcdeöéß'.,!0123 \n|<>", k=rng.randint(1, 90))) for _ in range(300)]
    texts += ["a" * n for n in range(1, 60)] + ["don't we'll it's", "x'S 12 345", " a b"]
    found = piece_ids.Pieces(wordbpe.default_path()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == ids_of(tokenizer, text)[:-1]


def test_pieces_stay_within_their_bound(monkeypatch):
    monkeypatch.setattr(piece_ids, "KEPT_PIECES", 50)
    kept = piece_ids.Pieces(wordbpe.default_path())
    for start in range(0, 400, 20):
        kept.encode([" ".join(f"w{k}" for k in range(start, start + 20)).encode()])
        assert len(kept.pieces) + len(kept.older) <= 2 * 70


def test_arrow_texts_and_their_borders(tokenizer):
    texts = [None, "", "one Two", " \n", "<|endoftext|>x \x1c", "wörter " * 9, "one\x0b\x0ctwo", "x" * 60]
    column = pa.array(["not this", *texts])[1:]
    ids, borders = piece_ids.Pieces(wordbpe.default_path()).encoded(column)
    found = [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)]
    assert found == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_small_batches_are_encoded_together(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():  # noqa: N802
            return 3

    asked, encoded = [], piece_ids.Pieces.encoded
    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(piece_ids.Pieces, "encoded", lambda self, x: asked.append(1) or encoded(self, x))
    batches = [pa.record_batch({"doc_id": [i], "text": [f"text {i}"]}) for i in range(50)]
    rows = list(packing.packer(wordbpe.default_path(), 2048, 32, 8)(iter(batches)))
    assert sum(b.num_rows for b in rows) == 50
    assert len(asked) == 1


def test_empty_table(nothing):
    assert packing.pack(nothing).count() == 0
