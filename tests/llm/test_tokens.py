"""Token counts and BPE beside the tokenizer library."""

import hashlib
import random

import pyarrow as pa
import pytest

from bloomgrid.llm import bpe, token_counts, wordbpe
from bloomgrid.llm.queries import digests


@pytest.fixture(scope="module")
def tokenizer():
    return wordbpe.load(wordbpe.default_path())


def test_counts_of_every_text(documents, corpus, tokenizer):
    rows = token_counts.token_counts(documents).collect()
    want = sorted(
        (str(i), len((t or "").encode()), n, n > 2048)
        for i, t, _ in corpus
        for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)]
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want


def test_shortcut_is_taken_and_proved(tokenizer):
    path = wordbpe.default_path()
    whole = wordbpe.whole_tokens(path)
    assert len(whole) > 20_000 and "the" in whole
    for text in random.Random(1).sample(sorted(whole), 300):
        assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1
    counter = token_counts.Counting(path)
    assert counter.text("The cat sat, qzxqzx!") == len(
        tokenizer.encode("The cat sat, qzxqzx!", add_special_tokens=False).ids)
    assert counter.shortcut >= 4 and counter.merged >= 1


def test_encoding_and_decoding_agree_with_the_library(documents, corpus, tokenizer):
    rows = digests(bpe.encode_decode(documents)).collect()

    def told(t):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        return (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )

    want = sorted((str(i), *told(t)) for i, t, _ in corpus)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in rows) == want


def test_chunks_are_reused_and_joins_repaired(tokenizer):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(900))
    texts = [f"{'x' * k} start{k} {passage} end{k}" for k in range(12)] + [passage.replace(" ", "")]
    path = wordbpe.default_path()
    bpe.encoder.cache_clear()
    got = bpe.encode_batch(path, pa.array(texts))
    assert [x.tolist() for x in got] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bpe.encoder(path)
    assert encoder.asked > 3 * encoder.made and encoder.repaired > 20


def test_kept_results_stay_within_their_bound():
    made = []
    kept = wordbpe.Kept(lambda key: made.append(key) or key * 2, 10)
    for k in [*range(30), *range(25, 30), 0]:
        assert kept[k] == 2 * k and len(kept) + len(kept.older) <= 20
    assert made == [*range(30), 0]


def test_empty_table(nothing):
    assert token_counts.token_counts(nothing).count() == 0
    assert bpe.encode_decode(nothing).count() == 0
