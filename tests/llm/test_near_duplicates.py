"""Near-duplicates beside all pairs, components beside a union-find."""

import random
import re

import pyarrow as pa

from bloomgrid.llm import components, neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    found = WORDS.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def labels_of(nodes, links):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(pairs, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in pairs if i is not None}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    links.append((a, b))
    return sets, labels_of(ids, links)


def check(frame, pairs, width):
    sets, labels = expected(pairs, width)
    rows = neardup.near_duplicates(frame, width).collect()
    assert len(rows) == len(pairs)
    for row in rows:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.n_shingles == len(sets[row.doc_id])
            assert (row.component_id, row.kept) == (
                labels[row.doc_id], labels[row.doc_id] == row.doc_id), row


def test_against_all_pairs(documents, corpus):
    check(documents, [(i, t) for i, t, _ in corpus], 4)


def test_large_group_of_copies(spark):
    """Copies around one text at all distances, some of them linked with nothing."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    pairs = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 9)):
            own[k] = f"c{i}x{k}"
        pairs.append((i, " ".join(own)))
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    _, labels = expected(pairs, 5)
    assert 1 < len(set(labels.values())) < 140
    check(frame, pairs, 5)


def test_empty_table(nothing):
    found = neardup.near_duplicates(nothing)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found.count() == 0


def test_keys_tell_sets_apart():
    texts = pa.array(["a b c d e f", "a b c d e f", "a b c d e g", "a b", "b a", None])
    batch = pa.record_batch([texts], names=["text"])
    sets = neardup._sets(batch, 5)
    keys = [neardup.set_key(s) for s in sets]
    assert keys[0] == keys[1] and len(set(keys[1:5])) == 4 and len(sets[5]) == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)]
    links += [(9, 9), (600, 601), (601, 600), (600, 601)]
    links += [(rng.randrange(700, 800), rng.randrange(700, 800)) for _ in range(70)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r.id: r.label for r in components.connected(frame).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == labels_of(nodes, [x for x in links if x[0] != x[1]])
    assert components.connected(frame.limit(0)).count() == 0
