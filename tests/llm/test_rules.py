"""Decontamination, URL rules and licence scan beside plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bloomgrid.llm import decontaminate, license_scan, url_rules

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def hits(text, items):
    own, at, found = words(text), set(), set()
    for item, wanted in items:
        w = words(wanted)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    at.update(range(k, k + len(window)))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(at), len(found), digest, bool(at)


@pytest.fixture(scope="module")
def contaminated_corpus(corpus):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices("the of and to in is it on at by for".split() + [f"u{k}"], k=30)))
             for k in range(12)]
    items += [(50, "short phrase here"), (51, None), (52, "!!"), (53, items[0][1]), (53, items[0][1])]
    pairs = [(i, t) for i, t, _ in corpus if not t or len(t) < 3000]
    for k in range(30):
        item = words(items[k % 12][1])
        start = rng.randrange(0, 15)
        passage = " ".join(item[start : start + rng.randrange(8, 25)]).upper()
        pairs.append((1000 + k, f"{pairs[k][1]} ({passage}) {passage}; Short, PHRASE here."[: 2000 + k]))
    pairs += [(2000, "the of and " * 200), (None, "x " + items[1][1]), (2001, "short phrase"), (2002, "short  phrase\nhere")]
    return pairs, items


def test_decontamination(spark, contaminated_corpus, monkeypatch):
    pairs, items = contaminated_corpus
    frame = spark.createDataFrame(
        [(i, t, "x", "x") for i, t in pairs], "doc_id long, text string, key string, window string"
    ).repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *hits(t, items)) for i, t in pairs)
    for block in (decontaminate.BLOCK_WINDOWS, 40):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        rows = decontaminate.contaminated(frame, tests).collect()
        assert sorted((str(r[0]), *r[1:6]) for r in rows) == want


def test_decontamination_of_nothing(spark, nothing, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    tests = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated(nothing, tests).count() == 0
    rows = decontaminate.contaminated(documents, none).collect()
    assert len(rows) == documents.count() and not any(r.contaminated for r in rows)


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma x x x alpha beta")],
                                  "doc_id long, text string")
    terms = ["alpha", "beta", "gamma"]
    index = decontaminate.postings(texts, terms, 1)
    windows = spark.createDataFrame([(0, [0, 1, 2])], "window int, terms array<int>")
    doc = {r["key"]: r["doc_id"] for r in index.collect()}
    assert {doc[r["key"]] for r in decontaminate.matches(index, windows).collect()} == {2}
    assert {doc[r["key"]] for r in decontaminate.matches(index, windows, slack=1).collect()} == {1, 2}


def near(text, items, slack):
    """Items with a window for which some begin has every term near its place."""
    own, found = words(text), set()
    places = {}
    for at, word in enumerate(own):
        places.setdefault(word, set()).add(at)
    for item, wanted in items:
        w = words(wanted)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            if any(all(any(b + k + d in places.get(term, ()) for d in range(-slack, slack + 1))
                       for k, term in enumerate(window)) for b in range(-slack, len(own))):
                found.add(str(item))
    return found


def test_proximity_of_whole_tables(spark, contaminated_corpus):
    pairs, items = contaminated_corpus
    long = [(i, t) for i, t in items if i < 50]  # no item of few words: runs are long
    passage = words(long[2][1])
    spread = " outside ".join(" ".join(passage[i : i + 9]) for i in range(0, len(passage), 9))
    rows = [(9001, spread), (9002, " ".join(passage)), (9003, " ".join(passage[::-1])), (9004, None)]
    frame = spark.createDataFrame([*rows, *pairs[:30], *[p for p in pairs if (p[0] or 0) >= 1000]], "doc_id long, text string")
    texts = [r.text for r in frame.collect()]
    got = decontaminate.contaminated(frame, spark.createDataFrame(long, "item_id long, text string"), slack=1).collect()
    assert len(got) == len(texts)
    want = sorted((str(r.doc_id), *hits(r.text, long)) for r in frame.collect())
    assert sorted((str(r[0]), *r[1:6]) for r in got) == want
    close = sorted((str(r.doc_id), sorted(near(r.text, long, 1))) for r in frame.collect())
    assert sorted((str(r.doc_id), r.near_items) for r in got) == close
    assert all(r.n_near == len(r.near_items) >= r.n_items for r in got)
    one = {r.doc_id: r for r in got}
    assert "2" in one[9001].near_items and not one[9001].contaminated
    assert "2" in one[9002].near_items and one[9002].contaminated and one[9004].near_items == []


def test_gaps_in_runs():
    member = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1, 1], bool)
    rows = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    assert decontaminate.long_runs(member, rows, 3).sum() == 0
    assert list(np.flatnonzero(decontaminate.long_runs(member, rows, 3, 3))) == [0, 2, 3]


URLS = [
    "http://example.com/en/1", "https://a.b.example.com/en/x", "http://notexample.com/en/", "http://example.com/EN/",
    "http://www.example.com/en/", "http://x.www.example.com/en/y?z", "http://WWW.Example.COM/en/", "http://foo.net/es/1",
    "http://foo.net/fr/", "http://net/fr/", "http://foo.net/de/", "http://foo.org/es/", "http://foo.com", "http://foo.com?/",
    "http://foo.com/", "ftp://foo.com#/x", "no scheme.com/en/", "", None, "http://", "http:///en/", "a://b://example.com/en/",
    "http://ads.foo.org/x", "http://badads.foo.org/x", "http://foo.org/a/adserver/x", "http://foo.org/adserver",
    "http://foo.org/banner/12/x", "http://foo.org/click/track/", "http://foo.org/clicks/track/", "http://casino.org/",
    "http://foo.net:80/es/", "http://foo.net/es", "http://example.com\n/en/", "http://foo.net/x\n/es/", "http://u@foo.net/fr/?q#h",
    "http://adserver.example.com/en/", "http://foo.org/doorway/a/", "http://foo.org/" + "a/" * 3000,
]


def judged(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host):])[0]
    host = host.translate(LOWER)
    fits = [r for r in url_rules.HOST_RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    if best:
        return host, path, best.text, best.verdict
    bad = any(re.search(r.pattern, f"{host}\n{path}") for r in url_rules.PATTERN_RULES)
    return host, path, None, "block" if bad else "allow"


def test_url_rules(spark):
    rows = [(k % 30, url, "x", "x") for k, url in enumerate(URLS)] + [(None, URLS[0], "x", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, token string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in url_rules.judged(frame).collect())))
    assert got == sorted(str((k, *judged(url))) for k, url, _, _ in rows)
    assert url_rules.judged(frame.limit(0)).count() == 0


def test_rarest_token_is_the_key(spark):
    tokens = spark.createDataFrame([("com",)] * 5 + [("en",)] * 3 + [("example",)], "token string")
    rules = url_rules.rule_table(spark, url_rules.HOST_RULES)
    got = {r.rule_text: r.token for r in url_rules.with_rarest_token(rules, tokens).collect()}
    assert got["com/"] == "com" and got["example.com/en/"] == "example"
    assert got["www.example.com/en/"] == "www"


def scanned(text, templates, threshold):
    def grams(unit):
        w = re.findall("[a-z0-9]+", unit.translate(LOWER))
        return set(zip(w, w[1:], strict=False))

    units = [*(text or "").split("\n"), text or ""]
    hits, lines = [], 0
    for k, unit in enumerate(units):
        own = grams(unit)
        good = []
        for name, body in templates.items():
            t = grams(body)
            dice = 2 * len(own & t) / (len(own) + len(t))
            if dice >= threshold:
                good.append((-dice, name))
        hits += good
        lines += bool(good) and k < len(units) - 1
    best = min(hits, default=None)
    return (best[1], -best[0], lines) if best else (None, None, 0)


def test_licence_scan(spark, corpus):
    rng = random.Random(12)
    pairs = [(i, t) for i, t, _ in corpus]
    for k, (name, body) in enumerate(license_scan.TEMPLATES.items()):
        pairs += [
            (3000 + k, f"some text here\n{body}\nmore text"), (3100 + k, body.upper()),
            (3200 + k, body.replace(" ", "\n")), (3300 + k, " ".join(rng.sample(body.split(" "), len(body.split(" "))))),
            (3400 + k, body.replace(" the ", " a ") + " indeed"), (3500 + k, (body + " ") * 40),
        ]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in pairs],
                                  "doc_id long, text string, dice string, license string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in license_scan.scanned(frame).collect())))
    want = sorted(str((i, *scanned(t, license_scan.TEMPLATES, license_scan.THRESHOLD))) for i, t in pairs)
    assert got == want
    assert license_scan.scanned(frame.limit(0)).count() == 0


def test_licences_inside_of_texts(spark):
    texts = dict(license_scan.TEXTS)
    around = "some words that say nothing about it " * 30
    cases = {
        "apache-2.0": "Copyright 2020 X. Licensed under the Apache License, Version 2.0. See LICENSE for details.",
        "mit": f"MIT License\n\nCopyright (c) 2020 X\n\n{texts['mit']}",
        "isc": f"{around}\nit is Released under\nthe ISC License. {around}",
        "bsd-3-clause": f"Copyright 2020\nAll rights reserved.\n\n{texts['bsd-3-clause']}",
        "bsd-2-clause": texts["bsd-2-clause"],
        "gpl-2.0": "# " + dict(license_scan.TEXTS[::-1])["gpl-2.0"].replace(" is ", "\n# is ") + "\nimport os\n" + around,
        "gpl-3.0": "/* " + dict(license_scan.TEXTS[::-1])["gpl-3.0"].replace(", ", ",\n * ") + " */" + around,
        None: around,
    }
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(cases.values())] + [(99, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.licensed(frame).collect()}
    assert [rows[k].license for k in range(len(cases))] == list(cases)
    assert rows[0].dice == 1.0 and [(p.name, p.start) for p in rows[0].passages] == [("apache-2.0", 3)]
    assert rows[2].dice == 1.0 and rows[99].license is None and rows[99].passages == []
    assert "all-rights-reserved" in {p.name for p in rows[3].passages}


def test_size_bounds_are_safe():
    for size in range(1, 30):
        low, high = license_scan.bounds(size, 0.7)
        for other in range(1, 80):
            most = 2 * min(size, other) / (size + other)
            assert low <= other <= high or most < 0.7


def brute_licensed(text):
    """license, dice, n_notices by plain loops over lines, the whole text and all windows."""
    alone = scanned(text, license_scan.TEMPLATES, license_scan.THRESHOLD)
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pairs = list(zip(words, words[1:], strict=False))
    found = {True: [], False: []}
    for name, body, is_text in license_scan.known_templates():
        own = re.findall("[a-z0-9]+", body.lower())
        grams, span = set(zip(own, own[1:], strict=False)), len(own) - 1
        for at in range(len(pairs)):
            if pairs[at] in grams:
                window = set(pairs[at : at + span])
                dice = 2 * len(window & grams) / (len(window) + len(grams))
                if dice >= license_scan.THRESHOLD:
                    found[is_text].append((-dice, name))
    for hits in (found[True], None, found[False]):
        if hits is None and alone[0] is not None:
            return alone
        if hits:
            return min(hits)[1], -min(hits)[0], alone[2]
    return None, None, alone[2]


def test_licensed_beside_brute_force(spark, corpus):
    rng = random.Random(9)
    pairs = [(i, t) for i, t, _ in corpus if t is None or len(t) < 3000]
    bodies = [body for _, body, _ in license_scan.known_templates()]
    prose = [t for _, t in pairs if t and len(t) > 200]
    for k in range(60):
        words = rng.choice(bodies).split()
        for _ in range(rng.choice([0, 1, len(words) // 8, len(words) // 4])):
            words[rng.randrange(len(words))] = rng.choice(["xq", "the", "software"])
        cut = rng.choice([words, words[: len(words) * 3 // 4], words[len(words) // 3 :]])
        glue = rng.choice([" ", "\n", "  * "])
        pairs.append((1000 + k, f"{rng.choice(prose)[:200]} {glue.join(cut)}{rng.choice([' ', chr(10)])}{rng.choice(prose)[:200]}"))
    pairs += [
        (2000, "Copyright 2020 X. Licensed under the Apache License, Version 2.0. See LICENSE for details."),
        (2001, "it is Released under\nthe ISC License. and more"), (2002, "All rights reserved. " * 3000),
        (2003, "rights reserved"), (2002, "All rights reserved. " * 3000), (None, None),
    ]
    rows = [(t, i, 0.5, "x", 1, [1]) for i, t in pairs]
    schema = "text string, doc_id long, dice double, license string, n_notices int, passages array<int>"
    frame = spark.createDataFrame(rows, schema).repartition(4)
    short = [(i, t) for i, t in pairs if not t or len(t) < 20_000]
    got = {(r.doc_id, r.license, r.dice, r.n_notices) for r in license_scan.licensed(frame).collect()}
    assert {(i, *brute_licensed(t)) for i, t in short} <= got
    assert license_scan.licensed(frame).count() == len(pairs)
    assert license_scan.licensed(frame.limit(0)).count() == 0
    assert any(r[1] == "all-rights-reserved" and r[0] == 2002 for r in got)


def test_every_hit_holds_a_telling_word():
    rng = random.Random(3)
    bodies = [body for _, body, _ in license_scan.known_templates()]
    telling = set(license_scan.telling_words(bodies, license_scan.THRESHOLD))
    assert len(telling) < 150
    for body in bodies:
        grams = [g.split(" ") for g in license_scan.template_bigrams(body)]
        need = license_scan.least_shared(len(grams), license_scan.THRESHOLD)
        # the adversary keeps the bigrams without telling words first
        plain = [g for g in grams if not telling & set(g)]
        assert len(plain) < need
        for _ in range(20):
            assert telling & set(sum(rng.sample(grams, need), []))
