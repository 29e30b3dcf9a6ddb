"""Language, quality rules, quality classifier and HTML extraction."""

import random
import re
import zlib

import numpy as np
import pytest
from conftest import SYLLABLES
from pyspark.sql import functions as F

from bloomgrid.llm import compression, html_blocks, language, lstm, markup, quality_rules


def held(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


def test_language_of_held_out_documents(documents, corpus):
    rows = language.identify(documents, size=60).collect()
    assert len(rows) == len(corpus)
    langs = {i: lang for i, t, lang in corpus if t and len(t) > 100 and 0 <= (i or -1) < 300}
    right = total = 0
    for row in rows:
        assert row.held_out == held(row.doc_id, 4, 2) and 0 <= row.score <= 1
        if row.held_out and row.doc_id in langs:
            total += 1
            right += row.lang_pred == langs[row.doc_id]
    assert total > 20 and right / total > 0.95
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].lang_pred for i in (400, 401, 402, 406)} == {"und"}
    assert by_id[403].lang_pred != "und" and by_id[409].lang_pred != "und"


def test_language_without_training_rows(nothing, documents):
    assert language.identify(nothing).count() == 0
    unknown = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def test_families_come_first():
    rng = np.random.default_rng(0)
    rows = rng.random((120, 6)).astype(np.float32) * 0.1
    langs = [["en", "de", "fr", "es", "xx"][i % 5] for i in range(120)]
    for i, lang in enumerate(langs):
        rows[i, "en de fr es xx".split().index(lang)] += 1
    model = language.fit(langs, rows)
    assert model.families == ["germanic", "romance", "xx"]
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    assert model.predict(rows)[0] == langs


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    at = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(at))


def test_base_statistics_and_verdicts(documents, corpus):
    rows = quality_rules.judged(documents).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def lowered(text):  # windows are compared without regard to ASCII case
        return text

    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in rows)
    want = sorted((str(i), *base(lowered(t) if t and len(t) < 60_000 else t)) for i, t, _ in corpus)
    assert got == want
    for row in rows:
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed == failed and not (failed and row.kept)
        if row.doc_id is not None and 0 <= row.doc_id < 300 and not failed:
            assert row.kept, row
    junk = [row.kept for row in rows if row.doc_id is not None and 300 <= row.doc_id < 340]
    assert sum(junk) <= 0.2 * len(junk)  # a fifth of this small corpus is junk itself


def test_distance_is_jensen_shannon():
    share = np.array([0.5, 0.5, 0.0])
    got = quality_rules.distance(np.array([[5.0, 5, 0], [0, 0, 7], [2, 0, 0]]), share)
    assert got[0] == 0 and got[1] == 1
    m = np.array([0.75, 0.25])
    want = np.sqrt((np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2)
    assert got[2] == pytest.approx(want)


def test_rules_on_an_empty_table(nothing):
    assert quality_rules.judged(nothing).count() == 0
    assert quality_rules.accepted(nothing).columns == nothing.columns


def test_compression_classifier(spark, documents, corpus):
    known = [(i, 0 if 300 <= i < 340 else 1, 0) for i, t, _ in corpus if i is not None and 0 <= i < 340 and t]
    labels = spark.createDataFrame([*known, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = compression.classified(documents, labels).collect()
    assert len(rows) == len(corpus)
    right = total = 0
    truth = {i: q for i, q, _ in known}
    for row in rows:
        assert row.held_out == held(row.doc_id, 3, 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
        if row.held_out and row.doc_id in truth:
            total += 1
            right += row.predicted == truth[row.doc_id]
    assert total > 40 and right / total > 0.9
    one = compression.classified(documents, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {0.5}


def page(rng, lang, extra=""):
    def some(n):
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=2)) for _ in range(n))

    paragraphs = [some(rng.randint(8, 60)) + " &amp; x." for _ in range(rng.randint(2, 7))]
    title = some(6)
    html = (
        f"<!DOCTYPE html><html><head><title>{some(4)}</title><style>p{{margin:0}}</style>"
        f"<script>var t='</p>';</script></head><body><nav><ul>"
        + "".join(f'<li><a href="/{k}">{some(1)}</a></li>' for k in range(6))
        + f'</ul></nav><!-- <p>no</p> --><div class="ad">{some(8)}</div><article><h1>{title}</h1>'
        + "".join(f"<p>{p}</p>" for p in paragraphs)
        + f"{extra}</article><footer>&copy; {some(7)}</footer></body></html>"
    )
    return html, "\n".join([title, *(p.replace("&amp;", "&") for p in paragraphs)])


def test_extraction_of_whole_pages(spark):
    rng = random.Random(2)
    made = [page(rng, rng.choice(list(SYLLABLES))) for _ in range(60)]
    rows = [(k, f"http://x/{k}", html, "x") for k, (html, _) in enumerate(made)]
    long_html = made[0][0].replace("</article>", "<p>tail words here.</p>" * 3000 + "</article>")
    rows += [(100, None, None, "x"), (None, "u", "", "x"), (101, "u", long_html, "x"), (3, "again", made[3][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    found = html_blocks.extracted(pages, html_blocks.train(pages)).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.n_chars == len(row.text)
        if row.page_id is not None and row.page_id < 60:
            assert row.text == made[row.page_id][1]
        elif row.page_id == 101:
            assert row.text == made[0][1] + "\ntail words here." * 3000
        else:
            assert row.text == ""


def test_labeller_knows_boilerplate_inside_articles():
    rng = random.Random(5)
    made = [page(rng, "en")[0] for _ in range(120)]
    model = html_blocks.fit(made)
    extra = (
        '<aside><p>read more here</p></aside><form><label>mail</label></form>'
        '<div class="comments"><p>first comment from a reader</p></div>'
        '<div class="cookie-notice"><p>we use cookies here</p></div>'
    )
    wrong = 0
    for _ in range(20):
        html, text = page(rng, "en", extra)
        blocks = markup.blocks(html)
        chances = lstm.predict(model, [html_blocks.vectors(blocks)])[0]
        wrong += "\n".join(b.text for b, c in zip(blocks, chances, strict=True) if c >= 0.5) != text
    assert wrong <= 1


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "u", "<p>text</p>")], "page_id long, url string, html string")
    assert html_blocks.train(pages) is None
    assert html_blocks.extracted(pages, None).first().text == ""
    assert html_blocks.extracted(pages.limit(0), None).count() == 0


def test_few_and_long_pages_that_tell_are_found(spark):
    rng = random.Random(21)
    made = [page(rng, "en", "<p>tail words here.</p>" * 1600) for _ in range(12)]
    assert all(len(html) > 32_768 for html, _ in made)
    schema = "page_id long, url string, html string"
    longs = [(k, "u", html) for k, (html, _) in enumerate(made)]
    found = html_blocks.extracted(
        spark.createDataFrame(longs, schema), html_blocks.labeller(spark.createDataFrame(longs, schema))).collect()
    good = sum(r.text == made[r.page_id][1] + "\ntail words here." * 1600 for r in found)
    assert good == len(made)
    # one page of 600 tells; the sample is 3
    others = [(k, "u", f"<body><div>some text {k}</div></body>") for k in range(100, 699)]
    assert html_blocks.train(spark.createDataFrame([*others, longs[0]], schema).repartition(4), 3) is not None


def test_pages_that_do_not_tell_are_labelled(spark):
    rng = random.Random(22)
    made = [page(rng, "en") for _ in range(30)]
    rows = [(k, "u", html.replace("article>", "div>")) for k, (html, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_blocks.train(pages) is None
    found = html_blocks.extracted(pages, html_blocks.labeller(pages)).collect()
    assert sum(r.text == made[r.page_id][1] for r in found) >= 27


def test_blocks_of_broken_markup():
    html = "a<b>b</b> c<p><b>one<br><p>two &lt;x&gt; <i>t</i>hree<script>if (a<b) {}</script><li>x<li>y<td"
    assert [b.text for b in markup.blocks(html)] == ["ab c", "one", "two <x> three", "x", "y<td"]
    assert markup.blocks("<!-- open <p>x") == [] and markup.blocks("<script>x") == []


def test_gradients_of_the_lstm():
    rng = np.random.default_rng(3)
    model = lstm.fresh(4, 3, 1)
    x, real = lstm.pad([rng.normal(size=(n, 4)).astype(np.float32) for n in (5, 3)])
    labels = (rng.random(real.shape) < 0.5).astype(np.float32)

    def loss():
        p = model.forward(x, real)[0].astype(float)
        return -np.where(real, labels * np.log(p) + (1 - labels) * np.log(1 - p), 0).sum() / real.sum()

    for parameter, gradient in zip(model.parameters(), model.gradients(x, real, labels), strict=True):
        at = tuple(rng.integers(0, n) for n in parameter.shape)
        old = parameter[at]
        parameter[at] = old + 1e-2
        up = loss()
        parameter[at] = old - 1e-2
        down = loss()
        parameter[at] = old
        assert gradient[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_samples_are_bounded_however_rows_repeat(spark):
    from bloomgrid.llm import hashing

    same_id = spark.range(20_000).selectExpr(
        "7 AS doc_id", "concat('text ', id) AS text", "IF(id % 2 = 0, 'a', 'b') AS lang")
    rows = hashing.sample(same_id, "lang", 300).groupBy("lang").count().collect()
    assert len(rows) == 2 and all(200 < r["count"] < 400 for r in rows)
    five_ids = spark.range(20_000).selectExpr("id % 5 AS doc_id", "concat('t', id % 5) AS text", "'a' AS lang")
    assert hashing.sample(five_ids, "lang", 300).count() == 5
    copies = spark.range(20_000).selectExpr("1 AS doc_id", "'t' AS text", "'a' AS lang")
    assert hashing.sample(copies, "lang", 300).count() == 1
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "'a' AS lang")
    assert 200 < hashing.sample(many, "lang", 300).count() < 400


def test_classifier_learns_from_whole_texts_of_its_own_rows(spark):
    import random

    rng = random.Random(31)

    def prose(words):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(words))

    # what tells good from bad begins behind the first 6,000 bytes
    good, bad = [prose(6) for _ in range(40)], [prose(6) for _ in range(40)]
    rows = []
    for i in range(240):
        tail = " ".join(rng.choice(good if i % 2 else bad) for _ in range(400))
        rows.append((i, prose(1200)[:6000] + " " + tail))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    # labels of documents that are elsewhere change nothing
    elsewhere = spark.createDataFrame([(10_000 + i, 0) for i in range(5000)], "doc_id long, quality int")
    found = compression.classified(documents, labels.unionByName(elsewhere)).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 50
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95
    copies = documents.unionByName(documents.limit(1)).unionByName(documents.limit(1))
    assert compression.train(copies, labels) is not None


def test_deep_and_broken_pages_take_time_by_their_length():
    import time

    pages = [
        "<b><div>x " * 30_000, "<b>x " * 60_000, "<a href='" * 30_000, "<a " * 90_000 + "'", "<! " * 90_000,
        "<a href='x\" " * 25_000 + "<p>end</p>", "".join(f"<x{k}>y " for k in range(20_000)),
    ]
    for html in pages:
        begin = time.perf_counter()
        blocks = markup.blocks(html)
        for at in range(0, len(blocks), 2048):
            html_blocks.vectors(blocks, at, at + 2048)
        assert time.perf_counter() - begin < 8, html[:20]
    assert len(markup.blocks(pages[0])) == 30_000 and len(markup.blocks(pages[0])[-1].path) == 60_000
    assert list(markup.blocks("<div class=x><p>a")[0].path) == ["div", ".x", "p"]


def test_long_sequences_share_no_batch_with_short_ones():
    import tracemalloc

    rng = np.random.default_rng(1)
    model = lstm.fresh(5, 12, 1)
    sequences = [rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 0, 900, 7, 60_000, 40)]
    tracemalloc.start()
    found = lstm.predict(model, sequences)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for x, own in zip(sequences, found, strict=True):
        if len(x) and len(x) < 10_000:
            want = model.forward(x[:, None], np.ones((len(x), 1), bool))[0][:, 0]
            assert np.allclose(own, want, atol=1e-5)
    assert [len(x) for x in found] == [3, 0, 900, 7, 60_000, 40]
