import random

import pytest

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as".split(),
    "de": "sch ein ich der und die den ung cht ver ber gen zu ge auf mit keit lich ö ü ß".split(),
    "fr": "eau oi es que le ent ai ou ment tion la les é è ç aux ier re un ch eux".split(),
    "es": "ci ón os as que la de el ado ar mente ra en ñ ll ga co ez ía rr bo".split(),
}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def text(rng, lang, words):
    lines, line = [], []
    for _ in range(words):
        line.append(word(rng, lang))
        if rng.random() < 0.08:
            lines.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*lines, " ".join(line)])


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, label int, "
    "n_words int, held_out int, component string, set_key string, places string, id long"
)


def rows_of(pairs):
    """Rows of documents with further columns whose names the operators use themselves."""
    return [
        (i, t, lang, "s", None if t is None else len(t), "x", 1, 1, 1, "x", "x", "x", 1)
        for i, t, lang in pairs
    ]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): prose, copies, junk, empty, NULL, long, odd characters, repeats."""
    rng = random.Random(17)
    found = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        found.append((i, text(rng, lang, rng.choice([5, 30, 60, 120, 250])), lang))
    for i in range(40):  # copies with few changed words
        base = found[i % 10][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = word(rng, "en")
        found.append((200 + i, " ".join(base), found[i % 10][2]))
    for i in range(40):
        junk = [w + rng.choice(["***", "&&&", "$$$", "###"]) for w in text(rng, "en", 80).split(" ")]
        found.append((300 + i, " ".join(junk), "en"))
    found += [
        (400, None, "en"), (401, "", "en"), (402, " \n\t ", None), (403, "a", None),
        (404, "one two three", "en"), (405, "One TWO three", "en"), (None, "no id here at all", "en"),
        (None, None, None), (406, "123 456 --- !!!", "en"), (407, text(rng, "en", 6000), "en"),
        (408, "x" * 70_000, "en"), (409, "日本語 テキスト 🙂 é e\u0301 ﬁ\u00a0b\u2003c", None),
        (410, "again and again " * 30, "en"), (410, "again and again " * 30, "en"),
        (411, "don't I'LL <|endoftext|>x<|startoftext|> we've \x1c\x1d \x85", "en"),
        (-5, found[3][1], "de"),
    ]
    return found


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(rows_of(corpus), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
