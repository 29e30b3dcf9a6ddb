"""Licence scan: Dice coefficient over word bigrams between text and licence templates.

Normalised words are [a-z0-9]+ after lower-casing A-Z; everything else separates. The units
compared are every \\n-split line of a text, and the whole text. Two sets of bigrams of sizes a
and b can reach a Dice coefficient of at least t only if b * t / (2 - t) <= a <= b * (2 - t) / t,
so each unit is compared only with templates inside these bounds.

Per row: doc_id, license (the most alike template, the first by name among equals; NULL below
THRESHOLD), dice (its coefficient; NULL likewise), n_notices (lines at or above the threshold).
NULL and empty texts have none. Ids may be NULL or repeated; each row is judged for itself, in
place, without a shuffle. Other columns are not used. All steps are DataFrame expressions.

scanned() is that much. licensed() also slides a window of each template's length over all words
of a text, so that line breaks and surrounding words do not matter, for the notices and for the
licence texts and file headers of licence_texts.py. A window begins at a bigram of the template,
and a template is tried where the text has as many of its bigrams as a hit needs at least. A text
or header found names the licence, as notices stand inside of them; then the notices of lines and
whole texts; then notices in windows. The column passages has the best window of every template
found (name, dice, start: the word it begins at, from 0).

Most texts are settled by single words. A hit shares at least `need` of a template's b bigrams,
whatever the unit, so it lacks at most b - need of them. For every template more than that many of
its bigrams hold a telling word (`telling_words`), so a text without any of these words has no hit
and is not paired at all. Texts with one are compared in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm.licence_texts import TEXTS

THRESHOLD = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Usual one-line notices, by licence.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Released under the ISC License.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


HITS = "array<struct<dice:double,name:string>>"
PASSAGES = "array<struct<name:string,dice:double,start:int,is_text:boolean>>"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Set sizes that can reach the threshold with a template of this size."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


#: Words of all prose; other words are taken as telling ones first.
COMMON = frozenset((
    "a all an and any are as at be been by do for from has have if in is it its may more no not of on "
    "one or other s shall such that the their there these they this to use was we which will with "
    "you your"
).split())


def least_shared(size: int, threshold: float) -> int:
    """Bigrams that a hit shares with a template of this many at least."""
    return math.ceil(bounds(size, threshold)[0] - 1e-9)


def telling_words(templates: Iterable[str], threshold: float) -> list[str]:
    """Words of which every hit of any template holds one.

    Chosen greedily: the word in the most bigrams of templates that are not covered yet, short and common
    words last. A template is covered when more of its bigrams hold a chosen word than a hit may
    lack.
    """
    open_sets = []
    for text in templates:
        grams = {tuple(gram.split(" ")) for gram in template_bigrams(text)}
        lacking = len(grams) - least_shared(len(grams), threshold)
        open_sets.append((grams, lacking + 1))
    chosen: list[str] = []
    while open_sets:
        votes = Counter(word for grams, _ in open_sets for gram in grams for word in set(gram))
        best = min(votes, key=lambda x: (x in COMMON, len(x) < 6, -votes[x], x))
        chosen.append(best)
        left = []
        for grams, still in open_sets:
            without = {gram for gram in grams if best not in gram}
            still -= len(grams) - len(without)
            if still > 0:
                left.append((without, still))
        open_sets = left
    return sorted(chosen)


def _pairs(words: Column) -> Column:
    count = F.size(words) - 1
    pairs = F.zip_with(
        F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(count > 0, pairs).otherwise(F.array().cast("array<string>"))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _lower() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)


def _whole_words() -> Column:
    return F.split(F.trim(F.regexp_replace(_lower(), "[^a-z0-9]+", " ")), " ")


def scanned(
    documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Lines and whole texts beside the templates; `carried` names columns to pass on."""
    grams = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    limits = {name: bounds(len(own), threshold) for name, own in grams.items()}
    least, most = min(a for a, _ in limits.values()), max(b for _, b in limits.values())
    table = F.array(*(
        F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("grams"),
            F.lit(len(own)).alias("size"),
            F.lit(limits[name][0]).alias("low"), F.lit(limits[name][1]).alias("high"),
        )
        for name, own in grams.items()
    ))

    def compared(unit: Column) -> Column:
        """Coefficients of one unit with the templates inside the bounds."""
        size = F.size(unit)
        return F.transform(
            F.filter(table, lambda t: (size >= t["low"]) & (size <= t["high"])),
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(unit, t["grams"])) / (size + t["size"])).alias("dice"),
                t["name"].alias("name"),
            ),
        )

    by_line = F.split(F.regexp_replace(_lower(), "[^a-z0-9\n]+", " "), "\n")
    line_words = F.transform(by_line, lambda line: F.split(F.trim(line), " "))
    units = F.transform(F.concat(line_words, F.array(_whole_words())), _bigrams)
    # units outside the bounds stay as NULL, so that the whole text is the last one
    kept = F.transform(
        units,
        lambda unit: F.when(
            (F.size(unit) >= least) & (F.size(unit) <= most),
            F.filter(compared(unit), lambda x: x["dice"] >= threshold),
        ),
    )
    found = documents.select("doc_id", kept.alias("kept"), *carried)
    lines = F.slice("kept", F.lit(1), F.size("kept") - 1)
    every = F.flatten(F.filter("kept", lambda own: own.isNotNull()))
    found = found.select(
        "doc_id", every.alias("every"),
        F.size(F.filter(lines, lambda own: F.size(F.coalesce(own, F.array().cast(HITS))) > 0)).alias("n"),
        *carried,
    )
    best = F.array_max(F.transform("every", lambda x: x["dice"]))
    named = F.filter("every", lambda x: x["dice"] == F.col("dice"))
    return found.withColumn("dice", best).select(
        "doc_id", F.array_min(F.transform(named, lambda x: x["name"])).alias("license"),
        "dice", F.col("n").cast("long").alias("n_notices"), *carried,
    )


def _passages(pairs: Column, shared: Column, templates: list[tuple[str, str, bool]], threshold: float) -> Column:
    """name, dice, start and whether a text (not a notice), of each template's best window."""
    rows = []
    for name, text, is_text in templates:
        own = template_bigrams(text)
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(is_text).alias("is_text"), F.array(*map(F.lit, own)).alias("grams"),
            F.lit(len(own)).alias("size"), F.lit(len(re.findall("[a-z0-9]+", text.lower())) - 1).alias("span"),
            F.lit(bounds(len(own), threshold)[0]).alias("need"),
        ))
    able = F.filter(
        F.array(*rows),
        lambda t: (F.size(shared) >= t["need"]) & (F.size(F.array_intersect(t["grams"], shared)) >= t["need"]),
    )

    def best(t: Column) -> Column:
        def window(i: Column) -> Column:
            own = F.array_distinct(F.slice(pairs, i, t["span"]))
            dice = F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["size"])
            return F.struct((-dice).alias("far"), (i - 1).alias("start"))

        starts = F.filter(
            F.sequence(F.lit(1), F.size(pairs)), lambda i: F.array_contains(t["grams"], F.element_at(pairs, i)))
        return F.struct(F.array_min(F.transform(starts, window)).alias("at"), t["name"].alias("name"),
                        t["is_text"].alias("is_text"))

    found = F.filter(F.transform(able, best), lambda x: x["at"]["far"] <= -threshold)
    return F.transform(found, lambda x: F.struct(
        x["name"].alias("name"), (-x["at"]["far"]).alias("dice"), x["at"]["start"].alias("start"),
        x["is_text"].alias("is_text")))


def known_templates() -> list[tuple[str, str, bool]]:
    """Name, text and whether a licence text or header (not a notice)."""
    notices = [(name, text, False) for name, text in TEMPLATES.items()]
    return notices + [(name, text, True) for name, text in TEXTS]


def licensed(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, n_notices and passages."""
    templates = known_templates()
    known = sorted({gram for _, text, _ in templates for gram in template_bigrams(text)})
    telling = F.array(*map(F.lit, telling_words([text for _, text, _ in templates], threshold)))
    # a text that cannot have a hit goes on as NULL, which has none
    documents = documents.select(
        "doc_id", F.when(F.arrays_overlap(_whole_words(), telling), F.col("text")).alias("text")
    )
    paired = documents.select("doc_id", "text", _pairs(_whole_words()).alias("pairs"))
    shared = F.array_distinct(F.filter("pairs", lambda gram: gram.isin(known)))
    paired = paired.select("doc_id", "text", "pairs", shared.alias("shared"))
    # most texts have fewer of the bigrams than any template needs
    least = min(bounds(len(template_bigrams(text)), threshold)[0] for _, text, _ in templates)
    passages = _passages(F.col("pairs"), F.col("shared"), templates, threshold)
    placed = paired.select(
        "doc_id", "text",
        F.when(F.size("shared") >= least, passages).otherwise(F.array().cast(PASSAGES)).alias("passages"))
    found = scanned(placed, threshold=threshold, carried=("passages",))

    def first(is_text: bool) -> Column:
        own = F.filter("passages", lambda x: x["is_text"] == F.lit(is_text))
        return F.array_min(F.transform(own, lambda x: F.struct((-x["dice"]).alias("far"), x["name"].alias("name"))))

    found = found.select("*", first(True).alias("text"), first(False).alias("notice"))
    return found.select(
        "doc_id", F.coalesce("text.name", "license", "notice.name").alias("license"),
        F.coalesce(-F.col("text.far"), "dice", -F.col("notice.far")).alias("dice"), "n_notices",
        F.transform("passages", lambda x: x.dropFields("is_text")).alias("passages"),
    )
