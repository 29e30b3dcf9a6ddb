"""Main-text extraction: a recurrent labeller over the blocks of a page.

A page is read as its sequence of text blocks (markup.blocks). A block's vector has hashed tokens
of its tag path (element names, class, id and role words), hashed words, and a few sizes. A
bidirectional LSTM reads the whole sequence and classifies every block with the page as context;
blocks of label 1, joined by line breaks, are the text.

No page comes labelled, so the labeller learns from the pages whose own structure tells: blocks
inside an article or main element, and not inside menus, headers, footers, sidebars, notices,
adverts, forms or comments, are main text. To learn the context and the words of such containers
beyond the templates at hand, training pages are varied: blocks of other pages are put in as
boilerplate of all kinds, and article elements are renamed. The tasks find such pages in the
whole table, whatever their length and share, and the SAMPLE of them with the least hashes is
taken; of a long page at most LEARNED_BLOCKS blocks and about LEARNED_CHARS characters are learned
from. Fewer than SAMPLE such pages are filled up with invented ones, which have many kinds of
containers; a table without any is labelled by what those alone teach.

NULL and empty html have an empty text. Without a model (None) all texts are empty.
Page ids may be NULL or repeated; each row is worked on for itself. Other columns are not used.
"""

from __future__ import annotations

import json
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import lstm, markup
from bloomgrid.llm.batches import map_texts

SAMPLE, LEARNED_BLOCKS, LEARNED_CHARS = 250, 300, 65_536
#: Pages with longer paths are labelled, but not learned from.
LEARNED_DEPTH = 400
PATH_SLOTS, WORD_SLOTS = 128, 24
FEATURES = PATH_SLOTS + WORD_SLOTS + 5

MAIN = {"article", "main", ".article", ".main"}
#: What stands around main text, as element names and as words of class, id or role.
AROUND_NAMES = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "title", "head")
AROUND_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent",
    "cookie", "disqus", "footer", "header", "login", "menu", "nav", "navbar", "navigation", "newsletter",
    "notice", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "warning", "widget",
)
AROUND = {*AROUND_NAMES, *(f".{word}" for word in AROUND_WORDS)}
#: Containers of main text on invented pages, besides RENAMED.
CONTAINERS = (
    (), ("div",), ("section",), ("table", "tr", "td"), ("div", ".text"), ("div", ".story"), ("div", ".body"),
    ("div", ".page"), ("div", ".post", ".body"), ("div", ".wrapper", "div"),
)
RENAMED = (("article",), ("main",), ("div", ".content"), ("section", ".post"), ("div", ".entry", ".content"))


@lru_cache(maxsize=100_000)
def path_slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % PATH_SLOTS


def traits(path: markup.Path | tuple[str, ...]) -> tuple[int, bool, bool]:
    """Slots of the path's tokens as bits, and whether tokens of MAIN and of AROUND are among them.

    Of a chain every link is looked at once, so blocks deep inside a page cost no more than others.
    """
    if not isinstance(path, markup.Path):
        path = markup.Path(None, tuple(path))
    open_links, at = [], path
    while at is not None and at.seen is None:
        open_links.append(at)
        at = at.parent
    bits, main, around = at.seen if at is not None else (0, False, False)
    for link in reversed(open_links):
        for token in link.own:
            bits |= 1 << path_slot(token)
            main, around = main or token in MAIN, around or token in AROUND
        link.seen = bits, main, around
    return bits, main, around


def vectors(blocks: list[markup.Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One row per block, for those from `first` to `last`."""
    own = blocks[first:last]
    found = np.zeros((len(own), FEATURES), np.float32)
    for i, block in enumerate(own):
        row = found[i]
        packed = np.frombuffer(traits(block.path)[0].to_bytes(PATH_SLOTS // 8, "little"), np.uint8)
        row[:PATH_SLOTS] = np.unpackbits(packed, bitorder="little")
        words = block.text.lower().split(" ")
        share = 1 / len(words)
        for word in words:
            row[PATH_SLOTS + zlib.crc32(word.encode("utf-8", "replace")) % WORD_SLOTS] += share
        rest = row[PATH_SLOTS + WORD_SLOTS :]
        rest[0] = np.log1p(len(words)) / 5
        rest[1] = min(block.linked / max(len(block.text), 1), 1)
        rest[2] = block.text[-1] in ".!?"
        rest[3] = (first + i) / len(blocks)
        rest[4] = len(block.path) / 10
    return found


def told(block: markup.Block) -> bool:
    """Whether the structure around a block says that it is main text."""
    _, main, around = traits(block.path)
    return main and not around


def varied(blocks: list[markup.Block], others: list[markup.Block], rng: random.Random) -> list:
    """(is main text, block) of the page with its article renamed and boilerplate put in."""
    name = rng.choice(RENAMED)

    def renamed(path: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(x for token in path for x in (name if token == "article" else (token,)))

    changed = [(told(b), markup.Block(b.text, renamed(b.path), b.linked)) for b in blocks]
    inner = next((b.path for main, b in changed if main), ("html", "body", *name))
    inner = tuple(token for token in inner if token not in ("p", "h1", "h2", "li"))
    for _ in range(rng.randrange(1, 6)):
        kind = rng.random()
        if kind < 0.4:
            around = (rng.choice(AROUND_NAMES),)
        else:
            around = (rng.choice(("div", "section", "ul", "p")), f".{rng.choice(AROUND_WORDS)}")
        base = inner if rng.random() < 0.5 else ("html", "body")
        at = rng.randrange(len(changed) + 1)
        put = [
            (False, markup.Block(other.text, (*base, *around, rng.choice(("p", "div", "li", "span"))),
                                 len(other.text) * (rng.random() < 0.3)))
            for other in rng.sample(others, min(len(others), rng.randrange(1, 4)))
        ]
        changed[at:at] = put
    return changed


def learned(blocks: list[markup.Block]) -> list[markup.Block]:
    """The part of a page that is learned from: its begin and end, or a run around main text."""
    if len(blocks) > LEARNED_BLOCKS:
        half = LEARNED_BLOCKS // 2
        chosen = blocks[:half] + blocks[-half:]
        if not any(map(told, chosen)):
            first = next(i for i, block in enumerate(blocks) if told(block))
            chosen = blocks[first - half : first + half]
        blocks = chosen
    if sum(len(block.text) for block in blocks) <= LEARNED_CHARS:
        return blocks
    room = LEARNED_CHARS // len(blocks)
    return [
        block if len(block.text) <= room
        else markup.Block(block.text[: room - 1] + block.text[-1], block.path,
                          round(block.linked * room / len(block.text)))
        for block in blocks
    ]


def invented(rng: random.Random) -> list[tuple[bool, markup.Block]]:
    """(is main text, block) of a page with main text in some container, and boilerplate around."""
    name = rng.choice(RENAMED + CONTAINERS)
    base = ("html", "body", *rng.choice(((), ("div",), ("div", ".container"))))

    def words(n: int) -> str:
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(n))

    def boilerplate() -> list[tuple[bool, markup.Block]]:
        around = (rng.choice(AROUND_NAMES[:-2]),) if rng.random() < 0.5 else (
            rng.choice(("div", "section", "ul")), f".{rng.choice(AROUND_WORDS)}")
        inner = rng.choice((("ul", "li", "a"), ("li",), ("p",), ("span",), ()))
        texts = [words(rng.randint(1, 12)) for _ in range(rng.randint(1, 8))]
        linked = "a" in inner or rng.random() < 0.3
        return [(False, markup.Block(t, (*base, *around, *inner), len(t) * linked)) for t in texts]

    page = [(False, markup.Block(words(rng.randint(2, 8)), ("html", "head", "title"), 0))]
    for _ in range(rng.randint(0, 3)):
        page += boilerplate()
    if rng.random() < 0.7:
        page.append((True, markup.Block(words(rng.randint(2, 10)), (*base, *name, rng.choice(("h1", "h2"))), 0)))
    for _ in range(rng.randint(1, 12)):
        own = rng.choice((("p",), ("p",), ("p",), ("ul", "li"), ("h2",), ("blockquote",), ()))
        text = words(rng.randint(1, 80)) + rng.choice((".", ".", "!", "?", ""))
        page.append((True, markup.Block(text, (*base, *name, *own), 0)))
        if rng.random() < 0.1:
            page += boilerplate()
    for _ in range(rng.randint(0, 3)):
        page += boilerplate()
    return page


def fit_blocks(read: list[list[markup.Block]]) -> lstm.Model | None:
    read = [page for page in read if any(map(told, page))]
    if not read:
        return None
    rng = random.Random(11)
    others = [block for page in read for block in page]
    x, y = [], []
    for page in read:
        x.append(vectors(page))
        y.append(np.array([told(b) for b in page], np.float32))
        for _ in range(2):
            changed = varied(page, others, rng)
            x.append(vectors([b for _, b in changed]))
            y.append(np.array([main for main, _ in changed], np.float32))
    for _ in range(SAMPLE - len(read)):  # few pages alone would be too few steps of training
        page = invented(rng)
        x.append(vectors([b for _, b in page]))
        y.append(np.array([main for main, _ in page], np.float32))
    return lstm.train(x, y)


def fit(pages: list[str]) -> lstm.Model | None:
    return fit_blocks([markup.blocks(html) for html in pages])


def train(pages: DataFrame, size: int = SAMPLE) -> lstm.Model | None:
    """A model from the `size` pages of least hash among those that tell; None if none does."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, found = [], []
        for place, html in zip(batch.column("place").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks = markup.blocks(html)
            if any(map(told, blocks)) and max(len(b.path) for b in blocks) <= LEARNED_DEPTH:
                places.append(place)
                found.append(json.dumps([(b.text, [*b.path], b.linked) for b in learned(blocks)]))
        return pa.record_batch(
            [pa.array(places, pa.int64()), pa.array(found, pa.string())], names=["place", "page"])

    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("page_id"), F.col("html")), F.lit(1 << 30))
    # tokens of MAIN are written as they stand, so other pages need not be read
    able = pages.where(F.col("html").rlike("(?i)article|main")).select(place.alias("place"), "html")
    share = min(1.0, 4 * size / max(pages.count(), 1))
    while True:
        part = able.where(F.col("place") < F.lit(share * (1 << 30)))
        rows = map_texts(part, "place long, page string", run, text="html").orderBy(
            "place", "page").limit(size).collect()
        if len(rows) == size or share == 1:
            break
        share = min(1.0, 16 * share)
    return fit_blocks([
        [markup.Block(text, tuple(path), linked) for text, path, linked in json.loads(row.page)]
        for row in rows
    ])


def fallback(size: int = SAMPLE) -> lstm.Model:
    """A model learned on invented pages."""
    rng = random.Random(13)
    pages = [invented(rng) for _ in range(2 * size)]
    return lstm.train(
        [vectors([b for _, b in page]) for page in pages],
        [np.array([main for main, _ in page], np.float32) for page in pages],
    )


def labeller(pages: DataFrame, size: int = SAMPLE) -> lstm.Model:
    """The model of the table's own pages; that of invented pages if none of them tells."""
    return train(pages, size) or fallback()


def extracted(pages: DataFrame, model: lstm.Model | None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [markup.blocks(html) for html in batch.column("html").to_pylist()]
        texts = [""] * len(read)
        if model:
            chances = lstm.predict_rows(
                model, [len(page) for page in read], lambda i, a, b: vectors(read[i], a, b)
            )
            texts = [
                "\n".join(b.text for b, chance in zip(page, own, strict=True) if chance >= 0.5)
                for page, own in zip(read, chances, strict=True)
            ]
        return pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    return map_texts(
        pages.select("page_id", "url", "html"),
        "page_id long, url string, text string, n_chars long", run, text="html",
    )
