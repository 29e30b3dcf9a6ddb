"""HTML pages as sequences of text blocks, each with the path of elements it stands in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape

NAME = re.compile(r"(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)")
#: What ends a tag, or begins a value in which nothing ends it.
STOP = re.compile("[>\"']")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
PARTS = re.compile(r"[a-z0-9]+")

#: Content that is never text.
HIDDEN = {"script", "style", "template", "noscript", "iframe", "svg"}
HIDDEN_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in HIDDEN}
EMPTY = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a block; all others run inside one.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot "
    "th thead title tr ul".split()
)
#: Open elements that the start of another one ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_PARAGRAPH = BLOCKS - {"button", "label", "option", "optgroup", "select", "textarea"}


class Path:
    """Tokens of open elements from the root on, as a chain that inner elements share.

    `seen` is for readers, who may keep there what they know of the tokens so far.
    """

    __slots__ = ("own", "parent", "seen", "size")

    def __init__(self, parent: Path | None, own: tuple[str, ...]):
        self.parent, self.own, self.seen = parent, own, None
        self.size = len(own) + (parent.size if parent else 0)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        links, at = [], self
        while at is not None:
            links.append(at.own)
            at = at.parent
        for own in reversed(links):
            yield from own


ROOT = Path(None, ())


@dataclass
class Block:
    """Text with single blanks, the path tokens around it, and its characters inside links."""

    text: str
    path: Path | tuple[str, ...]
    linked: int


@dataclass
class _Page:
    open: list[tuple[str, Path]] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)
    texts: list[str] = field(default_factory=list)
    path: Path = ROOT
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def inner(self) -> Path:
        return self.open[-1][1] if self.open else ROOT

    def write(self, raw: str) -> None:
        if not self.texts or not any(self.texts):
            self.path = self.inner()
        if self.names["a"]:
            self.linked += len(raw)
        self.texts.append(unescape(raw))

    def end_block(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                self.blocks.append(Block(text, self.path, self.linked))
            self.texts, self.linked = [], 0

    def begin(self, name: str, tokens: tuple[str, ...]) -> None:
        self.open.append((name, Path(self.inner(), tokens)))
        self.names[name] += 1

    def close(self, names: set[str]) -> None:
        """Close the innermost open element of these names, with all inside it."""
        if not any(self.names[name] for name in names):
            return
        while True:
            name, _ = self.open.pop()
            self.names[name] -= 1
            if name in names:
                return


class _Tags:
    """Finds the tags of a page one after the other, in time that follows its length.

    Where a tag has no end, the places its search came through are kept: a later search that comes
    to one of them has none either.
    """

    def __init__(self, html: str):
        self.html = html
        self.failed: set[int] = set()
        self.unclosed = {'"': len(html), "'": len(html)}
        self.stop = (0, 0, "")  # between the first two places the next stop is at the second

    def end(self, at: int) -> int:
        """Where the tag whose name ends here has its closing bracket; -1 without one."""
        came_by: list[int] = []
        while True:
            first, last, sign = self.stop
            if not (sign is not None and first <= at <= last and sign):
                if sign is None and at >= first:
                    break
                found = STOP.search(self.html, at)
                if not found:
                    self.stop = (at, len(self.html), None)
                    break
                last, sign = found.start(), found[0]
                self.stop = (at, last, sign)
            if sign == ">":
                return last
            if last + 1 >= self.unclosed[sign]:
                break
            close = self.html.find(sign, last + 1)
            if close < 0:
                self.unclosed[sign] = last + 1
                break
            at = close + 1
            if at in self.failed:
                break
            came_by.append(at)
        self.failed.update(came_by)
        return -1

    def next(self, at: int) -> tuple[int, int, re.Match | None, str] | None:
        """Begin, end, name (None for comments and the like) and inside of the next tag."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0:
                return None
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), None, ""
            name = NAME.match(html, at)
            if name:
                end = self.end(name.end())
                if end >= 0:
                    return start, end + 1, name, html[name.end() : end]
            elif html[at : at + 1] in ("!", "?"):
                end = html.find(">", at) if self.last >= at else -1
                if end >= 0:
                    return start, end + 1, None, ""

    @cached_property
    def last(self) -> int:
        return self.html.rfind(">")


def tokens_of(name: str, rest: str) -> tuple[str, ...]:
    """An element's name, and the parts of its class, id and role, marked with a dot."""
    if not rest or "=" not in rest:
        return (name,)
    found = [name]
    for groups in NAMED.findall(rest):
        found += [f".{part}" for part in PARTS.findall("".join(groups).lower())]
    return tuple(found)


def blocks(html: str | None) -> list[Block]:
    """The page's text blocks in page order; broken markup is read as far as it goes."""
    page, at = _Page(), 0
    html = html or ""
    tags = _Tags(html)
    while True:
        found = tags.next(at)
        if not found:
            break
        start, end, match, rest = found
        if start > at:
            page.write(html[at:start])
        at = end
        if not match:
            continue
        name = match["name"].lower()
        if name in BLOCKS:
            page.end_block()
        elif name == "br":
            page.write(" ")
        if match["close"]:
            page.close({name})
            continue
        if name in HIDDEN:
            hidden = HIDDEN_END[name].search(html, at)
            at = hidden.end() if hidden else len(html)
            continue
        if name in EMPTY:
            continue
        if name in ENDS_PARAGRAPH and page.names["p"]:
            page.close({"p"})
        if name in ENDS and page.open and page.open[-1][0] in ENDS[name]:
            page.close(ENDS[name])
        page.begin(name, tokens_of(name, rest))
    if at < len(html):
        page.write(html[at:])
    page.end_block()
    return page.blocks
