"""Leaf blocks of an HTML page, with the tags and names that stand above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements that part blocks, that hold no page text, and that have no end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
_RAW = "script|style|title|textarea|iframe"
_SILENT = "noscript|template|svg|math|object|canvas|audio|video|select"
_SECTIONS = frozenset("article aside dialog footer form header main menu nav search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Quotes in a tag are taken in pairs where they come in pairs, and as they are where they don't.
_ATTRIBUTES = r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*){_ATTRIBUTES}>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_SILENT_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)({_SILENT})(?=[\s/>]){_ATTRIBUTES}>",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A stretch of text without a block boundary inside."""

    text: str
    tag: str
    above: frozenset[str]  # tags, "role=..." and the words of class and id names
    near: frozenset[str]  # the same of the innermost element that says what it is
    linked: int  # characters inside links


@dataclass
class _Open:
    tag: str
    above: frozenset[str]
    near: frozenset[str]


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", frozenset(), frozenset())])
    pieces: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    links: int = 0
    linked: int = 0

    def text(self, raw: str) -> None:
        piece = html.unescape(raw)
        self.pieces.append(piece)
        if self.links:
            self.linked += len(piece.strip())

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.tag, top.above, top.near, self.linked))
            self.pieces, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag not in BLOCK_TAGS:
            if tag == "br":
                self.pieces.append("\n")
            elif tag == "a":
                self.links = 1
            return
        self.end_block()
        if tag in _VOID:
            return
        if self.stack[-1].tag == "p":
            self.stack.pop()
        if tag in _CLOSES:
            closed, limits = _CLOSES[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in limits:
                    break
                if self.stack[k].tag in closed:
                    del self.stack[k:]
                    break
        names = {tag}
        if attributes.strip():
            for name, value in _NAMED.findall(attributes):
                value = value.strip("\"'")
                if name.lower() == "role":
                    names.add(f"role={value.lower()}")
                elif name.lower() == "hidden":
                    names.add("hidden")
                else:
                    names.update(f".{part.lower()}" for part in _PART.findall(value))
        top = self.stack[-1]
        telling = len(names) > 1 or tag in _SECTIONS
        near = frozenset(f"near={name}" for name in names) if telling else top.near
        above = top.above if names <= top.above else top.above | names
        self.stack.append(_Open(tag, above, near))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in BLOCK_TAGS:
            return
        self.end_block()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return


def _silent_ends(page: str) -> dict[int, int]:
    """Where each element without page text begins and ends. One that is closed by its own tag, or
    that nothing closes, is not listed: it holds nothing."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for m in _SILENT_TAG.finditer(page):
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if not m[2]:
            if not m[4].endswith("/"):
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            ends[opened[tag].pop()] = m.end()
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with visible text in page order. Character references are decoded, white space
    becomes one blank, and scripts, styles, comments and the page's head give nothing."""
    reader, at, in_head = _Reader(), 0, False
    silent = _silent_ends(page)
    while m := _TOKEN.search(page, at):
        if m.start() > at and not in_head:
            reader.text(page[at : m.start()])
        at = max(m.end(), silent.get(m.start(), 0))
        tag = (m[3] or "").lower()
        if m.start() in silent:
            if tag in BLOCK_TAGS:
                reader.end_block()
            continue
        if tag in ("head", "body"):
            in_head = tag == "head" and not m[2]
        if not tag or tag == "head":
            continue
        if in_head and tag in BLOCK_TAGS:
            in_head = False
        if m[2]:
            reader.close(tag)
        else:
            reader.open(tag, m[4])
    if at < len(page) and not in_head:
        reader.text(page[at:])
    reader.end_block()
    return reader.blocks
