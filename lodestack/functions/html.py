"""Structured text of markup: paragraphs, lists as lines, breaks where elements part what they hold.

Nesting needs a stack, which expressions don't have; so markup is read by the standard library's event parser in Arrow
batches. Where only words matter, text.strip_html stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that end a paragraph, lists, elements without content, elements whose content is no text.
BLOCKS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "header", "footer", "section", "article", "div", "main", "aside", "figure", "figcaption", "body", "html"]
LISTS = ["ul", "ol"]
VOID = ["area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SILENT = ["script", "style", "noscript"]
# Words that lead on to the next one, and signs that close what stands before.
LEADING = ["or", "and", "of", "in", "at", "to", "the", "a", "an", "for", "with"]
CLOSING = (":", ".", "!", "?")

BREAK = "\0"
_LEADS_ON = re.compile(rf"(?i)(?:^|[\s(])(?:{'|'.join(LEADING)})\Z")
_PARAGRAPH = re.compile(rf"{BREAK}[ \t]*(?:{BREAK}[ \t]*)+")


@dataclass
class List:
    ordered: bool
    n: int = 0
    #: In an item: its own text hasn't come yet.
    waiting: bool = False
    inside: bool = False


class Reader(HTMLParser):
    """Turns events into blocks, each with what parts it from the one before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []  # text since the last block ended
        self.lists: list[List] = []
        self.silent = 0
        #: Inline elements open, and at how many the outermost one began that hasn't shown any text.
        self.inline: list[str] = []
        self.unseen: int | None = None

    def put(self, text: str, glue: str) -> None:
        self.out += [glue if self.out else "", text]

    def bullet(self, lines: list[str]) -> None:
        own = self.lists[-1]
        indent = "  " * (len(self.lists) - 1)
        mark = f"{own.n}." if own.ordered else "-"
        near = own.n > 1 or len(self.lists) > 1
        self.put("\n".join([f"{indent}{mark} {lines[0] if lines else ''}".rstrip(), *(f"{indent}  {x}" for x in lines[1:])]), "\n" if near else "\n\n")
        own.waiting = False

    def end_block(self) -> None:
        """Paragraphs of the text that is open; the first one of an item is its bullet's."""
        whole = "".join(self.open)
        self.open.clear()
        self.unseen = None
        for paragraph in _PARAGRAPH.split(whole):
            lines = [x for x in (re.sub(r"[ \t]+", " ", y).strip() for y in re.split(f"[{BREAK}\n]", paragraph)) if x]
            if not lines:
                continue
            if self.lists and self.lists[-1].waiting:
                self.bullet(lines)
            else:
                self.put("\n".join(lines), "\n\n")

    def end_item(self) -> None:
        self.end_block()
        if self.lists[-1].waiting:
            self.bullet([])
        self.lists[-1].inside = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag == "br":
            self.open.append(BREAK)
        elif tag in LISTS:
            self.end_block()
            if self.lists and self.lists[-1].waiting:
                self.bullet([])
            self.lists.append(List(tag == "ol"))
        elif tag == "li" and self.lists:
            if self.lists[-1].inside:
                self.end_item()
            self.open.clear()
            own = self.lists[-1]
            own.n, own.waiting, own.inside = own.n + 1, True, True
        elif tag in BLOCKS:
            self.end_block()
        elif tag not in VOID:
            if self.unseen is None:
                self.unseen = len(self.inline)
            self.inline.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag == "br" or tag in BLOCKS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag in LISTS and self.lists:
            if self.lists[-1].inside:
                self.end_item()
            self.open.clear()
            self.lists.pop()
        elif tag == "li" and self.lists:
            if self.lists[-1].inside:
                self.end_item()
        elif tag in BLOCKS:
            self.end_block()
        elif tag in self.inline:
            while self.inline.pop() != tag:
                pass
            if self.unseen is not None and self.unseen >= len(self.inline):
                self.unseen = None

    def handle_data(self, data: str) -> None:
        if self.silent or self.lists and not self.lists[-1].inside:
            return
        shown = data.strip()
        if shown and self.unseen is not None:
            self.unseen = None
            before = ending(self.open)
            if before.strip() and before == before.rstrip(" \t\n" + BREAK) and shown[0].isupper():
                if before.endswith(CLOSING):
                    self.open.append(BREAK)
                elif _LEADS_ON.search(before):
                    self.open.append(" ")
        self.open.append(data)

    def text(self) -> str:
        while self.lists:
            self.handle_endtag("ul")
        self.end_block()
        return re.sub(r"\n{3,}", "\n\n", "".join(self.out)).strip()


def ending(pieces: list[str], least: int = 80) -> str:
    """The last pieces together, as many as have least characters: what a longer text ends with."""
    n, at = 0, len(pieces)
    while at and n < least:
        at -= 1
        n += len(pieces[at])
    return "".join(pieces[at:])


def to_text(markup: str | None) -> str:
    """Text of markup: blocks with a blank line between, items as `- ` or `1. ` lines that nesting indents, single
    breaks as line ends and double ones as blank lines. What elements part isn't fused: a label or sentence and the
    next element's capital stand on two lines, a leading word and it get a blank. Null is empty."""
    reader = Reader()
    reader.feed(markup or "")
    reader.close()
    return reader.text()


def closed_references(markup) -> Column:
    """Markup of which only references that end with a semicolon are read, as by text.strip_html; others stand for the
    letters that they are written with, where a browser would read `&amp` at a text's end as `&`."""
    return F.regexp_replace(F.col(markup) if isinstance(markup, str) else markup, r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


@F.pandas_udf(T.StringType())
def structured_text(markup: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in markup:
        yield batch.map(to_text)
