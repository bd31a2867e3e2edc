"""Find the raw pieces of a listing page.

HTML structure is the one thing column expressions cannot follow, so a single
Arrow-batched function walks each page once and hands back the raw strings.
All reading of values out of those strings is left to column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where a listing page keeps its facts.
CONTAINERS = {
    "address": ("h1", "class", "property-info-address"),
    "features": ("ul", "class", "property-info__primary-features"),
    "attributes": ("div", "class", "property-info__property-attributes"),
    "footer": (None, "class", "property-info__footer-content"),
    "price": (None, "class", "property-price"),
    "body": (None, "data-testid", "PropertyDescription"),
}
META_NAMES = {"description": "meta_description", "og:description": "og_description", "og:title": "og_title"}

LIST_FIELDS = ["address", "labels", "attributes", "footer", "price", "body"]
TEXT_FIELDS = [*META_NAMES.values(), "canonical"]
FIELDS = [*LIST_FIELDS, *TEXT_FIELDS, "json_ld"]
SCHEMA = T.StructType(
    [T.StructField(f, T.StringType() if f in TEXT_FIELDS else T.ArrayType(T.StringType())) for f in FIELDS]
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))


class _Walk(HTMLParser):
    """One pass over a page, keeping only the text inside wanted containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}
        self.meta: dict[tuple[str, str], str | None] = {}
        self.labels: list[str] | None = None
        self.canonical: str | None = None
        self.has_canonical = False
        self.blocks: list[str] = []
        self._open: list[tuple[str, str | None]] = []
        self._count: dict[str, int] = {}
        self._active: list[str] = []
        self._text: list[str] = []
        self._hidden = 0
        self._block: list[str] | None = None

    def _flush(self) -> None:
        if self._text:
            piece = "".join(self._text).strip()
            self._text = []
            if piece:
                for name in self._active:
                    self.found[name].append(piece)

    def _container(self, tag: str, attrs: dict) -> str | None:
        for name, (wanted_tag, attr, value) in CONTAINERS.items():
            held = attrs.get(attr)
            if held and name not in self.found and wanted_tag in (None, tag):
                if value in held.split() if attr == "class" else value == held:
                    return name
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        held = dict(reversed(attrs))
        if tag == "meta":
            for key in ("name", "property"):
                if held.get(key) in META_NAMES:
                    self.meta.setdefault((key, held[key]), held.get("content"))
        elif tag == "link":
            if not self.has_canonical and "canonical" in (held.get("rel") or "").split():
                self.canonical, self.has_canonical = held.get("href"), True
        elif tag == "li" and "features" in self._active:
            self.labels.append(held.get("aria-label") or "")
        if tag in _VOID:
            return
        if tag in _HIDDEN:
            self._hidden += 1
            if tag == "script" and held.get("type") == "application/ld+json":
                self._block = []
        name = self._container(tag, held) if held else None
        if name:
            self.found[name] = []
            self._active.append(name)
            if name == "features":
                self.labels = []
        self._open.append((tag, name))
        self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # HTML has no self-closing elements: "<p/>" opens a paragraph
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not self._count.get(tag):
            return  # never opened: no need to look through what is open
        depth = len(self._open) - 1
        while self._open[depth][0] != tag:
            depth -= 1
        for closed, name in self._open[depth:]:
            self._count[closed] -= 1
            if closed in _HIDDEN:
                self._hidden -= 1
                if self._block is not None:
                    self.blocks.append("".join(self._block))
                    self._block = None
            if name:
                self._active.remove(name)
        del self._open[depth:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # pages have no marked sections; the parser's own reading of "<![" can
        # fail on malformed ones, where a comment up to the next ">" is meant
        return self.parse_bogus_comment(i, report)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        if self._block is not None:
            self._block.append(data)
        elif self._active and not self._hidden:
            self._text.append(data)

    def result(self) -> tuple:
        self._flush()
        blocks = self.blocks if self._block is None else [*self.blocks, "".join(self._block)]
        meta = [
            self.meta[("name", m)] if ("name", m) in self.meta else self.meta.get(("property", m)) for m in META_NAMES
        ]
        text = [self.found.get(name) for name in ("attributes", "footer", "price", "body")]
        return (self.found.get("address"), self.labels, *text, *meta, self.canonical, blocks)


def _walk(html: str | None) -> tuple:
    walk = _Walk()
    if html:
        walk.feed(html)
        walk.close()
    return walk.result()


@F.pandas_udf(SCHEMA)
def _locate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([_walk(html) for html in pages], columns=FIELDS)


def locate(html: Column) -> Column:
    """The raw pieces of a page as one struct; every text comes as the list of
    its trimmed, non-empty text nodes, null where the element is missing."""
    return _locate(html)
