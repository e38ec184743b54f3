"""HTML pages to typed blocks, links and image ids."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: What an element is to the reader; all others are plain, and end a run of loose text where they end.
# Elements without content of their own, headings, paragraphs, lists.
ROLES = {
    **dict.fromkeys(("script", "style", "noscript", "iframe", "svg", "form", "button", "nav", "template", "head"), "skip"),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("p", "blockquote", "pre", "figcaption"), "paragraph"),
    "ul": "list", "ol": "list", "table": "table", "li": "item", "tr": "row", "td": "cell", "th": "cell", "a": "anchor",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose start ends a paragraph that was left open.
ENDS_PARAGRAPH = {"p", "blockquote", "pre", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "article", "section"}

BLOCKS = "array<struct<kind:string,text:string,level:int>>"
LINKS = "array<struct<url:string,anchor:string>>"


def clean(text: str) -> str:
    """Entities decoded, white space (no-break spaces too) collapsed."""
    return " ".join(entities.unescape(text).replace(" ", " ").split())


class _Open:
    """An element that is still open: what it is, the text in it so far, and the parts of a list or table that were met in it."""

    __slots__ = ("tag", "role", "href", "text", "parts")

    def __init__(self, tag: str, role: str, href: str | None = None):
        self.tag, self.role, self.href = tag, role, href
        self.text: list[str] = []
        self.parts: list[_Open] = []

    def said(self) -> str:
        return clean("".join(self.text))


class PageReader(HTMLParser):
    """Reads a page from front to back; text goes to every open element that gathers text, and blocks come out where they end.

    Unknown ends are ignored, a block ends an open paragraph, an item the one before it. Within a list, a table, a heading or a paragraph all text is the
    block's; outside, text and links gather until an element ends or a block starts, and make a paragraph.
    """

    def __init__(self, home: str = ""):
        super().__init__(convert_charrefs=True)
        self.home = home.rstrip("/")
        self.blocks: list[tuple[str, str, int]] = []
        self.links: list[tuple[str, str]] = []
        self.image_ids: list[int] = []
        self.menu: list[tuple[str, str]] = []
        self._loose: list[str] = []
        self._open: list[_Open] = []

    # where the reader is

    def _within(self, *roles: str) -> _Open | None:
        """The outermost open element of these roles."""
        return next((e for e in self._open if e.role in roles), None)

    def _block(self) -> _Open | None:
        return self._within("heading", "list", "table", "paragraph")

    def _end_loose(self) -> None:
        if text := " ".join(self._loose).strip():
            self.blocks.append(("paragraph", text, 0))
        self._loose.clear()

    # events

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._open and self._open[-1].tag == "p" and tag in ENDS_PARAGRAPH:
            self._close(len(self._open) - 1)
        if self._open and self._open[-1].tag == tag == "li":
            self._close(len(self._open) - 1)
        attributes = dict(attrs)
        if tag in VOID:
            self._void(tag, attributes)
            return
        element = _Open(tag, ROLES.get(tag, "plain"), attributes.get("href"))
        block = self._block()
        if block is None and not self._within("skip") and element.role in ("heading", "list", "table"):
            self._end_loose()
        for outer in self._open:  # a part belongs to every list, table or row that it lies in
            if (outer.role, element.role) in (("list", "item"), ("table", "row"), ("row", "cell")):
                outer.parts.append(element)
        self._open.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i].tag == tag), None)
        if at is not None:
            while len(self._open) > at:
                self._close(len(self._open) - 1)

    def handle_data(self, data: str) -> None:
        gathering = [e for e in self._open if e.role != "plain"]
        for element in gathering:
            element.text.append(data)
        if not gathering and (text := clean(data)):
            self._loose.append(text)

    def close(self) -> None:
        super().close()
        while self._open:
            self._close(len(self._open) - 1)
        self._end_loose()

    # what an element leaves behind

    def _void(self, tag: str, attributes: dict) -> None:
        if self._within("skip"):
            return
        if tag == "img":
            found = re.search(r"wp-image-(\d+)", attributes.get("class") or "")
            if found and int(found[1]) not in self.image_ids:
                self.image_ids.append(int(found[1]))
        elif not self._block() and not self._within("anchor"):
            self._end_loose()

    def _close(self, at: int) -> None:
        element = self._open.pop(at)
        if element.role == "anchor":
            self._anchor(element)
        elif self._within("skip") or self._block() or self._within("anchor"):
            return
        elif make := getattr(self, f"_{element.role}", None):
            make(element)
        elif element.role != "skip":
            self._end_loose()

    def _anchor(self, a: _Open) -> None:
        text = a.said()
        if self._within("skip"):
            if any(e.tag == "nav" for e in self._open):
                self.menu.append((a.href or "", text))
            return
        target = (a.href or "").strip()
        if target and not target.startswith(("#", "javascript:", "mailto:", "tel:")):
            start = "https:" if target.startswith("//") else self.home if target.startswith("/") else ""
            self.links.append((start + target, text[:255]))
        if not self._block() and not self._within("anchor") and text:
            self._loose.append(text)

    def _heading(self, element: _Open) -> None:
        if text := element.said():
            self.blocks.append(("heading", text, int(element.tag[1])))

    def _paragraph(self, element: _Open) -> None:
        if text := element.said():
            self._end_loose()
            self.blocks.append(("paragraph", text, 0))

    def _list(self, element: _Open) -> None:
        if items := [f"• {text}" for item in element.parts if (text := item.said())]:
            self.blocks.append(("list", "\n".join(items), 0))

    def _table(self, element: _Open) -> None:
        heads: list[str] = []
        lines = []
        for row in element.parts:
            cells = [cell.said() for cell in row.parts]
            if cells and {cell.tag for cell in row.parts} == {"th"}:
                heads = cells
                continue
            named = [f"{head}: {cell}" if head else cell for head, cell in zip(heads + [""] * len(cells), cells) if cell]
            lines.append("; ".join(named))
        if text := "\n".join(filter(None, lines)):
            self.blocks.append(("table", text, 0))


def read_page(page: str | None, home: str = "") -> PageReader:
    """A page that was read: ``blocks`` (kind, text, level), ``links``, ``image_ids`` and ``menu`` (anchors within ``<nav>``)."""
    reader = PageReader(home)
    reader.feed(page or "")
    reader.close()
    return reader


def normalize_pages(pages: DataFrame, home: str = "") -> DataFrame:
    """``page_id``, ``url``, ``blocks``, ``links``, ``image_ids``, ``menu`` per page; a null page has none of them."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = lambda pairs: [{"url": u, "anchor": a} for u, a in pairs]
        for f in frames:
            read = [read_page(page, home) for page in f["html"]]
            yield pd.DataFrame(
                {
                    "page_id": f["page_id"],
                    "url": f["url"],
                    "blocks": [[{"kind": k, "text": x, "level": n} for k, x, n in r.blocks] for r in read],
                    "links": [named(r.links) for r in read],
                    "image_ids": [r.image_ids for r in read],
                    "menu": [named(r.menu) for r in read],
                }
            )

    return pages.select("page_id", "url", "html").mapInPandas(
        work, f"page_id long, url string, blocks {BLOCKS}, links {LINKS}, image_ids array<int>, menu {LINKS}"
    )
