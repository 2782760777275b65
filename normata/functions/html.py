"""Reading HTML: a tokenizer for tags, attributes, comments, raw text and character references, and what is read from it.

Pages are read in Arrow batches, each once, by one pass over its marks. Rules, for every page:

* a tag is ``<`` or ``</`` and a letter; quoted attribute values may hold ``>``, and a quote that is never closed is a letter like others; names are read in lower case,
  of a repeated attribute the last value counts, and references in values are decoded;
* comments, declarations and ``<? ... >`` are no text, nor is what ``</`` and another character than a letter begins;
  a comment that is not closed goes to the end of the page;
* ``script``, ``style`` and ``template`` hold raw text, which is never shown, up to their own end tag;
* an end tag closes the nearest open element of its name, and those inside it; one without such an element is
  ignored; elements that are not closed go to the end of what holds them; void elements hold nothing;
* a mark that the end of the page cuts off is text, and so is all that follows it; references (``&amp;``, ``&#233;``, also without semicolon
  where that is allowed) are decoded once; unknown ones stay.

Null pages give null; empty pages have no text and no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold nothing, hold raw text, or are the furniture of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template"))
FURNITURE = frozenset(("nav", "header", "footer"))
SPACE = " \t\r\n\f\x0b\xa0"

BEGINS = re.compile("<(?=[a-zA-Z!?/])")
MARK = re.compile(
    r"""<(?:
      (?P<comment>!--(?:(?s:.*?)--!?>|(?s:.*)))
    | (?P<other>[!?][^>]*>|/(?![a-zA-Z])[^>]*>)
    | (?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s"'>]?))*+)>
    )""",
    re.VERBOSE,
)
ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)?))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}

ROWS = "array<struct<id: string, onclick: string, cells: array<struct<text: string, href: string>>>>"
ROW_TYPE = pa.list_(
    pa.struct(
        [
            ("id", pa.string()),
            ("onclick", pa.string()),
            ("cells", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))),
        ]
    )
)


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by name; one without value has an empty one."""
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """The page as (kind, value, attributes): ``text`` with its text, ``start`` and ``end`` with a name; raw text is left out."""
    at = 0
    while at < len(page):
        begins = BEGINS.search(page, at)
        mark = begins and MARK.match(page, begins.start())
        if not mark:
            yield "text", html.unescape(page[at:]), ""
            return
        if mark.start() > at:
            yield "text", html.unescape(page[at : mark.start()]), ""
        at = mark.end()
        name = (mark["name"] or "").lower()
        if mark["end"]:
            yield "end", name, ""
        elif name in RAW:
            closed = RAW_END[name].search(page, at)
            at = closed.end() if closed else len(page)
        elif name:
            yield "start", name, mark["attributes"]
            if name in VOID or mark["attributes"].endswith("/"):
                yield "end", name, ""


def elements(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Like :func:`events`, with the depth of each, and an ``end`` for every element, whatever closes it."""
    stack: list[str] = []
    opened: Counter[str] = Counter()
    for kind, value, more in events(page):
        if kind == "start":
            stack.append(value)
            opened[value] += 1
            yield kind, value, more, len(stack)
        elif kind == "text":
            yield kind, value, more, len(stack)
        elif opened[value]:
            while True:
                name = stack.pop()
                opened[name] -= 1
                yield kind, name, more, len(stack) + 1
                if name == value:
                    break
    while stack:
        yield "end", stack.pop(), "", len(stack) + 1


def visible_lines(page: str) -> list[str]:
    """Lines of the text outside of :data:`FURNITURE`, each piece of text on lines of its own, trimmed, without empty ones."""
    out: list[str] = []
    hidden = 0
    for kind, value, _, depth in elements(page):
        if kind == "text" and not hidden:
            out += [line for part in value.split("\n") if (line := part.strip(SPACE))]
        elif kind == "start" and not hidden and value in FURNITURE:
            hidden = depth
        elif kind == "end" and depth == hidden:
            hidden = 0
    return out


def table_rows(page: str) -> list[dict]:
    """Every table row, in the order in which they begin: id, onclick, and its cells (text, first link).

    A row's cells are all ``td`` elements in it, those of tables inside its cells included, in the order in which they begin;
    a cell's text is that of all pieces in it, each trimmed.
    """
    rows: list[dict] = []
    open_rows: list[tuple[int, dict]] = []
    open_cells: list[tuple[int, dict]] = []
    for kind, value, more, depth in elements(page):
        if kind == "text":
            for _, cell in open_cells:
                cell["text"] += value.strip(SPACE)
        elif kind == "start" and value == "tr":
            own = attributes(more)
            row = {"id": own.get("id"), "onclick": own.get("onclick"), "cells": []}
            rows.append(row)
            open_rows.append((depth, row))
        elif kind == "start" and value == "td":
            cell = {"text": "", "href": None}
            for _, row in open_rows:
                row["cells"].append(cell)
            open_cells.append((depth, cell))
        elif kind == "start" and value == "a" and open_cells:
            href = attributes(more).get("href")
            for _, cell in open_cells:
                cell["href"] = href if cell["href"] is None else cell["href"]
        elif kind == "end":
            for opened in (open_rows, open_cells):
                if opened and opened[-1][0] == depth:
                    opened.pop()
    return rows


def html_text(page: Column) -> Column:
    """Visible text of a page, a line for each piece."""

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array((None if p is None else "\n".join(visible_lines(p)) for p in (x.as_py() for x in pages)), pa.string())

    return text(page)


def html_rows(page: Column) -> Column:
    """:func:`table_rows` of a column of pages."""

    @F.arrow_udf(ROWS)
    def rows(pages: pa.Array) -> pa.Array:
        return pa.array((None if p is None else table_rows(p) for p in (x.as_py() for x in pages)), ROW_TYPE)

    return rows(page)
