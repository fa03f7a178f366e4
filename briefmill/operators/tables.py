"""Tables inside texts as rows of cells: HTML, cell tokens of table recognition, and lines with pipes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what the HTML standard allows a cell to span
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_TOKEN = re.compile("<(fcel|lcel|ecel|nl)>")
_SPACE = re.compile(r"\s+")
_RULER = re.compile(r"\s*\|?[\s\-|:]+\|?\s*")

#: tags that need no parser: without other attributes than spans, and none whose content is no markup
_PLAIN = re.compile(r"<(/?)(table|thead|tbody|tfoot|t[rdh]|p|b|i|br|div|span)((?:[ \n]+(?:colspan|rowspan)=(?:\"[0-9]+\"|[0-9]+))*)[ \n]*>", re.I)
_SPANS = re.compile(r"(colspan|rowspan)=\"?([0-9]+)", re.I)

Cell = tuple[str, int, int, bool]  # text, columns, rows, header


class _Html(HTMLParser):
    """All tables of a page in the order of their ends; the text of an inner table is no text of the outer cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[tuple[int, list[list[Cell]]]] = []
        self.begun = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"n": self.begun, "rows": [], "cell": None})
            self.begun += 1
        elif self.open and tag in ("tr", "td", "th"):
            at = self.open[-1]
            self._close_cell(at)
            if tag == "tr" or not at["rows"]:
                at["rows"].append([])
            if tag != "tr":
                spans = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.strip().isdecimal()}
                wide = min(max(spans.get("colspan", 1), 1), MOST_COLUMNS)
                at["cell"] = ([], wide, min(spans.get("rowspan", 1), MOST_ROWS), tag == "th")

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            at = self.open[-1]
            self._close_cell(at)
            if tag == "table":
                self.done.append((at["n"], at["rows"]))
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def _close_cell(self, at: dict) -> None:
        if at["cell"]:
            parts, *rest = at["cell"]
            at["rows"][-1].append((_SPACE.sub(" ", "".join(parts)).strip(), *rest))
            at["cell"] = None

    def tables(self) -> list[list[list[Cell]]]:
        while self.open:  # a page that ends within a table
            self.handle_endtag("table")
        return [rows for _, rows in sorted(self.done, key=lambda t: t[0])]


def _of_html(text: str) -> list[list[list[Cell]]]:
    """The tables of a page; the parser is asked only if there is more in it than plain tags and text."""
    parser = _Html()
    parts = _PLAIN.split(text)
    if any("<" in data for data in parts[::4]) or any(close and spans for close, spans in zip(parts[1::4], parts[3::4])):
        parser.feed(text)
        parser.close()
        return parser.tables()
    for close, tag, spans, data in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4]):
        if close:
            parser.handle_endtag(tag.lower())
        else:
            parser.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _SPANS.findall(spans)] if spans else [])
        if data:
            parser.handle_data(unescape(data) if "&" in data else data)
    return parser.tables()


def _of_tokens(text: str) -> list[list[Cell]]:
    """Rows of first, empty and linked cells; a linked cell widens the one before it."""
    _, *parts = _TOKEN.split(text)
    rows: list[list[Cell]] = [[]]
    for token, content in zip(parts[::2], parts[1::2]):
        if token == "nl":
            rows.append([])
        elif token == "lcel" and rows[-1]:
            label, wide, tall, head = rows[-1][-1]
            rows[-1][-1] = (label, wide + 1, tall, head)
        else:
            rows[-1].append((content.strip(), 1, 1, len(rows) == 1))
    return [r for r in rows if r]


def _of_pipes(lines: list[str]) -> list[list[Cell]]:
    kept = [re.split(r"\s*\|\s*", re.sub(r"^\s*\|\s*|\s*\|\s*$", "", x)) for x in lines if not _RULER.fullmatch(x)]
    return [[(c, 1, 1, i == 0) for c in row] for i, row in enumerate(kept)]


def tables_of(text: str) -> tuple[str, list[list[list[Cell]]]]:
    """The format (otsl, html, markdown or text) and the tables as rows of cells that may span."""
    if sum(t != "nl" for t in _TOKEN.findall(text)) >= 4:
        return "otsl", [_of_tokens(text)]
    if re.search(r"<table[\s>]", text, re.I):
        return "html", _of_html(text)
    lines = [x for x in text.split("\n") if x.count("|") >= 2]
    return ("markdown", [_of_pipes(lines)]) if len(lines) >= 2 else ("text", [])


def grid(rows: list[list[Cell]]) -> list[list[tuple[str, bool, bool]]]:
    """A rectangle of (text, header, own): each place that a cell spans, of which ``own`` is the first; places of no cell are empty.

    A cell takes the first free place of its row; a span of rows ends with the table, and 0 spans all that follow.
    """
    out: list[list] = [[] for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for text, wide, tall, head in row:
            while x < len(out[y]) and out[y][x] is not None:
                x += 1
            last = len(rows) if tall == 0 else min(y + tall, len(rows))
            for yy in range(y, last):
                line = out[yy]
                line.extend([None] * (x + wide - len(line)))
                for xx in range(x, x + wide):
                    if line[xx] is None:
                        line[xx] = (text, head, yy == y and xx == x)
            x += wide
    width = max(map(len, out), default=0)
    return [[place or ("", False, True) for place in line + [None] * (width - len(line))] for line in out]


def _map(rows: DataFrame, id_col: str, text_col: str, schema: str, names: list[str], of) -> DataFrame:
    kinds = [pa.string() if f in ("cell", "format", "cell_text", "markdown") else pa.bool_() if f in ("header", "own") else pa.int32() for f in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [(i, *x) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in of(t or "")]
                for first in range(0, len(made), 50_000):
                    cols = list(zip(*made[first : first + 50_000]))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *kinds])], names=["id", *names])

    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id long, {schema}").withColumnRenamed("id", id_col)


def cells(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place of each table's grid: id, ``table_no``, ``row_no``, ``col_no`` (from 0), ``cell``, ``header``, ``own``.

    A text is one table of tokens if it has four cell tokens or more, else its HTML tables in the order they begin, else
    one table of its lines with two pipes or more, if there are two such lines. Spans are expanded to rectangles:
    each place has its cell's text, and ``own`` marks the place where the cell stands. Null, empty and other texts
    have no cells. Repeated rows give their cells each; other columns are ignored.
    """

    def of(text: str) -> Iterator[tuple]:
        for n, table in enumerate(tables_of(text)[1]):
            for y, line in enumerate(grid(table)):
                for x, (cell, header, own) in enumerate(line):
                    yield n, y, x, cell, header, own

    names = ["table_no", "row_no", "col_no", "cell", "header", "own"]
    return _map(rows, id_col, text_col, "table_no int, row_no int, col_no int, cell string, header boolean, own boolean", names, of)


def normalised(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``format``, ``n_rows`` of all tables, ``cell_text`` (filled cells with pipes between, as is
    embedded) and ``markdown`` (null for plain texts, whose cell text is the trimmed text)."""

    def of(text: str) -> Iterator[tuple]:
        form, tables = tables_of(text)
        if form == "text":
            yield form, 0, text.strip(), None
            return
        lines = [" | ".join(c[0] for c in row if c[0]) for table in tables for row in table]
        yield form, len(lines), "\n".join(x for x in lines if x), "\n\n".join(map(_markdown, map(grid, tables)))

    return _map(rows, id_col, text_col, "format string, n_rows int, cell_text string, markdown string", ["format", "n_rows", "cell_text", "markdown"], of)


def _markdown(lines: list[list[tuple[str, bool, bool]]]) -> str:
    shown = ["| " + " | ".join(c.replace("|", "\\|") if own else "" for c, _, own in line) + " |" for line in lines]
    return "\n".join([*shown[:1], "|" + "|".join([" --- "] * len(lines[0])) + "|", *shown[1:]]) if lines else ""
