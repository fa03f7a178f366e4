"""Chunks of laid-out pages: a table function that reads a page's blocks in order and carries the heading from row to row."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

PROSE, TABLE, HEADING, LEAST_BODY = 1000, 2048, 192, 300
FIGURE_CHARS, FIGURE_LETTERS = 40, 0.55
SCHEMA = "page long, part int, kind string, heading string, first_block int, last_block int, text string"


def shortened(text: str, limit: int) -> str:
    """Texts over ``limit`` keep whole words of their two ends."""
    if len(text) <= limit:
        return text
    keep = (limit - 1) // 2
    return re.sub(r"\s+\S*\Z", "", text[:keep]) + " … " + re.sub(r"\A\S*\s+", "", text[-keep:])


def sentences(text: str, limit: int) -> Iterator[str]:
    """Sentences filled up to ``limit``; a longer one is cut."""
    now = ""
    for s in re.split(r"(?<=[.?!;:])\s+", text):
        if now and len(now) + 1 + len(s) > limit:
            yield now
            now = s
        else:
            now = f"{now} {s}" if now else s
        while len(now) > limit:
            yield now[:limit]
            now = now[limit:]
    if now:
        yield now


class PageChunks:
    """One partition is one page, its rows the blocks (page, place, kind, text) by place. What is held is the chunk at hand."""

    def __init__(self) -> None:
        self.prefix, self.heading, self.now, self.blocks, self.notes = "", "", "", [], True
        self.page, self.part, self.spare, self.spare_blocks = None, 0, "", []

    def _chunk(self, kind: str, body: str, blocks: list[int]) -> tuple:
        lead = self.prefix + (self.heading + "\n" if self.heading else "")
        self.part += 1
        return self.page, self.part - 1, kind, self.heading or None, blocks[0], blocks[-1], lead + body

    def _room(self) -> int:
        return max(LEAST_BODY, PROSE - len(self.prefix) - (len(self.heading) + 1 if self.heading else 0))

    def _flush(self) -> Iterator[tuple]:
        if self.now.strip():
            yield self._chunk("footnote" if self.notes else "paragraph", self.now, self.blocks)
        self.now, self.blocks, self.notes = "", [], True

    def _prose(self, kind: str, text: str, place: int) -> Iterator[tuple]:
        room = self._room()
        for piece in sentences(text, room) if len(text) > room else [text]:
            if self.now and len(self.now) + 1 + len(piece) > room:
                yield from self._flush()
            self.now = f"{self.now}\n{piece}" if self.now else piece
            self.blocks.append(place)
            self.notes &= kind == "footnote"

    def _table(self, text: str, place: int) -> Iterator[tuple]:
        """Whole, or in parts that each begin with the first line."""
        if len(text) <= TABLE:
            yield self._chunk("table", text, [place])
            return
        head, *lines = text.split("\n")
        rows, size = [], len(head)
        for line in lines:
            if rows and size + 1 + len(line) > TABLE:
                yield self._chunk("table", "\n".join([head, *rows]), [place])
                rows, size = [], len(head)
            rows.append(line)
            size += 1 + len(line)
        if rows or not lines:
            yield self._chunk("table", "\n".join([head, *rows]), [place])

    def eval(self, row: Row, prefix: str) -> Iterator[tuple]:
        self.page, self.prefix = row["page"], prefix
        kind, text, place = row["kind"], (row["text"] or "").strip(), row["place"]
        if text and len(self.spare) < PROSE:  # for pages of nothing but headers, seals and the like
            self.spare, self.spare_blocks = f"{self.spare}\n{text}" if self.spare else text, [*self.spare_blocks, place]
        if kind == "heading":
            yield from self._flush()
            self.heading = shortened(re.sub(r"\n+", " ", text), HEADING)
        elif kind == "table" and text:
            yield from self._flush()
            yield from self._table(text, place)
        elif kind == "figure":
            if len(text) >= FIGURE_CHARS and len(re.findall("[a-zA-ZÀ-ɏ]", text)) >= FIGURE_LETTERS * len(text):
                yield from self._flush()
                yield self._chunk("figure", "Figure: " + shortened(text, TABLE), [place])
        elif kind in ("paragraph", "footnote", "unknown") and text:
            yield from self._prose(kind, text, place)

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()
        if not self.part and self.spare:
            yield self._chunk("page_fallback", shortened(self.spare, self._room()), self.spare_blocks)


def page_chunks(blocks: DataFrame, prefix: str = "") -> DataFrame:
    """Chunks of each page: ``page``, ``part``, ``kind``, ``heading``, ``first_block``, ``last_block``, ``text``.

    ``blocks`` has page, place, kind and text. Paragraphs under one heading are filled up to 1,000 characters with the
    ``prefix`` and heading, which begin each chunk; long ones are cut at sentences. A table is one chunk, or parts of 2,048
    characters under its first line. Figures count if they are mostly letters; headers, numbers, seals and signatures
    only where a page has nothing else, and then their first 1,000 characters. Null and blank texts, and blocks of
    null pages, give nothing; equal places keep the order of kind and text. Other columns are ignored.
    """
    rows = blocks.where("page is not null").select(F.col("page").cast("long").alias("page"), F.col("place").cast("int").alias("place"), "kind", "text")
    return F.udtf(PageChunks, returnType=SCHEMA)(rows.asTable().partitionBy("page").orderBy("place", "kind", "text"), F.lit(prefix))
