"""Chunkers: rows of text to rows of chunks. Overlap and carried state make them sequential within a text, so they run
in Arrow batches, a text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: separators of a recursive splitter, coarse to fine
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")


# Where a pleading or a transcript is cut first, coarse to fine.
LEGAL_SEPARATORS = ("\n\nSECTION ", "\n\nARTICLE ", "\n\nWHEREAS", "\n\nORDER", "\n\nFINDINGS OF FACT", "\n\nCONCLUSIONS OF LAW", "\nTHE COURT", "\nTHE WITNESS", "\nBY MS. ", "\nBY MR. ", "\nMS. ", "\nMR. ", "\nQ. ", "\nA. ", "\nQ ", "\nA ", "\n\n", "\n", ". ", "? ", "! ", "; ", " ")
_HEADING = re.compile(r"[A-Z][A-Z0-9 ,.'&:-]{2,}|(?:[IVXLC]+|[A-Z]|\d{1,3})\.\s+\S.*")


def by_tokens(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Paragraphs, and where they are too long sentences, are filled up to ``size`` words; each chunk repeats the last ``overlap``."""
    units: list[list[str]] = []
    for paragraph in re.split(r"\n\s*\n", text):
        words = paragraph.split()
        for part in [paragraph] if len(words) <= size else re.split(r"(?<=[.!?])\s+", paragraph):
            words = part.split()
            units += [words[i : i + size] for i in range(0, len(words), size)]
    chunks, now, fresh = [], [], 0
    for unit in units:
        if now and len(now) + len(unit) > size:
            if fresh:
                chunks.append(" ".join(now))
            now, fresh = now[-min(overlap, max(0, size - len(unit))) :] if overlap and size > len(unit) else [], 0
        now, fresh = now + unit, fresh + len(unit)
    if fresh:
        chunks.append(" ".join(now))
    return chunks


def recursive(text: str, limit: int = 1000, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the coarsest separator that does; joined they are the text."""
    if len(text) <= limit:
        return [text] if text else []
    if not separators:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    parts = text.split(separators[0])
    out, now = [], ""
    for i, part in enumerate(parts):
        part += separators[0] if i < len(parts) - 1 else ""
        if len(now) + len(part) <= limit:
            now += part
            continue
        if now:
            out.append(now)
            now = ""
        if len(part) <= limit:
            now = part
        else:
            out += recursive(part, limit, separators[1:])
    return out + ([now] if now else [])


def before_separators(text: str, limit: int, separators: tuple[str, ...] = LEGAL_SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` characters; each separator begins the piece after it, and joined they are the text."""
    if len(text) <= limit:
        return [text] if text else []
    for n, sep in enumerate(separators):
        at = [m.start() for m in re.finditer(re.escape(sep), text) if m.start()]
        if not at:
            continue
        out, now = [], ""
        for a, b in zip([0, *at], [*at, len(text)]):
            part = text[a:b]
            if now and len(now) + len(part) > limit:
                out.append(now)
                now = ""
            if len(part) > limit:
                cut = before_separators(part, limit, separators[n + 1 :])
                out += cut[:-1]
                part = cut[-1]
            now += part
        return [*out, now]
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body): a line in capitals or with a section's number begins a section; what comes first has no heading."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if len(line) <= 120 and _HEADING.fullmatch(line.strip()):
            out.append((line.strip(), []))
        else:
            out[-1][1].append(line)
    return [(h, body) for h, lines in out if (body := "\n".join(lines).strip()) or h]


def by_sections(text: str, limit: int = 1000, prefix: str = "") -> list[str]:
    """Each section's body in pieces of at most ``limit`` characters, under the ``prefix`` and the section's heading."""
    out = []
    for heading, body in sections(text):
        lead = prefix + heading
        out += [f"{lead}\n{piece}" if heading else prefix + piece for piece in before_separators(body, limit)] if body else [lead]
    return out


def table_fragments(text: str, limit: int = 2048) -> list[str]:
    """A table's lines in fragments of at most ``limit`` characters, each of which begins with the header line."""
    lines = text.split("\n")
    out, now = [], [lines[0]]
    for line in lines[1:]:
        if len(now) > 1 and sum(map(len, now)) + len(now) + len(line) > limit:
            out.append("\n".join(now))
            now = [lines[0]]
        now.append(line)
    return [*out, "\n".join(now)]


def chunk(docs: DataFrame, splitter: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, text) of each document's chunks; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(i, n, c) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t is not None for n, c in enumerate(splitter(t))]
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["id", "chunk_index", "text"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, chunk_index int, text string").withColumnRenamed("id", id_col)
