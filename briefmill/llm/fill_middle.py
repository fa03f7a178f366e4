"""Fill-in-middle transformation (operator 11) by a sparse index of checkpoints.

A text is a row of units, by default runs of A-Z letters and other single code points. While its units are counted, the
byte and code-point offsets of every 1024th are recorded; a cut is found by a binary search of the checkpoints and a
short rescan from the last one before it. It is a map over the documents, with no shuffle; a text is counted a bounded
block of bytes at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what stands before the prefix, the suffix and the middle
SENTINELS = ("<P>", "<S>", "<M>")
#: units between two checkpoints
EVERY = 1024
#: bytes counted at a time
BLOCK = 1 << 18
#: bytes of output in one batch, or one longer text
OUT_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def _starts(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin in ``part``, and which of its bytes begin a code point."""
    letter, lead = _LETTER[part], (part & 0xC0) != 0x80
    inner = letter.copy()
    inner[0] &= after_letter
    inner[1:] &= letter[:-1]
    return np.flatnonzero(lead & ~inner), lead


class Checkpoints:
    """The number of units of UTF-8 bytes, and the way from a number of units to its byte and code-point offsets."""

    def __init__(self, data: bytes, every: int = EVERY, block: int = BLOCK) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.n = self.chars = 0
        units, at_byte, at_char, after = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], False
        for at in range(0, len(self.data), block):
            part = self.data[at : at + block]
            begins, lead = _starts(part, after)
            marks = np.arange(-self.n % every, len(begins), every)
            units.append(self.n + marks)
            at_byte.append(at + begins[marks])
            at_char.append(self.chars + np.cumsum(lead)[begins[marks]] - 1)
            self.n += len(begins)
            self.chars += int(np.count_nonzero(lead))
            after = bool(_LETTER[part[-1]])
        self.units, self.at_byte, self.at_char = (np.concatenate(x) for x in (units, at_byte, at_char))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units >= self.n:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.units, units, "right")) - 1
        at, more = int(self.at_byte[k]), units - int(self.units[k])
        if not more:
            return at, int(self.at_char[k])
        end = int(self.at_byte[k + 1]) if k + 1 < len(self.at_byte) else len(self.data)
        begins, lead = _starts(self.data[at:end], False)
        return at + int(begins[more]), int(self.at_char[k]) + int(np.count_nonzero(lead[: begins[more]]))


def draws(salt: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the id; a null id counts as an empty one."""
    return struct.unpack(">4I", hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    Both cuts, whether a text is cut at all (``percent`` of them) and whether the suffix comes first (``spm_percent`` of
    those) follow from the id and the ``salt``, so that a lost task gives the same rows again, and equal ids equal
    draws. Null texts count as empty; empty texts and those with a sentinel in them stay plain, with null lengths.
    Repeated rows are transformed each; other columns are ignored, whatever their names.
    """
    before, behind, middle = (s.encode() for s in sentinels)

    def form_of(raw: bytes, h3: int, h4: int) -> str:
        if not raw or h3 % 100 >= percent or before in raw or behind in raw or middle in raw:
            return "plain"
        return "spm" if h4 % 100 < spm_percent else "psm"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.record_batch([*cols[:5], cols[5].cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                raw = text.as_py() or b""
                h1, h2, h3, h4 = draws(salt, doc_id)
                index, form = Checkpoints(raw), form_of(raw, h3, h4)
                out, chars = raw, (None, None)
                if form != "plain":
                    (a, a_chars), (b, b_chars) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
                    chars = (a_chars, b_chars - a_chars)
                    head = (before, raw[:a], behind, raw[b:]) if form == "psm" else (behind, raw[b:], before, raw[:a])
                    out = b"".join((*head, middle, raw[a:b]))
                rows.append((doc_id, index.n, form, *chars, out))
                held += len(out)
                if held >= OUT_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return got.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` has cut, from its output and form alone.

    A cut text holds no sentinel, and none arises where parts meet if a sentinel's first sign stands in no sentinel
    twice; so each occurs once, and the parts between them are the text's.
    """
    before, behind, middle = (re.sub(r"(\W)", r"\\\1", s) for s in sentinels)
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{before}(.*){behind}(.*){middle}(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{behind}(.*){before}(.*){middle}(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
