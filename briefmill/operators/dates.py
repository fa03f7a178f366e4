"""Dates that texts name: rules in order, of which the first to take a span keeps it."""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of months as texts write them, and the words that end a date after a preposition.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_SHORT = r"Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
_STOP = r"(?=$|[,.;]|\s(?:by|in|on|for|with|filed|signed)\b)"
_STOP_BETWEEN = r"(?=$|[,.;]|\s(?:by|in|on|for|with|filed|signed|the|a)\b)"

_LONG = "|".join(m.capitalize() for m in MONTHS)
#: (name, pattern) in the order in which spans are taken
RULES = [
    ("today", r"\btoday\b"),
    ("yesterday", r"\byesterday\b"),
    ("tomorrow", r"\btomorrow\b"),
    ("week", r"\b(last|this|next)\s+week\b"),
    ("between", rf"\bbetween\s+([A-Za-z0-9,/\s-]+?)\s+and\s+([A-Za-z0-9,/\s-]+?){_STOP_BETWEEN}"),
    ("after", rf"\b(?:after|since)\s+([A-Za-z0-9,/\s-]+?){_STOP}"),
    ("before", rf"\bbefore\s+([A-Za-z0-9,/\s-]+?){_STOP}"),
    ("iso", r"\b(\d{4}-\d{2}-\d{2})\b"),
    ("us", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"),
    ("words", rf"\b((?:{_LONG}|{_SHORT})\.?\s+\d{{1,2}}(?:,?\s+\d{{4}})?)\b"),
]
_RULES = [(name, re.compile(pattern, re.I | re.A)) for name, pattern in RULES]
FIRST, LAST = dt.date(1, 1, 1), dt.date(9999, 12, 31)


def _date(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def parsed(text: str, today: dt.date) -> dt.date | None:
    """yyyy-m-d, m/d/yyyy, m/d/yy (from 70 on in the last century) or a month's name, day and perhaps a year."""
    plain = text.strip().replace(".", "").replace(",", "")
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", plain, re.A):
        return _date(*map(int, m.groups()))
    if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{2,4})", plain, re.A):
        month, day, year = map(int, m.groups())
        return _date(year + (2000 if year < 70 else 1900 if year < 100 else 0), month, day)
    if m := re.fullmatch(r"([A-Za-z]+)\s+(\d{1,2})(?:\s+(\d{4}))?", plain, re.A):
        name = m[1].lower()
        month = next((i for i, full in enumerate(MONTHS, 1) if name == full or name == full[:3] or (name == "sept" and i == 9)), 0)
        return _date(int(m[3] or today.year), month, int(m[2]))
    return None


def _meaning(rule: str, m: re.Match, today: dt.date) -> tuple[dt.date, dt.date] | None:
    days = {"today": 0, "yesterday": -1, "tomorrow": 1}
    if rule in days:
        day = today + dt.timedelta(days[rule])
        return day, day
    if rule == "week":  # from Monday to Sunday
        monday = today - dt.timedelta(today.weekday()) + dt.timedelta(7 * ("last", "this", "next").index(m[1].lower()) - 7)
        return monday, monday + dt.timedelta(6)
    named = [parsed(g, today) for g in m.groups()]
    if None in named:
        return None
    if rule == "between":
        return named[0], named[1]
    return (named[0] if rule != "before" else FIRST), (LAST if rule == "after" else named[0])


def spans(text: str, today: dt.date) -> list[tuple[int, int, str, dt.date, dt.date]]:
    """(start, end, rule, first day, last day) of each date, in the order of the text; no two overlap."""
    taken, found = [], []  # spans, sorted, to tell overlaps by a search
    for rule, pattern in _RULES:
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_left(taken, (a, b))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            if meant := _meaning(rule, m, today):
                insort(taken, (a, b))
                found.append((a, b, rule, *meant))
    return sorted(found)


def mentions(rows: DataFrame, today: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per date that a text names: id, ``start`` and ``stop`` (code points, from 0), ``rule``, ``first_day``, ``last_day``.

    ``today`` (yyyy-mm-dd) is the day of relative dates and of dates without a year. Open ranges begin in year 1 or
    end in 9999. A span goes to the first rule that takes it; what names no day of the calendar is no date. Null and
    empty texts name none. Repeated rows count each; other columns are ignored.
    """
    day = dt.date.fromisoformat(today)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in spans(t or "", day)]
            for at in range(0, len(found), 50_000):
                types = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.date32(), pa.date32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found[at : at + 50_000]), types)], names=["id", "start", "stop", "rule", "first_day", "last_day"])

    might = F.regexp_like(F.col(text_col), F.lit(r"(?i)\d|\btoday\b|\byesterday\b|\btomorrow\b|\sweek\b"))  # the rest needs no Python
    src = rows.where(might).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, start int, stop int, rule string, first_day date, last_day date").withColumnRenamed("id", id_col)
