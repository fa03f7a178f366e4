"""Text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation(kind: Column, volume: Column, volumes: Column, page: Column, first: Column, last: Column, supplement: Column, case: Column) -> Column:
    """(full, short, type) of a page: '3 2nd Supp. RR 12:4-9' for a reporter's record, '3 CR 12' for a clerk's, which has no
    lines, and 'Exhibit Vol. 3, p. 12' for others; the full one begins with the case's number.

    The volume, 1 where it is null, is shown if there are several, for others only where it is known. ``supplement`` is
    null or 0 for none; other kinds than the records do not tell it.
    """
    plain = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    clerk = plain.contains("clerk") | (plain == "cr")
    reporter = ~clerk & (plain.contains("reporter") | (plain == "rr"))
    teen = (supplement % 100).between(11, 13)
    end = F.when(teen, "th").when(supplement % 10 == 1, "st").when(supplement % 10 == 2, "nd").when(supplement % 10 == 3, "rd").otherwise("th")
    supp = F.when(supplement > 1, F.concat(supplement.cast("string"), end, F.lit(" Supp. "))).when(supplement == 1, "Supp. ").otherwise("")
    several = F.coalesce(volumes, F.lit(0)) > 1
    vol = F.when(several, F.concat(F.coalesce(volume, F.lit(1)).cast("string"), F.lit(" "))).otherwise("")
    lines = F.when(first.isNull(), "").when(last.isNull() | (last == first), F.concat(F.lit(":"), first.cast("string"))).otherwise(F.concat(F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))
    number = page.cast("string")
    name = F.when(clerk, "CR").when(reporter, "RR")
    record = F.concat(vol, supp, name, F.lit(" "), number, F.when(reporter, lines).otherwise(""))
    label = F.coalesce(F.nullif(kind, F.lit("")), F.lit("Doc"))
    other = F.concat(label, F.when(several & (volume > 0), F.concat(F.lit(" Vol. "), volume.cast("string"), F.lit(","))).otherwise(""), F.lit(" p. "), number)
    short = F.when(clerk | reporter, record).otherwise(other)
    full = F.when(F.coalesce(case, F.lit("")) != "", F.concat(case, F.lit(" "), short)).otherwise(short)
    return F.struct(full.alias("full"), short.alias("short"), F.when(name.isNull(), "generic").when(supp != "", F.concat(F.lit("Supp. "), name)).otherwise(name).alias("type"))


def truncate_middle(text: Column, limit: int) -> Column:
    """Texts over ``limit`` keep their two ends around an ellipsis."""
    half = (limit - 5) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(" ... "), F.right(text, F.lit(half))))


def snippet(text: Column, needle: str, before: int = 60, after: int = 140) -> Column:
    """The text around the first hit, whatever the case; null without one."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + after))


def sentences(text: Column) -> Column:
    """Parts that end with . ! or ? before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def speaker(line: Column) -> Column:
    """The label before a colon in capitals, else Q or A, else null."""
    label = F.regexp_extract(line, r"^\s*([A-Z][A-Z .']{1,40}):", 1)
    qa = F.regexp_extract(line, r"^\s*([QA])[.:]?\s", 1)
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(qa, F.lit("")))


def heading(line: Column) -> Column:
    """A short line in capitals, or one that a section number starts."""
    return (F.length(line) <= 120) & (F.regexp_like(line, F.lit(r"^[A-Z][A-Z0-9 ,.'&-]{3,}$")) | F.regexp_like(line, F.lit(r"^(?:[IVXLC]+|[A-Z]|\d{1,3})\.\s+\S")))


def printed_line_numbers(text: Column) -> Column:
    """First and last of the numbers from 1 to 25 that begin lines; null if fewer than two."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d{1,2})\s"), F.lit(1)), lambda n: n.cast("int"))
    kept = F.filter(found, lambda n: (n >= 1) & (n <= 25))
    return F.when(F.size(kept) >= 2, F.struct(F.array_min(kept).alias("first"), F.array_max(kept).alias("last")))


def draft_score(text: Column, name: Column) -> Column:
    """How much a text looks like a draft, from 0 to 1: stamps and blanks add, filing stamps and final names take away."""
    hits = F.when(F.regexp_like(text, F.lit(r"(?i)\bdraft\b")), 0.5).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * F.regexp_count(text, F.lit(r"_{4,}|\[[^\]]{0,40}\]|(?i)\btbd\b")))
    stamp = F.regexp_like(text, F.lit(r"(?i)\b(?:filed|received|e-filed)\b"))
    final = F.regexp_like(name, F.lit(r"(?i)final|filed"))
    s = hits + F.when(stamp, -0.4).otherwise(0.1) + F.when(final, -0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6)


def name_key(name: Column) -> Column:
    """Lower case, without titles, suffixes, initials and signs."""
    plain = F.regexp_replace(F.lower(name), r"[^a-z ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(?:mr|mrs|ms|dr|hon|jr|sr|esq|judge|justice|[a-z])\b", " "), r"\s+", " "))


def any_date(text: Column) -> Column:
    """The first of the usual formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "d MMMM yyyy")]).cast("date")
