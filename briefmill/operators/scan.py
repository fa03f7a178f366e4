"""Exact pattern scans over passages: guarded regular expressions, tolerant forms, matched spans and keyset pages."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: quotes, primes, dashes and spaces that are folded to the plain form (fixed values)
_PLAIN = {
    "'": "\u2018\u2019\u201a\u201b\u2032\u2035",
    '"': "\u201c\u201d\u201e\u201f\u2033\u2036",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212",
    " ": "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u3000",
}
_MARKS = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
#: escapes that stand for a place or white space, and so bind no iteration to a character (fixed values)
_LOOSE = frozenset("bsnrtfvWAZz")


def _letters() -> dict[str, str]:
    """Characters of one compatible plain character once their marks are taken off: accented, wide and raised letters."""
    known = {c for of in _PLAIN.values() for c in of}
    out = {c: plain for plain, of in _PLAIN.items() for c in of}
    for c in map(chr, [*range(0xA0, 0x3000), *range(0xFF01, 0xFF5F)]):
        plain = re.sub(_MARKS, "", unicodedata.normalize("NFKD", c))
        if c not in known and len(plain) == 1 and plain != c:
            out[c] = plain
    return out


_LETTERS = _letters()
_LIGATURES = {c: unicodedata.normalize("NFKD", c) for c in map(chr, [0x2026, *range(0xFB00, 0xFB07)])}


def _atoms(body: str) -> list[tuple[str, str]]:
    """The atoms of a pattern with the quantifier of each; groups, alternation and anchors are passed over."""
    found = re.findall(r"(\\.|\[(?:\\.|[^\]\\])*\]|[^|()^$])([*+?]|\{[^}]*\}?)?", body, re.S)
    return [(atom, q) for atom, q in found]


def _runs_away(body: str) -> bool:
    """Whether a repeated ``body`` may match one text in many ways: an open quantifier, and no atom that each turn must take."""
    atoms = _atoms(body)
    open_ = any(q in ("*", "+") or re.fullmatch(r"\{\d+,\s*\}?", q) for _, q in atoms)
    fixed = any(not q and not (atom[0] == "\\" and atom[1:] in _LOOSE) for atom, q in atoms)
    return open_ and not fixed


def guard(pattern: str) -> str:
    """The pattern, or an error where it may run away: a repeated group that ``_runs_away``, or an open look-behind."""
    re.compile(pattern)
    opened: list[int] = []
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\(|\)([*+{])?", pattern, re.S):
        if m[0] == "(":
            opened.append(m.end())
        elif m[0][0] == ")" and opened:
            start = opened.pop()
            if m[1] and _runs_away(pattern[start : m.start()]):
                raise ValueError("a repeated group must take a fixed character in each turn")
    if re.search(r"\(\?<[=!][^)]*[+*]", pattern):
        raise ValueError("a look-behind must have a bounded length")
    return pattern


def folded(text: Column) -> Column:
    """Quotes, dashes, spaces and letters with marks in their plain forms, each one character; ligatures become several."""
    once = F.translate(text, "".join(_LETTERS), "".join(_LETTERS.values()))
    for c, plain in _LIGATURES.items():
        once = F.replace(once, F.lit(c), F.lit(plain))
    return F.regexp_replace(once, _MARKS, "")


def folded_pattern(pattern: str) -> str:
    """A pattern in the plain forms of ``folded``, so that both sides of a comparison are folded."""
    out = "".join(_LIGATURES.get(c, _LETTERS.get(c, c)) for c in pattern)
    return re.sub(_MARKS, "", out)


def tolerant(pattern: str) -> str:
    """Runs of spaces outside classes may also be a line's end with a printed line number; a quantified run stays as it is."""
    def widen(m: re.Match) -> str:
        return r"\s+(?:\d{1,3}\s+)?" if m[0][0] == " " and not m[1] else m[0]

    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]| +([+*?{])?", widen, pattern, flags=re.S)


def scan(rows: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows that match, whatever the case, with the first ``match`` and its place ``at`` from 1."""
    p = F.lit(f"(?i){guard(pattern)}")
    text = F.col(text_col)
    return rows.where(F.regexp_like(text, p)).withColumns({"match": F.regexp_substr(text, p), "at": F.regexp_instr(text, p)})


def crossing_lines(rows: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Tolerant matches, with whether the match ``crosses`` a printed line: it does where the strict pattern fails."""
    plain = folded_pattern(guard(pattern))
    strict, wide = F.lit(f"(?i){plain}"), F.lit(f"(?i){tolerant(plain)}")
    text = folded(F.col(text_col))
    return rows.where(F.regexp_like(text, wide)).withColumn("crosses", ~F.regexp_like(text, strict))


def page_after(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in the order of ``keys`` beyond the key ``after``: no offset is counted again."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(x).cast(rows.schema[k].dataType) for k, x in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def absence(rows: DataFrame, pattern: str, scope: list[str]) -> DataFrame:
    """For each value of ``scope``: rows searched and rows matched; no match among searched rows is a proven absence."""
    hit = F.regexp_like("text", F.lit(f"(?i){guard(pattern)}"))
    return rows.groupBy(*scope).agg(F.count("*").alias("searched"), F.count_if(hit).alias("matched")).withColumn("absent", F.col("matched") == 0)
