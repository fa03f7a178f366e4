"""A gate for the output of text recognition: why a text is not to be trusted, and what can be saved of one that ran into a loop.

The tests are columns; only the cut points of looping texts are found in Arrow batches. Texts are compared by code point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

WINDOW = 24
LEAST_WINDOWS = 8
LEAST_SALVAGED = 400
LOOP = "repetition-loop"

# Scripts, commands and shapes of tokens that the rules name.
_CJK = r"[\x{2E80}-\x{2EFF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31C0}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}]"
_LATEX = r"\\(?:frac|sin|cos|tan|theta|sqrt|sum|int|alpha|beta|gamma|pi|cdot|times|left|right)\b|\\\(|\\\["
_LONG_BY_NATURE = r"(?i)^(?:https?://|www\.)|@[a-z0-9.-]+\.[a-z]{2,}$|^[a-z]:?[\\/][\w\\/.\-]+$|\.(?:pdf|docx?|xlsx?|html?|txt|jpe?g|png)$"
_OTSL = r"<(?:fcel|lcel|ecel|nl)>"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", "")


def _once(made: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a column that is made once, however often it is named there."""
    return F.get(F.transform(F.array(made), of), F.lit(0))


def _few(parts: Column, least: int, ratio: float) -> Column:
    return _once(parts, lambda x: (F.size(x) >= least) & (F.size(F.array_distinct(x)) < ratio * F.size(x)))


def _windows_repeat(text: Column) -> Column:
    return _few(F.regexp_extract_all(text, F.lit(f"(?s).{{{WINDOW}}}"), F.lit(0)), LEAST_WINDOWS, 0.25)


def loops(text: Column) -> Column:
    """Whether a trimmed text of 240 code points or more repeats its lines or its windows of 24, or a template of at most
    four words around numbers."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), trimmed), lambda x: x != "")
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != ""))
    template = ~F.regexp_like(text, F.lit(r"[|$\t]")) & (F.size(words) <= 4) & _windows_repeat(F.regexp_replace(text, r"\d+", "#"))
    return (F.length(text) >= 240) & (_few(lines, 8, 0.2) | _windows_repeat(text) | template)


def _table_faults(raw: Column) -> list[Column]:
    html, cells, otsl = F.regexp_like(raw, F.lit(r"(?i)<table[\s>]")), _count(raw, r"(?i)<t[dh][\s>]"), _count(raw, _OTSL)
    cut, pipes = F.regexp_like(raw, F.lit(r"(?i)<[a-z][^>]*\z")), F.size(F.filter(F.split(raw, "\n"), lambda x: _count(x, r"\|") >= 2))
    return [
        F.when(F.when(html, cells < 4).otherwise((otsl < 4) & (pipes < 2)), "table-empty"),
        F.when(F.when(html, ~F.regexp_like(raw, F.lit("(?i)</table>")) | cut).otherwise((otsl >= 4) & cut), "table-truncated"),
    ]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _letters(text: Column) -> Column:
    return F.filter(_tokens(text), lambda t: F.regexp_like(t, F.lit(r"(?i)^[a-z]+\z")))


def _unpronounceable(text: Column) -> Column:
    """Eight or more words of letters, under half of them with a vowel and without five consonants in a row."""
    like = lambda t: F.regexp_like(t, F.lit("(?i)[aeiouy]")) & ~F.regexp_like(t, F.lit("(?i)[bcdfghjklmnpqrstvwxz]{5,}"))
    return (F.length(text) >= 60) & _once(_letters(text), lambda x: (F.size(x) >= 8) & (F.size(F.filter(x, like)) < 0.5 * F.size(x)))


def with_reasons(rows: DataFrame, text_col: str, keep: list[str], dictionary: DataFrame, task: str = "ocr") -> DataFrame:
    """The columns ``keep`` and ``reasons``: the names of the faults of a trimmed text, none for an empty one.

    ``task`` is ocr, table, seal, formula or chart. ``dictionary`` has a column ``word`` of lower-case words: a text of
    words that can hardly be spoken is letter soup if under 8 % of them are in it. Only the words of such texts, each
    text once, are joined with the dictionary, and no text is shuffled with its row.
    """
    raw, table, free = F.col(text_col), task == "table", task not in ("table", "seal")
    text = trimmed(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", " "), r"\s+", " ")) if table else raw
    cjk = _count(text, _CJK)
    run = F.aggregate(F.filter(_tokens(text), lambda t: (F.length(t) >= 30) & F.regexp_like(t, F.lit("(?i)[a-z]")) & ~F.regexp_like(t, F.lit(_LONG_BY_NATURE))), F.lit(0), lambda a, t: a + F.length(t))
    tests = [
        *(_table_faults(raw) if table else []),
        *([F.when(loops(text), LOOP)] if free else []),
        F.when((cjk >= 2) & (cjk >= _count(text, "[A-Za-z]")), "unexpected-script"),
        F.when(_count(text, _LATEX) >= 2, "latex-hallucination"),
        *([F.when((F.length(text) >= 60) & (run > 0.3 * F.length(text)), "run-together-text")] if free else []),
    ]
    reasons = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*tests)))
    if not free:
        return rows.select(*keep, reasons.alias("reasons"))
    suspect = F.when(_unpronounceable(text), F.sha2(text.cast("binary"), 256))
    words = rows.select(suspect.alias("soup_key"), F.transform(_letters(text), F.lower).alias("w")).where("soup_key is not null").dropDuplicates(["soup_key"]).select("soup_key", F.explode("w").alias("word"))
    known = dictionary.select("word", F.lit(1).alias("known")).distinct()
    soup = words.join(known, "word", "left").groupBy("soup_key").agg((F.count("known") < 0.08 * F.count("*")).alias("soup")).where("soup")
    told = with_facts(rows.select(*keep, reasons.alias("reasons"), suspect.alias("soup_key")), soup, "soup_key")
    return told.select(*keep, F.when(F.col("soup"), F.array_append("reasons", F.lit("letter-soup"))).otherwise(F.col("reasons")).alias("reasons"))


def with_facts(rows: DataFrame, facts: DataFrame, key: str = "key") -> DataFrame:
    """A left join by ``key``; rows without a key get one of their own, since nulls would all go to one task."""
    own = F.concat(F.lit("-"), F.xxhash64(*[c for c in rows.columns if c != key]).cast("string"))
    return rows.withColumn(key, F.coalesce(key, own)).join(facts, key, "left")


def cuts_of(text: str) -> list[int]:
    """Where a looping text may be cut, as lengths of prefixes: where 8 windows of 24 in a row say nothing new; where under
    a tenth of the lines from here on are new; and after the last new line, without the lines before it that stand
    there three times or more. Lines are compared without case, numbers and white space."""
    found = [_window_cut(text)]
    lines = text.split("\n")
    if len(lines) > 1:
        keys = pd.Series(lines).str.strip().str.lower().str.replace(r"[0-9]+", "#", regex=True).str.replace(r"\s+", " ", regex=True)
        ends = np.cumsum([len(x) + 1 for x in lines]) - 1
        filled = (keys != "").to_numpy()
        new = filled & ~keys.duplicated().to_numpy()
        tail = np.arange(len(lines), 0, -1)
        thin = np.flatnonzero((np.cumsum(new[::-1])[::-1] < 0.1 * tail) & (tail >= 8))
        if len(thin) and thin[0]:
            found.append(int(ends[thin[0] - 1]))
        if new.any():
            last = int(np.flatnonzero(new)[-1])
            settled = ~filled | (keys.map(keys.value_counts()).to_numpy() < 3)
            stays = np.flatnonzero(settled[: last + 1])
            if len(stays):
                found.append(int(ends[stays[-1]]))
    return sorted({len(text[:n].rstrip()) for n in found if n})


def _window_cut(text: str) -> int:
    total = len(text) // WINDOW
    if total < 2 * LEAST_WINDOWS:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[: total * WINDOW]
    _, first = np.unique(np.ascontiguousarray(codes).view(f"V{4 * WINDOW}"), return_index=True)
    new = np.zeros(total, bool)
    new[first] = True
    news = np.r_[np.flatnonzero(new), total]
    dead = np.flatnonzero(np.diff(news) > LEAST_WINDOWS)  # a new window with eight or more old ones behind it
    if not len(dead):
        return 0
    end = int(news[dead[0]] + 1) * WINDOW
    space = max(text.rfind(" ", 0, end + 1), text.rfind("\n", 0, end + 1))
    return space if space > max(0, end - 4 * WINDOW) else end


@F.pandas_udf(ArrayType(IntegerType()))
def cut_points(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else cuts_of(t))


def assess(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", task: str = "ocr") -> DataFrame:
    """One row per row: id, ``n_chars`` of the trimmed text, ``reasons`` and ``salvaged_chars``.

    A text whose only fault is a loop is saved up to the shortest of its cuts that leaves 400 code points or more and
    no fault; then ``salvaged_chars`` is the length of that prefix of the trimmed text, else null. Null and empty
    texts have no faults. Repeated rows are assessed each, their loops once; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), trimmed(F.col(text_col)).alias("raw"))
    may_loop = (F.lit(task not in ("table", "seal")) & (F.col("raw") != "") & loops(F.col("raw")))
    rows = rows.withColumn("key", F.when(may_loop, F.sha2(F.col("raw").cast("binary"), 256))).withColumn("n_chars", F.length("raw"))
    looping = rows.where("key is not null").select("key", "raw").dropDuplicates(["key"])
    cut = looping.select("key", F.explode(cut_points("raw")).alias("n"), "raw").where(F.col("n") >= LEAST_SALVAGED).select("key", "n", F.substring("raw", F.lit(1), F.col("n")).alias("part"))
    saved = with_reasons(cut, "part", ["key", "n"], dictionary, task).where(F.size("reasons") == 0).groupBy("key").agg(F.min("n").alias("saved"))
    told = with_facts(with_reasons(rows, "raw", ["id", "n_chars", "key"], dictionary, task), saved)
    only_loop = F.col("reasons") == F.array(F.lit(LOOP))
    return told.select(F.col("id").alias(id_col), "n_chars", "reasons", F.when(only_loop, F.col("saved")).alias("salvaged_chars"))


def common_words(docs: DataFrame, least: int, text_col: str = "text") -> DataFrame:
    """The lower-case words of letters in at least ``least`` texts, as a dictionary."""
    words = F.array_distinct(F.transform(_letters(F.coalesce(F.col(text_col), F.lit(""))), F.lower))
    return docs.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") >= least).select("word")
