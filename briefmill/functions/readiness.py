"""Scores of pages, passages and documents, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: quality of a page's text by class (fixed values)
PAGE_LADDER = {"text": 95, "textThin": 70, "ocrHigh": 80, "ocrMid": 70, "ocrLow": 50, "glyph": 0, "missing": 0}
PENALTIES = {"repeat": 8, "bloat": 8, "headings": 6, "chunks": 10}


def page_class(text: Column, confidence: Column, glyph: Column, ocr: Column) -> Column:
    """The class of a page: missing without text, glyph debris, OCR by its confidence (a share or in percent; high where
    none is told), else text by its density."""
    c = F.when(confidence <= 1, confidence * 100).otherwise(confidence)
    blank = text.isNull() | ~text.rlike("\\S")
    by_ocr = F.when(c.isNull() | F.isnan(c.cast("double")) | (c >= 90), "ocrHigh").when(c >= 75, "ocrMid").otherwise("ocrLow")
    return F.when(blank, "missing").when(glyph, "glyph").when(ocr, by_ocr).when(F.length(text) < 150, "textThin").otherwise("text")


def ladder(klass: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in PAGE_LADDER.items() for v in kv])[klass], F.lit(0))


def band(score: Column) -> Column:
    return F.when(score >= 85, "HIGH").when(score >= 70, "OK").when(score >= 50, "RISKY").otherwise("POOR")


def document_score(mean: Column, pages: Column, missing: Column, repeat: Column, bloat: Column, no_headings: Column, few_chunks: Column, critical: Column) -> Column:
    """The mean page score less penalties; missing pages cost 10 + 45 * sqrt(share), rounded, at most 40; critical ones cap it at 84."""
    lost = F.when(missing > 0, F.least(F.lit(40.0), 10 + F.round(45 * F.sqrt(missing / F.greatest(pages, F.lit(1)))))).otherwise(0.0)
    flags = [(repeat, "repeat"), (bloat, "bloat"), (no_headings, "headings"), (few_chunks, "chunks")]
    score = mean - lost
    for flag, name in flags:
        score = score - F.when(flag, PENALTIES[name]).otherwise(0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return F.round(F.when(critical, F.least(score, F.lit(84.0))).otherwise(score))


def replacement_ratio(text: Column) -> Column:
    """The share of characters that stand for undecodable ones."""
    return F.regexp_count(text, F.lit("�")) / F.greatest(F.length(text), F.lit(1))


def bigram_entropies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entropy): entropy in bits of the pairs of neighbouring letters a-z of each text; texts without pairs have no row.

    The pairs are exploded and counted by a grouping with partial aggregation, at most 676 counts a document.
    """
    pairs = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("(?=([a-z][a-z]))"), F.lit(1))).alias("pair"))
    k = F.col("k").cast("double")
    each = pairs.groupBy(id_col, "pair").agg(F.count("*").alias("k"))
    return each.groupBy(id_col).agg((F.log2(F.sum(k)) - F.sum(k * F.log2(k)) / F.sum(k)).alias("entropy"))
