"""Rules that the queries' tables do not reach, each against plain Python or cases by hand."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from briefmill.functions import readiness
from briefmill.functions.text import citation
from briefmill.operators import relations, retrieval, scan


def test_guard_asks_for_a_fixed_character_in_each_turn():
    for fine in (r"(No\.\s*\d+)+", "(ab+c)+", "(?:MR|MS)+", "[(a+)+]", r"\(a+\)+", "(a{2,3}b)*", "(x[)]+y)+"):
        assert scan.guard(fine) == fine
    for bad in ("(a+)+", "((a+))+", r"(\d+)+", r"(\s*\w*)*", "([ab]*)+", "(a{2,})*", r"(\s+\b)+", "(?<=a+)b"):
        with pytest.raises((ValueError, re.error)):
            scan.guard(bad)


def test_runs_of_spaces_are_one_gap():
    gap = r"\s+(?:\d{1,3}\s+)?"
    for pattern, want in (("a b", f"a{gap}b"), ("a  b", f"a{gap}b"), ("a  +b", "a  +b"), ("a {2}b", "a {2}b"), ("[a b] c", f"[a b]{gap}c"), (r"a\ b", r"a\ b")):
        assert scan.tolerant(pattern) == want


def test_folding_both_sides(spark):
    texts = ["don’t — “go”", "été", "ﬁle … ＡＢ", "x y z　w", "5′ 6″ ‐‒―", "漢字 plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scan.folded(F.col("t"))).collect()]
    assert got == ["don't - \"go\"", "ete", "file ... AB", "x y z w", "5' 6\" ---", "漢字 plain"]
    assert all(scan.folded_pattern(t) == g for t, g in zip(texts, got))
    assert unicodedata.normalize("NFKD", "ﬁ") == scan.folded_pattern("ﬁ")
    rows = spark.createDataFrame([("the café’s\n 12 door",)], "text string")
    assert scan.crossing_lines(rows, "café's door").collect()[0]["crosses"]


def test_page_classes_and_the_penalty_of_missing_pages(spark):
    rows = [("", None, True, True, "missing"), (" \n", 0.99, False, True, "missing"), ("x", None, True, False, "glyph"), ("x", None, False, True, "ocrHigh"), ("x", 0.9, False, True, "ocrHigh"), ("x", 89.0, False, True, "ocrMid"), ("x", 0.74, False, True, "ocrLow"), ("x", 0.1, False, False, "textThin"), ("x" * 150, None, False, False, "text")]
    df = spark.createDataFrame(rows, "text string, c double, glyph boolean, ocr boolean, want string")
    assert df.where(readiness.page_class(F.col("text"), F.col("c"), F.col("glyph"), F.col("ocr")) != F.col("want")).count() == 0
    no = F.lit(False)
    got = spark.range(1).select(readiness.document_score(F.lit(95.0), F.lit(7), F.lit(1), no, no, no, no, no)).first()[0]
    assert got == round(95 - (10 + round(45 * (1 / 7) ** 0.5)))


def test_open_ranges_tie_by_the_smallest_id(spark):
    points = spark.createDataFrame([(1, "f", 10), (2, "f", 3), (3, "g", 10), (4, "f", 25)], "pid long, k string, at long")
    ranges = spark.createDataFrame([("f", 5, 5, None), ("f", 9, 1, None), ("f", 2, 8, 12), ("f", 1, 0, 40), ("f", 3, 8, 12)], "k string, range_id long, start long, end long")
    got = {r["pid"]: r["range_id"] for r in relations.narrowest_range(points, ranges, "k", "at", "pid", 5).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 1}
    only_open = {r["pid"]: r["range_id"] for r in relations.narrowest_range(points, ranges.where("end is null"), "k", "at", "pid", 5).collect()}
    assert only_open == {1: 5, 2: 9, 3: None, 4: 5}


def test_quotes_of_any_length_within_words(spark):
    docs = [(1, "the unbeknownst matter of law"), (2, "be now"), (3, None), (4, "matter\nof  law"), (5, "antimatter of laws")]
    quotes = [(10, "matter of law"), (11, "beknown"), (12, "now"), (13, ""), (14, None), (15, "ter of"), (16, "atter  of la"), (17, " of ")]
    got = {tuple(r) for r in retrieval.holds_quote(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")).collect()}
    assert got == {(d, q) for d, t in docs for q, s in quotes if t and s and s in t}


def test_packing_skips_what_does_not_fit(spark):
    rows = [("a", i, n) for i, n in enumerate((5, 7, 4, 1, 100, 2))] + [("b", 1, 10), ("b", 2, 1), (None, 3, 4), ("c", 4, None)]
    got = {tuple(r) for r in retrieval.pack_budget(spark.createDataFrame(rows, "g string, i long, n long"), "g", ["i"], F.col("n"), 10).collect()}
    assert got == {("a", 0, 5), ("a", 2, 4), ("a", 3, 1), ("b", 1, 10), (None, 3, 4)}


def test_citations(spark):
    no = F.lit(None)
    c = lambda n: citation(F.lit("RR"), F.lit(2), F.lit(3), F.lit(12), F.lit(4), F.lit(9), F.lit(n), no)
    got = spark.range(1).select(*[c(n)["short"].alias(f"c{n}") for n in (0, 1, 2, 3, 4, 11, 12, 13, 21, 22)]).first()
    assert list(got) == [f"2 {p}RR 12:4-9" for p in ("", "Supp. ", "2nd Supp. ", "3rd Supp. ", "4th Supp. ", "11th Supp. ", "12th Supp. ", "13th Supp. ", "21st Supp. ", "22nd Supp. ")]
    i = lambda x: F.lit(x).cast("int")
    odd = [
        citation(F.lit("Clerk's Record"), i(None), i(2), i(5), i(3), i(4), i(1), F.lit("D-1")),
        citation(F.lit("Reporter's Record Vol"), i(3), i(1), i(5), i(3), i(3), i(None), F.lit("")),
        citation(F.lit("Exhibit"), i(None), i(2), i(5), i(3), i(4), i(1), no),
        citation(F.lit(None).cast("string"), i(2), i(2), i(5), i(3), i(4), i(1), F.lit("D-1")),
    ]
    assert [tuple(x) for x in spark.range(1).select(*odd).first()] == [("D-1 1 Supp. CR 5", "1 Supp. CR 5", "Supp. CR"), ("RR 5:3", "RR 5:3", "RR"), ("Exhibit p. 5", "Exhibit p. 5", "generic"), ("D-1 Doc Vol. 2, p. 5", "Doc Vol. 2, p. 5", "generic")]
