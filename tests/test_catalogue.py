"""Catalogue operators on odd rows."""

import pytest
from pyspark.sql import functions as F

from briefmill.operators import catalogue as c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "filed", 5), (2, "b", "draft", 6), (3, "b", "", 7), (4, None, None, 7)], "id int, case string, status string, filing int")
    by = {"case": "case", "status": "status"}
    ask = lambda **w: [r["id"] for r in df.where(c.metadata_filter(w, by)).collect()]
    assert ask() == [1, 2, 3, 4] and ask(status="any", cases=[]) == [1, 2, 3, 4] and ask(case="b") == [2, 3]
    assert ask(case="a", cases=["b"]) == [2, 3] and ask(status="not-draft") == [1, 3] and ask(status="filed", case="b") == []
    with pytest.raises(KeyError):
        ask(other=1)
    scope = lambda a, b: [r["id"] for r in df.where(c.scope_filter(a, b, "case", "filing")).collect()]
    assert scope([], None) == [1, 2, 3, 4] and scope(["a"], [7]) == [1, 3, 4] and scope([], [6]) == [2]
    assert [r["id"] for r in c.in_cases(df, df, "case", many=["b", "b"]).collect()] == [2, 3] and c.in_cases(df, df, "case").count() == 4
    for bad in ({"one": "a", "many": ["b"]}, {"one": "zz"}, {"many": ["a", "zz"]}):
        with pytest.raises(ValueError):
            c.in_cases(df, df, "case", **bad)
    assert rows(c.page_of(df.select("id"), [F.desc("id")], 2, 1)) == [(2, 4), (3, 4)] and c.page_of(df.limit(0), [F.col("id")], 5).count() == 0


def test_patches_and_tags(spark):
    df = spark.createDataFrame([(1, "x", {"a": "1", "b": "2"}), (2, "y", None), (3, "z", {"a": "1"})], "id int, col string, tags map<string,string>")
    patches = spark.createDataFrame([(1, 1, {"col": "old"}), (1, 2, {"col": " ", "a": "", "c": "3", "dis": "d", "colLabel": "l"}), (2, 1, {"ref": "@q", "n": None}), (9, 1, {"col": "no"})], "id int, seq int, patch map<string,string>")
    got = c.committed(df, patches, "id", ["col"], {"ref": "col"}, ["dis"])
    assert [(r["id"], r["col"], r["tags"]) for r in got.orderBy("id").collect()] == [(1, None, {"b": "2", "c": "3"}), (2, "q", {}), (3, "z", {"a": "1"})]
    rules = spark.createDataFrame([("a", "number", True), ("b", "ref", False), ("d", "date", False)], "tag string, type string, required boolean")
    told = spark.createDataFrame([(1, {"a": "1.5", "b": "@x", "d": "2024-02-29"}), (2, {"a": None, "b": "x", "d": "2024-02-30", "z": "1"}), (3, None), (4, {})], "id int, tags map<string,string>")
    assert {r["id"]: r["errors"] for r in c.tag_errors(told, "id", "tags", rules).collect()} == {1: [], 2: ["a:number", "b:ref", "d:date", "z:unknown"], 3: ["a:missing"], 4: ["a:missing"]}


def test_repeated_content(spark):
    foot = "Page %d of the record"
    one = [("a", p, f"line number {chr(97 + p)} is here\n{foot % p}") for p in range(5)]  # a footer is boilerplate
    two = [("b", p, "the same page 7\n again") for p in range(3)]
    three = [("c", 0, "only one page\nonly one page"), ("d", 0, None), ("d", 1, "")]
    four = [("e", p, "\n".join(["row of a table", f"own {chr(97 + p)} text"]) if p < 3 else "quite another text") for p in range(5)]
    got = {r["doc"]: (r["same_pages"], round(r["duplicates"], 3), r["fired"]) for r in c.repeated_content(spark.createDataFrame(one + two + three + four, "doc string, page int, text string")).collect()}
    assert got == {"a": (0, 0.0, False), "b": (1, 0.0, True), "c": (0, 0.0, False), "d": (0, 0.0, False), "e": (0, 0.375, True)}


def test_printed_lines(spark):
    items = [(1, i, x, y, t) for i, (x, y, t) in enumerate([(90, 700, "Q. Did"), (130, 701, "you?"), (40, 700.5, "1"), (41, 680, "2"), (90, 680, "A. No"), (40, 660, "3"), (90, 660, "x"), (42, 640, "4"), (300, 620, "7"), (310, 620, "of 9"), (5, 600, "  ")])]
    items += [(2, 0, 10, 5, "1"), (2, 1, 20, 5, "text")]
    got = rows(c.printed_lines(spark.createDataFrame([(p, s, float(x), float(y), t) for p, s, x, y, t in items], "page int, seq int, x double, y double, text string")))
    assert got == sorted([(1, 1, 1, "Q. Did you?"), (1, 2, 2, "A. No"), (1, 3, 3, "x"), (1, 4, 4, ""), (1, 5, None, "7 of 9"), (2, 1, None, "1 text")], key=str)


def test_reranking_falls_back(spark):
    nan = float("nan")
    told = {"ok": [0.1, 0.9, 0.5], "same": [0.2, 0.2], "nan": [0.1, nan], "null": [0.4, None], "neg": [-1.0, -2.0], "low": [0.0001, 0.0002], "even": [5.0, 5.0001, 5.0002], "one": [3.0]}
    df = spark.createDataFrame([(q, i, i, s) for q, x in told.items() for i, s in enumerate(x)], "query string, id int, place int, score double")
    got = {}
    for r in c.reranked(df).orderBy("query", "rank").collect():
        got.setdefault(r["query"], (r["fault"], []))[1].append(r["id"])
    assert got == {"ok": (None, [1, 2, 0]), "same": ("identical", [0, 1]), "nan": ("nan", [0, 1]), "null": ("nan", [0, 1]), "neg": ("negative", [0, 1]), "low": ("low", [0, 1]), "even": ("even", [0, 1, 2]), "one": ("identical", [0])}


def test_tags_by_the_literals_type(spark):
    told = ['{"f": true, "n": 5, "s": "x", "d": "2024-01-05"}', '{"f": 1, "n": "5"}', '{"f": "M"}', '{"f": false, "n": null}', "{", None, "{}"]
    df = spark.createDataFrame(list(enumerate(told)), "i int, t string")
    ask = lambda *a: [r["i"] for r in df.where(c.tag_is(F.col("t"), *a)).orderBy("i").collect()]
    assert ask("f", "==", True) == [0, 1, 2] and ask("f", "==", False) == [3] and ask("f", "!=", True) == [3, 4, 5, 6]
    assert ask("n", ">=", 5) == [0, 1] and ask("n", "<", 5) == [] and ask("s", "==", "x") == [0] and ask("s", "<", 7) == []
    import datetime as dt

    assert ask("d", "<", dt.date(2024, 2, 1)) == [0] and ask("d", "!=", dt.date(2024, 1, 5)) == [1, 2, 3, 4, 5, 6]


def test_cursors_and_children(spark):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(10)], "a int, b int")
    first = c.after_cursor(df, None, "p", {"case": 1}, ["a", "b"], 4).collect()
    mark = c.cursor("p", {"case": 1}, list(first[-1]))
    rest = c.after_cursor(df, mark, "p", {"case": 1}, ["a", "b"], 500).collect()
    assert [tuple(r) for r in first + rest] == [(i // 3, i % 3) for i in range(10)]
    for bad in ((mark, "q", {"case": 1}), (mark, "p", {"case": 2}), ("zz", "p", {"case": 1})):
        with pytest.raises(ValueError):
            c.after_cursor(df, *bad, ["a", "b"], 4)
    kids = spark.createDataFrame([(1, None, 5), (2, 5, 9), (3, 3, 5), (4, None, None), (6, None, 6)], "id int, resolves int, motion int")
    assert rows(c.gathered(kids, "resolves", "motion", "id")) == [(5, [1, 2])]
