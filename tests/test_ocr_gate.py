import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefmill.operators import ocr_gate as gate


def slow_cuts(text):
    """Line by line and window by window, as the rules are told."""
    out = []
    windows = [text[i : i + 24] for i in range(0, len(text) - 23, 24)]
    if len(windows) >= 16:
        for w in range(1, len(windows) - 7):
            if all(x in windows[:i] for i, x in enumerate(windows[w : w + 8], w)):
                end = w * 24
                space = max((i for i in range(end + 1) if text[i : i + 1] in " \n" and text[i : i + 1]), default=-1)
                out.append(space if space > 0 and space > end - 96 else end)
                break
    lines = text.split("\n")
    if len(lines) > 1:
        keys = [re.sub(r"\s+", " ", re.sub("[0-9]+", "#", x.strip().lower())) for x in lines]
        new = [bool(k) and k not in keys[:i] for i, k in enumerate(keys)]
        for i in range(len(lines)):
            if len(lines) - i < 8:
                break
            if sum(new[i:]) / (len(lines) - i) < 0.1:
                if i:
                    out.append(len("\n".join(lines[:i])))
                break
        if any(new):
            cut = max(i for i, x in enumerate(new) if x)
            while cut >= 0 and keys[cut] and keys.count(keys[cut]) >= 3:
                cut -= 1
            if cut >= 0:
                out.append(len("\n".join(lines[: cut + 1])))
    return sorted({len(text[:n].rstrip()) for n in out if n})


piece = st.sampled_from(["the cat sat ", "Page 1 of 2\n", "Page 7 of 9\n", "x", "\n", "a longer line of other words\n", "é漢 ", "0123456789abcdef01234567", "new%d words " % 5])


@given(st.lists(st.tuples(piece, st.integers(1, 25)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_cuts_as_the_slow_way(parts):
    text = "".join(p * n for p, n in parts).strip()
    assert gate.cuts_of(text) == slow_cuts(text)


PROSE = " ".join(f"The witness number {chr(97 + i % 26)}{chr(97 + i // 3 % 26)} said that it happened on another day." for i in range(12))


def assess(spark, texts, task="ocr"):
    words = spark.createDataFrame([("the",), ("of",), ("said",), ("witness",)], "word string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, reasons string")
    return {r["doc_id"]: (r["reasons"], r["salvaged_chars"]) for r in gate.assess(docs, words, task=task).collect()}


def test_reasons(spark):
    loop, many = PROSE + "\n" + "and so on and so on\n" * 60, "\n".join(["same line"] * 40)
    texts = [None, "", "  \n", PROSE, loop, many, "第 1 条 漢字", r"\frac{1}{2} and \sqrt{3}", "ab" * 20 + " word " + "cd" * 20, "zqblk mrvbl ktzzz bcdfg hjklm npqrs tvwxz qqqqq zzkkk wwrrr ttbbb vvnnn", "Page 1 of 2 " * 30, "cost $1 | Page 1 of 2 " * 3, "https://example.com/" + "a" * 60]
    got = assess(spark, texts)
    assert got[4][0] == ["repetition-loop"] and len(PROSE) - 100 < got[4][1] <= len(PROSE)
    assert got[5] == (["repetition-loop"], None) and got[10] == (["repetition-loop"], None)
    assert [got[i][0] for i in (0, 1, 2, 3, 11, 12)] == [[]] * 6
    assert (got[6][0], got[7][0], got[8][0], got[9][0]) == (["unexpected-script"], ["latex-hallucination"], ["run-together-text"], ["letter-soup"])


def test_other_tasks(spark):
    rows = "<tr>" + "<td>1</td>" * 4 + "</tr>"
    got = assess(spark, [f"<table>{rows * 40}</table>", f"<table>{rows}", "<table><tr><td>a</td></tr></table>", "<fcel>a<fcel>b<nl><fcel>c<ecel><nl>", "<fcel>a<fcel>b<nl><fcel>c<ecel><nl><fc", "a|b|c\nd|e|f", "prose"], "table")
    assert [got[i][0] for i in range(7)] == [[], ["table-truncated"], ["table-empty"], [], ["table-truncated"], [], ["table-empty"]]
    assert assess(spark, ["SEAL " * 100], "seal")[0] == ([], None)


def test_empty_and_repeated(spark):
    words = spark.createDataFrame([], "word string")
    docs = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, None)], "doc_id int, text string")
    assert gate.assess(docs, words).count() == 3 and gate.assess(docs.limit(0), words).count() == 0


def test_a_texts_words_are_split_once_for_a_test(spark):
    df = spark.createDataFrame([("x y",)], "t string")
    plan = df.select(gate._unpronounceable(F.col("t")).alias("u"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
