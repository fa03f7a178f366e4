import datetime as dt
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from briefmill.operators import dates, tables
from briefmill.plans import intake
from tests.conftest import SF

DAY = dt.date(2026, 3, 11)  # a Wednesday


def grid_of(spark, text):
    rows = tables.cells(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("table_no", "row_no", "col_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r["table_no"], {}).setdefault(r["row_no"], []).append(r["cell"])
    return [list(t.values()) for t in out.values()]


def test_spans_become_rectangles(spark):
    html = "<p>x</p><TABLE class=a><tr><th rowspan=2>A<th colspan='2'>B &amp; C</tr><tr><td>b\n c</td><td><table><tr><td>in</table></td></tr><tr><td colspan=9999>w</table>"
    outer, inner = grid_of(spark, html)
    assert [r[:3] for r in outer] == [["A", "B & C", "B & C"], ["A", "b c", ""], ["w", "w", "w"]] and {len(r) for r in outer} == {1000}
    assert inner == [["in"]]
    assert grid_of(spark, "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<td>e") == [[["a", "b", ""], ["a", "c", ""], ["a", "d", "e"]]]
    assert grid_of(spark, "noise <fcel>Amount<lcel><fcel>Date<nl><fcel>$1<ecel><fcel>x<nl>") == [[["Amount", "Amount", "Date"], ["$1", "", "x"]]]
    assert grid_of(spark, "t\n| a | b |\n|---|:--|\n| 1 | 2 | 3 |\nend | x") == [[["a", "b", ""], ["1", "2", "3"]]]
    assert grid_of(spark, "one | two | three") == [] and grid_of(spark, "<fcel>a<fcel>b<nl>") == []


def test_forms_and_edge_cases(spark):
    rows = [(1, "<fcel>A|B<lcel><fcel>C<nl><ecel><fcel>2<fcel>3<nl>", "x"), (2, " plain ", "x"), (3, None, "x"), (4, "", "x"), (None, "a|b|c\nd|e|f", "x"), (4, "", "x"), (5, "<table><tr>" + "<td>q" * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell string")
    got = {r["doc_id"]: tuple(r)[1:] for r in tables.normalised(docs).collect()}
    assert got[1] == ("otsl", 2, "A|B | C\n2 | 3", "| A\\|B |  | C |\n| --- | --- | --- |\n|  | 2 | 3 |")
    assert got[2] == ("text", 0, "plain", None) and got[3] == got[4] == ("text", 0, "", None) and got[None][:3] == ("markdown", 2, "a | b | c\nd | e | f")
    assert tables.cells(docs.where("doc_id = 5")).count() == 30_000 and tables.cells(docs.where("doc_id = 4")).count() == 0
    assert tables.cells(docs.limit(0)).count() == 0


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3)), max_size=4), max_size=5))
@settings(max_examples=300, deadline=None)
def test_grid_is_a_rectangle_with_each_cell_once(shape):
    rows = [[(f"{y}.{x}", wide, tall, False) for x, (wide, tall) in enumerate(row)] for y, row in enumerate(shape)]
    got = tables.grid(rows)
    assert len(got) == len(rows) and len({len(line) for line in got}) <= 1
    own = [c for line in got for c, _, own in line if own and c]
    assert sorted(own) == sorted(c[0] for row in rows for c in row)


def told(text):
    return [(text[a:b], rule, str(x), str(y)) for a, b, rule, x, y in dates.spans(text, DAY)]


def test_dates():
    assert told("Filed 2024-02-29, seen 3/4/99 and 12/31/2001; heard Sept. 5, 2020 or may 7") == [
        ("2024-02-29", "iso", "2024-02-29", "2024-02-29"), ("3/4/99", "us", "1999-03-04", "1999-03-04"), ("12/31/2001", "us", "2001-12-31", "2001-12-31"),
        ("Sept. 5, 2020", "words", "2020-09-05", "2020-09-05"), ("may 7", "words", "2026-05-07", "2026-05-07")]
    assert told("today, Yesterday, tomorrow, last week, this  week") == [("today", "today", "2026-03-11", "2026-03-11"), ("Yesterday", "yesterday", "2026-03-10", "2026-03-10"), ("tomorrow", "tomorrow", "2026-03-12", "2026-03-12"), ("last week", "week", "2026-03-02", "2026-03-08"), ("this  week", "week", "2026-03-09", "2026-03-15")]
    assert told("between March 1 and 2026-03-05, by") == [("between March 1 and 2026-03-05", "between", "2026-03-01", "2026-03-05")]
    assert told("since 1/2/2020 filed before June 3 2021.") == [("since 1/2/2020", "after", "2020-01-02", "9999-12-31"), ("before June 3 2021", "before", "0001-01-01", "2021-06-03")]
    assert told("2023-02-29 13/45/2020 Smarch 5 before noon") == []


@given(st.text(alphabet="before 1/23-April May,.;between and today", max_size=60) | st.lists(st.sampled_from(["between ", "after ", "2024-01-05", " and ", "3/4/2020", "May 5, 2021", ", ", " today ", "before "]), max_size=9).map("".join))
@settings(max_examples=400, deadline=None)
def test_spans_as_with_a_mask(text):
    """The slow way: a mask of taken characters, rule by rule."""
    mask, want = [False] * len(text), []
    for rule, pattern in dates.RULES:
        for m in re.finditer(pattern, text, re.I | re.A):
            meant = dates._meaning(rule, m, DAY)
            if meant and not any(mask[m.start() : m.end()]):
                mask[m.start() : m.end()] = [True] * (m.end() - m.start())
                want.append((*m.span(), rule, *meant))
    assert dates.spans(text, DAY) == sorted(want)


def test_rows_of_dates(spark):
    docs = spark.createDataFrame([(1, "a 2024-01-05 b", 1), (1, "a 2024-01-05 b", 1), (2, None, 1), (3, "", 1), (4, "no dates in here", 1), (None, "today", 1), (5, "x " * 200_000 + "1/2/2020", 1)], "doc_id long, text string, start int")
    got = sorted((str(r["doc_id"]), r["start"], str(r["first_day"])) for r in dates.mentions(docs, "2026-03-11").collect())
    assert got == [("1", 2, "2024-01-05"), ("1", 2, "2024-01-05"), ("5", 400_000, "2020-01-02"), ("None", 0, "2026-03-11")]
    assert dates.mentions(docs.limit(0), "2026-03-11").count() == 0


def test_plain_html_needs_no_parser_and_tells_the_same(monkeypatch):
    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", '<td rowspan="2">', "<TD colspan=3 rowspan=0>", "<p>", "a", " b\n", "&amp;", "&lt", "x > y", "&#233;", "</p>", "<br>", '<td colspan="2"rowspan=2>', "<td class=x>", "<!-- < -->", "<script><td></script>", "< td>", "</td rowspan=2>"]
    texts = ["<table>" + "".join(rng.choices(bits[: rng.choice([17, 24])], k=rng.randrange(20))) for _ in range(3000)]
    plain = [tables.tables_of(t)[1] for t in texts]
    monkeypatch.setattr(tables, "_PLAIN", re.compile("(x^)()()"))
    assert [tables.tables_of(t)[1] for t in texts] == plain


def test_plain_html_is_not_parsed(monkeypatch):
    monkeypatch.setattr(tables._Html, "feed", lambda *_: 1 / 0)
    assert tables.tables_of("<p>x<table><tr><th rowspan=2>a &amp; b</tr></table>") == ("html", [[[("a & b", 1, 2, True)]]])


def test_few_bytes_are_dealt_to_all_cores(spark):
    for query in (intake.date_mentions, intake.filing_types, intake.html_tables):
        assert "REPARTITION_BY_NUM" in query(spark, SF)._jdf.queryExecution().executedPlan().toString()
