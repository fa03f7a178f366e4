import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefmill.llm import fill_middle as fm
from tests.conftest import SF

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in fm.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(units), "spm" if spm else "psm", len(pre), len(mid), out


@given(st.text(alphabet="aZ é漢😀.\n<P>SM", max_size=60), st.integers(1, 5), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_each_cut_through_sparse_checkpoints(text, every, block):
    units, raw = UNIT.findall(text), text.encode()
    index = fm.Checkpoints(raw, every, block)
    assert (index.n, index.chars) == (len(units), len(text)) and len(index.units) <= 1 + 1 + len(units) // every
    for u in range(len(units) + 1):
        head = "".join(units[:u])
        assert index.cut(u) == (len(head.encode()), len(head))


def test_rows_and_edge_cases(spark):
    rows = [(i, f"Words and números {i}, 漢字 <b> again.\nEnd{i}", "x") for i in range(60)]
    rows += [(101, None, "x"), (102, "", "x"), (103, "a <P> b", "x"), (104, "<M", "x"), (105, "<S", "x"), (106, "x" * 400_000, "x"), (107, "é " * 300_000, "x")]
    rows += [(None, "no id here", None), (None, None, None), (5, rows[5][1], "x"), (5, "another text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumn("form", F.lit(1)).withColumn("output", F.lit("o"))
    out = fm.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(d, t) for d, t, _ in rows), key=repr)
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == sorted((str(d), t or "") for d, t, _ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


def test_parameters_and_query(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "k long, t string")
    got = fm.fill_in_middle(docs, "k", "t", percent=100, spm_percent=100, sentinels=("[pre]", "[suf]", "[mid]"))
    rows = got.withColumn("back", fm.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("[suf]") and r["back"] == f"some text {r['k']}" for r in rows)
    from briefmill.llm.queries import QUERIES

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        *row, out = brute(r["doc_id"], r["text"])
        want[r["doc_id"]] = (*row, sha(out), sha(r["text"] or ""))
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op11_fill_middle"](spark, SF).collect()} == want
