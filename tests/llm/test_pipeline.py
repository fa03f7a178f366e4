"""Each stage of the pipeline on odd rows, and all of them on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, key string, id int"


def odd_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(900)}"
    long = "\n".join(" ".join(word() for _ in range(30)) for _ in range(400))
    base = " ".join(word() for _ in range(80))
    near = base.rsplit(" ", 1)[0] + " other"
    texts = [None, "", "  \n ", "one", long, base, near, base, "a line\nlonger line number two here", "a line\nanother line that is new to us"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s", len(base)), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    return [(*r, "c", "k", 7) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(odd_rows(), SCHEMA)
    rows = stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
        return
    assert stage(spark, docs, SF).columns == docs.columns
    ids = [r["doc_id"] for r in rows]
    if name == "toxicity":
        assert len(rows) == docs.count()
    if name == "line dedup":  # 7 repeats 5, 6 nearly; both lose their only line; rows without text stay
        assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 4, 5, 8, 9, 5, None, None], key=str)
        by = {r["doc_id"]: r["text"] for r in rows}
        assert by[9] == "another line that is new to us" and by[2] == "  \n " and by[0] is None
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
    if name == "near-dedup":
        assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 4, 5, 8, 9, 5, None, None], key=str)
    if name == "mixing":
        assert {0, 1, 2} & set(ids) == set() and set(ids) <= {r["doc_id"] for r in docs.collect()}


def test_near_dedup_catches_what_line_dedup_cannot_see(spark):
    """The same words, dealt over other lines: no line is near another, and the documents are copies."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(240)]
    cut = lambda n: "\n".join(" ".join(words[i : i + n]) for i in range(0, 240, n))
    docs = spark.createDataFrame([(1, cut(8)), (2, cut(20)), (3, cut(240)), (4, " ".join(reversed(words)))], "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    after = corpus_pipeline.line_dedup(spark, docs, SF)
    assert after.count() == 4
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, after, SF).collect()} == {1, 4}


def test_run_packs_each_kept_document_once(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and {r["doc_id"] for r in rows} <= known
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in places.values():
        of.sort()
        assert of[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(of, of[1:])) and sum(of[-1]) <= 2048
    assert all(r["length"] > 1 for r in rows)


def test_columns_of_the_stages_own_names(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(3) for c in ("n_lines", "N_KEPT", "_id", "_d", "_T", "_gone", "_lines", "_hash")})
    for name in ("line dedup", "near-dedup"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert out.columns == docs.columns and {r["n_lines"] + r["_id"] + r["_gone"] for r in out.collect()} == {9}
