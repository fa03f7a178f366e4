"""Chunkers against slow ones that see a whole page or text at once."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from briefmill.functions import chunking
from briefmill.operators import blocks as bl
from tests.conftest import SF


def slow_page(rows, prefix):
    """The page as runs of prose between headings, tables and figures, each run packed as a whole."""
    out, heading, run = [], "", []

    def put(kind, body, places):
        out.append((kind, heading or None, places[0], places[-1], prefix + (heading + "\n" if heading else "") + body))

    def flush():
        room = max(300, 1000 - len(prefix) - (len(heading) + 1 if heading else 0))
        pieces = [(p, k, piece) for p, k, t in run for piece in (list(bl.sentences(t, room)) if len(t) > room else [t])]
        while pieces:
            n = 1
            while n < len(pieces) and len("\n".join(x[2] for x in pieces[: n + 1])) <= room:
                n += 1
            put("footnote" if all(k == "footnote" for _, k, _ in pieces[:n]) else "paragraph", "\n".join(x[2] for x in pieces[:n]), [p for p, _, _ in pieces[:n]])
            pieces = pieces[n:]
        run.clear()

    for place, kind, text in sorted(rows):
        text = text.strip()
        if kind == "heading":
            flush()
            heading = bl.shortened(text, 192)
        elif kind == "table" and text:
            flush()
            lines = text.split("\n")
            while True:
                n = len(lines)
                while n > 2 and len(text) > 2048 and len("\n".join(lines[:n])) > 2048:
                    n -= 1
                put("table", "\n".join(lines[:n]), [place])
                lines = [lines[0], *lines[n:]]
                if len(lines) == 1:
                    break
        elif kind in ("paragraph", "footnote") and text:
            run.append((place, kind, text))
    flush()
    return out


def test_pages_as_the_slow_way(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) + rng.choice(["", "", ".", ";"])
    rows = []
    for page in range(25):
        for place in range(rng.randrange(1, 25)):
            kind = rng.choice(["heading", "paragraph", "paragraph", "footnote", "table", "page_number"])
            n = {"heading": rng.choice([3, 80]), "table": 3}.get(kind, rng.choice([5, 40, 400]))
            text = " ".join(word() for _ in range(n))
            rows.append((page, place, kind, "\n".join([text] * rng.choice([1, 5, 150])) if kind == "table" else text))
    df = spark.createDataFrame(rows, "page int, place int, kind string, text string")
    got = {}
    for r in bl.page_chunks(df, "[x]\n\n").orderBy("page", "part").collect():
        got.setdefault(r["page"], []).append((r["kind"], r["heading"], r["first_block"], r["last_block"], r["text"]))
    want = {p: slow_page([r[1:] for r in rows if r[0] == p], "[x]\n\n") for p in range(25)}
    fallback = {p for p, x in got.items() if x[0][0] == "page_fallback"}
    assert {p: x for p, x in got.items() if p not in fallback} == {p: x for p, x in want.items() if x}
    assert all(not want[p] for p in fallback)


def test_odd_blocks(spark):
    rows = [(1, 0, "page_header", "top"), (1, 1, "seal", "round"), (2, 0, "figure", "12 34 " * 20), (2, 1, "figure", "a picture of words and words, long enough"), (3, 0, "paragraph", None), (3, 1, "paragraph", "  "), (None, 0, "paragraph", "x"), (4, None, "paragraph", "no place"), (5, 0, "paragraph", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page int, place int, kind string, text string, part string")
    got = {}
    for r in bl.page_chunks(df).orderBy("page", "part").collect():
        got.setdefault(r["page"], []).append((r["kind"], r["text"]))
    assert got[1] == [("page_fallback", "top\nround")] and got[2] == [("figure", "Figure: a picture of words and words, long enough")]
    assert 3 not in got and None not in got and got[4] == [("paragraph", "no place")]
    assert " ".join(t for _, t in got[5]) == ("long " * 100_000).strip() or "".join(t for _, t in got[5]).replace(" ", "") == "long" * 100_000
    assert bl.page_chunks(df.limit(0)).count() == 0


@given(st.text(alphabet="Qa .\n;", max_size=300) | st.lists(st.sampled_from(["\nQ. yes", "\nA. no", "\n\nORDER", "words and ", "x" * 30, ". "]), max_size=20).map("".join), st.integers(5, 60))
@settings(max_examples=300, deadline=None)
def test_pieces_join_to_the_text(text, limit):
    pieces = chunking.before_separators(text, limit)
    assert "".join(pieces) == text and all(0 < len(p) <= limit for p in pieces)


def test_sections_keep_their_headings():
    text = "before\nI. FACTS\n" + "The court met. " * 100 + "\nCONCLUSIONS OF LAW\nshort\nPRAYER"
    got = chunking.by_sections(text, 400, "[c] ")
    assert got[0] == "[c] before" and got[-2:] == ["[c] CONCLUSIONS OF LAW\nshort", "[c] PRAYER"]
    facts = [g for g in got if g.startswith("[c] I. FACTS\n")]
    assert len(facts) == len(got) - 3 and "".join(g.removeprefix("[c] I. FACTS\n") for g in facts) == ("The court met. " * 100).strip()
    assert len(chunking.LEGAL_SEPARATORS) + 1 == 24  # the last is no separator: single characters


def test_queries(spark):
    from briefmill.plans import intake

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = {}
    for r in intake.section_chunks(spark, SF).collect():
        made.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"]))
    assert made.keys() == {d for d, t in docs.items() if t and t.strip()}
    for d, rows in made.items():
        assert [t for _, t in sorted(rows)] == chunking.by_sections(docs[d])
    blocks, got = {}, {}
    for r in intake._blocks(spark, SF).collect():
        blocks.setdefault(r["page"], []).append((r["place"], r["kind"], r["text"]))
    for r in intake.structured_chunks(spark, SF).orderBy("page", "part").collect():
        got.setdefault(r["page"], []).append((r["kind"], r["heading"], r["first_block"], r["last_block"], r["text"]))
    want = {p: slow_page(rows, "[Filing]\n\n") for p, rows in blocks.items()}
    assert {p: x for p, x in got.items() if x[0][0] != "page_fallback"} == {p: x for p, x in want.items() if x}
    assert re.search("Filing", next(iter(got.values()))[0][4])


@given(st.lists(st.sampled_from(["\n\n", "\n", ". ", "; ", ", ", " ", "word", "x" * 40]), max_size=40).map("".join), st.integers(3, 60))
@settings(max_examples=300, deadline=None)
def test_recursive_pieces_join_to_the_text(text, limit):
    pieces = chunking.recursive(text, limit)
    assert "".join(pieces) == text and all(0 < len(p) <= limit for p in pieces)


@given(st.lists(st.sampled_from(["a", "b.", "c!", "\n\n", " ", "d"]), max_size=60).map(" ".join), st.integers(4, 12), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_token_chunks_cover_all_words_with_their_overlap(text, size, overlap):
    words, at = text.split(), 0
    for n, chunk in enumerate(chunking.by_tokens(text, size, overlap)):
        got = chunk.split()
        back = max(k for k in range(min(overlap, at) + 1) if words[at - k : at - k + len(got)] == got and len(got) > k) if n else 0
        assert len(got) <= size and words[at - back : at - back + len(got)] == got
        at += len(got) - back
    assert at == len(words)


def test_plain_chunk_queries(spark):
    from briefmill.plans import analytics

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for query, split in ((analytics.chunk_recursive, chunking.recursive), (analytics.chunk_tokens, chunking.by_tokens)):
        made = {}
        for r in query(spark, SF).collect():
            made.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"]))
        assert {d: [t for _, t in sorted(x)] for d, x in made.items()} == {d: split(t) for d, t in docs.items() if t and split(t)}
