import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefmill.llm import byte_bpe as bb
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def slow_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_hash_is_perfect_and_minimal():
    rng = random.Random(0)
    for n in (1, 2, 3, 7, 500):
        keys = list({rng.randbytes(rng.randrange(1, 9)) for _ in range(n)})
        h = bb.PerfectHash(keys)
        assert h.slots(bb.hashes_of(keys)).tolist() == [h.at.tolist().index(i) for i in range(len(keys))] and sorted(h.at) == list(range(len(keys)))
    vocab = bb.vocabulary(PATH)
    assert vocab.whole(list(vocab.place)).tolist() == list(vocab.place.values())
    assert vocab.whole([b"qqqqzzzz", b"", b"\xff\xfe\xfd\xfc"]).tolist() == [-1, -1, -1] and not len(vocab.whole([]))


@given(st.binary(min_size=1, max_size=40) | st.text(alphabet="aabbe \n", min_size=1, max_size=40).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_heap_merges_as_the_slow_way(piece):
    vocab = bb.vocabulary(PATH)
    assert list(vocab.merged([piece, b"x", piece])) == [slow_merges(p, vocab.place) for p in (piece, b"x", piece)]


@given(st.text(alphabet="aé1 '\n!rels漢 \t", max_size=80), st.integers(3, 12))
@settings(max_examples=400, deadline=None)
def test_windows_split_as_the_whole_text(text, window):
    assert [p for part in bb.pre_tokens(text, PATTERN, window) for p in part] == PATTERN.findall(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_as_the_library(library, text):
    encoder = bb.Encoder(bb.vocabulary(PATH), public_tokenizers.PATTERN)
    ids, starts = encoder.encode([text, "", text])
    want = library.encode_ordinary(text)
    assert ids.tolist() == want * 2 and starts.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_documents_and_edge_cases(spark, library):
    rows = [(1, "The cat's  sat, naïve 漢字 😀\n\n x", 0), (2, None, 0), (3, "", 0), (4, " \n\t ", 0), (5, "word " * 200_000, 0), (6, "z" * 30_000, 0), (1, "The cat", 0), (None, "<|endoftext|>", 0)]
    rows.append((7, " " * 600_000 + "'re", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("id", F.lit("x")).withColumn("bytes", F.lit("x"))
    got = bb.decode(bb.encode(docs)).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((str(d), tuple(library.encode_ordinary(t or ""))) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), bytes(r["bytes"]).decode()) for r in got) == sorted((str(d), t or "") for d, t, _ in rows)
    assert bb.decode(bb.encode(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [255, 0])], "doc_id long, ids array<int>")
    table = bb.vocabulary(PATH)
    by_rank = {r: k for k, r in table.place.items()}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bb.decode(odd).collect()} == {1: b"", 2: b"", 3: by_rank[255] + by_rank[0]}


def test_query(spark, library):
    from briefmill.llm.queries import QUERIES

    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF).collect()} == want


def test_small_generations_give_the_same(library, monkeypatch):
    monkeypatch.setattr(bb, "MERGED", 3)
    encoder, rng = bb.Encoder(bb.vocabulary(PATH), public_tokenizers.PATTERN), random.Random(5)
    for _ in range(30):
        text = " ".join("".join(rng.choices("aeklmz", k=9)) for _ in range(4)) + " repeatedqz wordqz" + "k" * 70
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
