import random

from briefmill.operators import retrieval as r


def test_short_quotes_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(40)] + [(40, None)]
    quotes = [(i, " ".join(word() for _ in range(rng.randrange(1, 5)))) for i in range(60)] + [(60, ""), (61, None), (62, "a"), (62, "b")]
    want = {(d, q) for d, t in docs for q, x in quotes if t and x and x in t}
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")
    for short, chars in ((1_000, 16_000_000), (3, 5)):
        monkeypatch.setattr(r, "SHORT", short)
        monkeypatch.setattr(r, "SHORT_CHARS", chars)
        assert {tuple(x) for x in r.holds_quote(a, b).collect()} == want


def test_prototypes_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.randrange(4) / 2 for _ in range(3)]
    points, shelf = [(i, vec()) for i in range(50)], [(f"l{i:02}", vec()) for i in range(30)]
    a, b = spark.createDataFrame(points, "id int, v array<double>"), spark.createDataFrame(shelf, "label string, v array<double>")
    whole = {tuple(x) for x in r.nearest_label(a, b, "id", "v", "label").collect()}
    monkeypatch.setattr(r, "SHELF", 4)
    assert {tuple(x) for x in r.nearest_label(a, b, "id", "v", "label").collect()} == whole and len(whole) == 50
