import random

import numpy as np

from briefmill.llm import toxicity as tox
from tests.conftest import SF


def test_gradients_are_those_of_finite_differences():
    words = tox._joined(["one two three four", "a bc def ghij klmnop " * 30])
    p = {k: x.astype(np.float64) for k, x in tox.new_parameters().items()}
    p["word"] += np.random.default_rng(1).normal(0, 0.3, p["word"].shape)
    start, end, _ = words.windows()
    assert len(start) == 4 and (end - start).max() == tox.WINDOW

    def total(q):
        return tox.forward(q, words, start, end, tox.projected(q, words)).sum()

    keep = {}
    tox.forward(p, words, start, end, tox.projected(p, words), keep)
    g = tox.gradients(p, words, keep, np.ones(len(start)))
    for k in p:
        at = (words.bucket[1], 2) if k == "word" else (words.tri[3], 1) if k == "char" else (0,) * p[k].ndim
        low, high = ({n: x.copy() for n, x in p.items()} for _ in range(2))
        low[k][at] -= 1e-3
        high[k][at] += 1e-3
        assert abs((total(high) - total(low)) / 2e-3 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_windows_overlap_and_cover_every_word():
    words = tox._joined(["w " * 500, "", "x"])
    start, end, doc = words.windows()
    seen = np.concatenate([np.arange(a, b) for a, b in zip(start, end)])
    assert set(seen) == set(range(501)) and set(doc) == {0, 2}
    assert all(start[i + 1] < end[i] for i in range(len(start) - 2))


def test_learns_planted_words_and_defines_edge_cases(spark):
    rng = random.Random(1)
    clean, bad = [f"w{i}" for i in range(80)], ["vile", "foul"]
    rows, labels = [], []
    for d in range(900):
        y = d % 4 == 0
        t = [rng.choice(clean) for _ in range(rng.randrange(5, 200))]
        if y:
            t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((d, " ".join(t), "s"))
        labels.append((d, int(y) if d % 7 else None))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "?? ! ", "s"), (None, "w1", "s"), (2003, "w1 " * 40000 + "vile w2", "s"), (2004, "vile", "s"), (2004, "vile", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = tox.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert by[2000]["score"] == by[2001]["score"] == by[2002]["score"] == 0
    assert by[2003]["predicted"] == by[2004]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert tox.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_query_covers_all_documents(spark):
    from briefmill.llm.queries import op8_toxicity

    out = op8_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_scores_are_those_of_a_slow_network():
    rng = np.random.default_rng(3)
    p = {k: rng.normal(0, 0.4, x.shape).astype(np.float32) for k, x in tox.new_parameters().items()}
    text = " ".join(f"word{i % 37}x" for i in range(150)) + " café a bb !! 12"
    words = tox._joined([text, "", "lone"])
    sig = lambda x: 1 / (1 + np.exp(-x))

    def slow(start, end):
        xs = []
        for i in words.ids[start:end]:
            tri = words.tri[words.tri_at[i] : words.tri_at[i] + words.tri_n[i]]
            xs.append(p["word"][words.bucket[i]] + sum(p["char"][t] for t in tri) / len(tri))
        states = []
        for way, seq in (("f", xs), ("b", xs[::-1])):
            h, out = np.zeros(tox.HIDDEN), []
            for x in seq:
                a, g = x @ p[f"W{way}"] + p[f"c{way}"], h @ p[f"U{way}"]
                z, r = sig(a[:8] + g[:8]), sig(a[8:16] + g[8:16])
                h = h + (1 - z) * (np.tanh(a[16:] + r * g[16:]) - h)
                out.append(h)
            states.append(out if way == "f" else out[::-1])
        hs = [np.r_[f, b] for f, b in zip(*states)]
        e = np.array([np.exp(np.tanh(h @ p["A"]) @ p["v"]) for h in hs])
        return sum(w * h for w, h in zip(e / e.sum(), hs)) @ p["w"] + p["b"][0]

    n = words.first[1]
    cuts = [(a, min(a + tox.WINDOW, n)) for a in range(0, n - tox.WINDOW + tox.STRIDE, tox.STRIDE)]
    best = tox._worst(p, words, 3)[0]
    assert abs(best[0] - max(slow(a, b) for a, b in cuts)) < 1e-3
    assert best[1] == -np.inf and abs(best[2] - slow(words.first[2], words.first[3])) < 1e-4


def test_a_long_text_is_hashed_in_parts(monkeypatch):
    from briefmill.llm import textvec

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.choice([1, 5, 9, 700]))) for _ in range(300)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = textvec.words(data, offsets)[0]
    monkeypatch.setattr(textvec, "CHUNK_BYTES", 256)
    assert (textvec.words(data, offsets)[0] == whole).all()
