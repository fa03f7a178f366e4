import math
import random

import numpy as np

from briefmill.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.random() - 0.5]) for _ in range(6)]) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(0, 300, 7)]
    rows += [(4000, None), (4050, [1.0, None] + [0.0] * 4), (4100, [float("nan")] + [0.0] * 5), (4150, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (4200, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r[0], r[1]) for r in df.collect()]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows, 5, 50)


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 0")).count() == 0


def test_bounds_prune_blocks():
    x = np.concatenate([np.full((topk.BLOCK, 4), 100), np.zeros((topk.BLOCK * 20, 4), int)]).astype(np.int64)
    best = [[]]
    scored = topk.search_group(np.ones((1, 4), np.int64), np.array([-1]), best, np.arange(len(x)), x, 5)
    assert scored == 1 and best[0] == [(-400, i) for i in range(5)]


def test_ragged_vectors_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.random() - 0.5 for _ in range(rng.randrange(1, 9))]) for i in range(900)] + [(50, [0.5, 0.5]), (7, [0.25] * 9), (7, [0.25] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in ok:
        if q % 50 == 0 and q != 50:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for chunk in (128, 3):
        monkeypatch.setattr(topk, "CHUNK", chunk)
        monkeypatch.setattr(topk, "MOST_CHUNK", chunk)
        assert sorted(tuple(r) for r in topk.top_k(df).collect() if r[0] != 50) == sorted(want)
