import hashlib

import numpy as np

from briefmill.llm import mixing

CELLS = [("a", "en", "x", 100), ("a", "de", "x", 50), ("b", "en", "y", 30), ("b", "de", "x", 20), (None, "en", "y", 5), ("c", "de", "y", 0)]
TARGETS = {"source": {"a": 0.5, "b": 0.4, None: 0.1}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.7, "y": 0.3}}


def test_raking_meets_every_marginal():
    w = mixing.rake(CELLS, TARGETS, 500) * np.array([c[3] for c in CELLS])
    for i, dim in enumerate(mixing.DIMENSIONS):
        for k, goal in TARGETS[dim].items():
            assert abs(sum(x for x, c in zip(w, CELLS) if c[i] == k) - goal) < 1e-3


def test_spark_path_equals_the_local_one(spark):
    df = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    got = {tuple(r)[:4]: r["factor"] for r in mixing.rake_in_spark(df, iterations=2).collect()}
    for c, f in zip(CELLS, mixing.rake(CELLS, mixing.tempered_targets(CELLS), 2)):
        assert abs(got[c] - f) < 1e-12


def test_scale_keeps_the_rate_where_cells_are_capped():
    t, f = np.array([10.0, 20, 70]), np.array([1.0, 0.1, 0.01])
    s = mixing.scale_for(t, f, 0.5)
    assert abs((t * np.minimum(1, s * f)).sum() - 50) < 1e-9


def test_draw_edge_cases(spark):
    rows = [(i, "one two", "a" if i % 3 else "b", "en", 1) for i in range(300)]
    rows += [(300, None, None, None, 1), (301, "", "a", "en", 1), (None, "x | y", "a", "en", 1), (5, "one two", "a", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    out = mixing.probabilities(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        u = int(hashlib.md5((str(r["doc_id"]) if r["doc_id"] is not None else "").encode()).hexdigest()[:13], 16) / 2**52
        assert r["kept"] == (u < r["probability"])
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    many = {r["doc_id"]: r["probability"] for r in mixing.probabilities(docs, local_cells=0).collect()}
    assert all(abs(many[r["doc_id"]] - r["probability"]) < 1e-6 for r in out)
    assert mixing.probabilities(docs.limit(0)).count() == 0
