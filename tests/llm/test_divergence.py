import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefmill.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        df[lang or ""].update(set(terms))
        count[lang or "", source or ""].update(terms)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        all_of = Counter()
        for s in sources:
            all_of.update(count[lang, s])
        p = {}
        for s, c in [*((s, count[lang, s]) for s in sources), (None, all_of)]:
            total = sum(c[t] for t in kept) + 5 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - p[None][t], t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, stop in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found[:stop], 1)]
    return sorted(out)


def test_long_division_is_exact():
    rng = random.Random(1)
    cases = [(rng.randrange(10 ** rng.randrange(1, 15)), rng.randrange(1, 10 ** rng.randrange(1, 16))) for _ in range(500)]
    got = dv.share(np.array([c for c, _ in cases]), np.array([t + c + 5 for c, t in cases]))
    assert got.tolist() == [1 + 10**9 * (c + 5) // (t + c + 5) for c, t in cases]


@pytest.mark.parametrize("chunk_rows,cells", [(20_000, 1 << 21), (40, 12)])
def test_rows_and_edge_cases(spark, monkeypatch, chunk_rows, cells):
    monkeypatch.setattr(dv, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(dv, "CELLS", cells)
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "été", "漢字", "😀", "Ünï", "AB"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", None, "B"])) for _ in range(200)]
    rows += [(None, "en", "empty"), ("", "xx", "p"), ("12 34", "xx", "q"), (None, "yy", None), ("rare words only", "zz", "a"), ("same same", "en", "a"), ("same same", "en", "a")]
    rows += [("wa " * 100_000 + "q" * 100_000, "en", "long")]
    docs = spark.createDataFrame([(i, *r, "x", "y", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, item string, chunk string, n int")
    got = dv.divergence(docs, least=5, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 7)
    assert dv.divergence(docs.limit(0)).count() == 0


def test_ties_follow_utf8(spark):
    rows = [("aa bb ﬀ 😀 é", "en", "one"), ("zz", "en", "two"), ("zz", "en", "three")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r) for r in dv.divergence(docs, least=1).where(F.col("part") == "term").orderBy("source", "rank").collect()]
    assert [r[3] for r in got if r[1] == "one"] == ["aa", "bb", "é", "ﬀ", "😀"] and len({r[4] for r in got if r[1] == "one"}) == 1
