import random

from briefmill.llm.clusters import components
from briefmill.llm.near_dup import near_duplicates


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {(i, len(sets[i]), top(i), top(i) == i) for i in ids}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (1, 2, 3, 12, 40, 90):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(7):
                t = list(base)
                for _ in range(rng.randrange(4)):
                    t[rng.randrange(size)] = rng.choice(words)
                rows.append((n, rng.choice([" ", "\n", "\t ", "  "]).join(t)))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "A B c"), (n + 4, "a b C"), (n + 5, "x y " * 30000), (n + 6, "x  y " * 30000), (n + 7, "É b c"), (n + 8, "é b c")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, id int")
    for width, percent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in near_duplicates(df, width=width, percent=percent).collect()}
        assert got == brute(rows, width, percent)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
