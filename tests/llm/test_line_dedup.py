import random
import re

from briefmill.llm.line_dedup import dedup_lines


def brute(rows, percent):
    where = {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        for n, raw in enumerate(text.split("\n") if text is not None else []):
            if line := raw.strip(" "):
                where.setdefault(line, (d, n))
    sets = {x: set(re.findall(r"(?s)(?=(.{1,9}))\S+\s*", x)) for x in where}
    up = {x: x for x in where}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                up[top(a)] = top(b)
    best = {}
    for x, at in where.items():
        best[top(x)] = min(best.get(top(x), at), at)
    out = {}
    for d, text in rows:
        out[d] = None if text is None else "\n".join(raw for n, raw in enumerate(text.split("\n")) if not sets.get(raw.strip(" ")) or best[top(raw.strip(" "))] == (d, n))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "be", "gammaé", "d", "epsilon", "zz", "eta-1", "theta", "i", "kappa"] + [f"w{i}x" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 60]))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            w = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(rng.choice(["", " "]) + " ".join(w))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "   ", "\t"]))
        rows.append((d, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, ("long line " * 5000) + "\n" + "x" * 50000), (64, ("long line " * 5000) + "end\n" + "x" * 50000)]
    df = spark.createDataFrame([(d, t, "k", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, line string, n int")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == brute(rows, 80)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (None, "c\nq"), (2, "q\nq")], "doc_id long, text string")
    got = sorted((tuple(r) for r in dedup_lines(df, counts=("n_lines", "n_kept")).collect()), key=str)
    assert got == sorted([(1, "a b\nc", 2, 2), (1, "a b\nc", 2, 2), (None, "", 2, 0), (2, "q", 2, 1)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0
