import random

from briefmill.operators import relations as j


def distance(a, b):
    last = list(range(len(b) + 1))
    for x, c in enumerate(a, 1):
        now = [x]
        for y, d in enumerate(b, 1):
            now.append(min(last[y] + 1, now[-1] + 1, last[y - 1] + (c != d)))
        last = now
    return last[-1]


def brute(people, top):
    out = set()
    for i, name, email, bar in people:
        found = []
        for k, name2, email2, bar2 in people:
            scores = [1.0] * (bar is not None and bar == bar2) + [0.95] * (email is not None and email == email2)
            if None not in (name, name2):
                n = distance(name, name2)
                s, t = set(name.split(" ")), set(name2.split(" "))
                jac = len(s & t) / len(s | t)
                scores += [0.9 - n * 0.1] * (n <= 2) + [jac * 0.8] * (jac >= 0.5)
            if k != i and scores:
                found.append((-round(max(scores), 6), k))
        out |= {(i, k, -s, r) for r, (s, k) in enumerate(sorted(found)[:top], 1)}
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    for letters, most in (("ab", 6), ("aab c", 9), ("ab ", 40)):
        people = []
        for i in range(150):
            name = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(most))).split())
            people.append((i, rng.choice([name] * 9 + [None]), rng.choice([None] * 30 + ["e", "f"]), rng.choice([None] * 30 + ["1", "2"])))
        people += [(200 + i, " ".join(rng.sample("abcdefghijklmno", rng.randrange(5, 14))), None, None) for i in range(60)]
        df = spark.createDataFrame(people, "id int, name string, email string, bar string")
        for top in (1, 3):
            got = {(r["id"], r["other"], round(r["score"], 6), r["rank"]) for r in j.similar_names(df, top=top).collect()}
            assert got == brute(people, top)


def test_one_large_group_makes_few_pairs(spark):
    """40,000 people of one e-mail whose names begin alike: 1,600 million pairs, none of which is made."""
    people = spark.range(40_000).selectExpr("id", "concat('name ', lpad(id, 6, '0')) as name", "'one@x' as email")
    got = j.similar_names(people)
    assert got.where("rank = 3 and score = 0.95").count() == 40_000
    assert {tuple(r) for r in got.where("id = 39999").collect()} == {(39999, 0, 0.95, 1), (39999, 1, 0.95, 2), (39999, 2, 0.95, 3)}
