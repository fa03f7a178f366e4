"""Sets of all sizes in one hot bucket: no link may be lost, whatever the bucket's size."""

import random

import pytest
from pyspark.sql import functions as F

from briefmill.llm import clusters
from briefmill.llm.near_dup import near_duplicates
from briefmill.llm.scratch import settle
from tests.llm.test_near_dup import brute


def joined(sets, percent):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("rounds", [0, 2])
def test_links_of_one_hot_bucket(spark, percent, rounds):
    rng = random.Random(percent)
    passage, sets = [rng.getrandbits(63) for _ in range(12)], {}
    for size in (5, 7, 10, 14, 20, 40, 290):
        for _ in range(12 if size < 100 else 3):
            union = [rng.getrandbits(63) for _ in range(size)] + (passage if rng.random() < 0.5 else [])
            for gone in (0, len(union) * (100 - percent) // 100, len(union) * (100 - percent) // 100 + 1):
                sets[len(sets)] = set(union[gone:])
    family = [rng.getrandbits(63) for _ in range(60)]
    for _ in range(80):  # copies that differ near the threshold
        sets[len(sets)] = {x for x in family if rng.random() > 0.08} | {rng.getrandbits(63) for _ in range(4)}
    items = settle(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<long>"))
    buckets = settle(items.select(F.lit(1).cast("long").alias("key"), "id"))
    got = clusters.link(buckets, lambda pairs: clusters.similar(pairs, items, percent), lambda some: items.join(some, "id", "left_semi"), percent, rounds)
    label = {i: i for i in sets} | {r["id"]: r["component"] for r in got.collect()}
    assert label == joined(sets, percent)


def test_repeated_ids_null_ids_and_ties(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(words[::-1])
    rows = [(7, a), (7, a), (3, b), (5, c), (7, c), (9, "other words entirely here"), (None, a), (None, None), (11, ""), (11, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()), key=str)
    # 7 has two texts, which join the components of both
    want = [(7, 38, 3, False), (7, 38, 3, False), (3, 38, 3, True), (5, 38, 3, False), (7, 38, 3, False), (9, 2, 9, True), (None, 38, None, True), (None, 0, None, True), (11, 0, 11, True), (11, 0, 11, True)]
    assert got == sorted(want, key=str)


def test_a_group_of_many_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(200)}" for _ in range(60)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(60)] = f"w{rng.randrange(200)}"
        rows.append((i, " ".join(t)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)
