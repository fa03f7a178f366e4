"""What a family of sets that are nearly similar enough costs: few pairs may be asked for, and no link may be lost."""

import random

from pyspark.sql import functions as F

from briefmill.llm import clusters
from briefmill.llm.scratch import settle
from tests.llm.test_near_dup_small import joined


def test_a_family_below_the_threshold_makes_few_pairs(spark):
    rng = random.Random(12)
    base, sets = [rng.getrandbits(63) for _ in range(400)], {}
    for i in range(120):  # two of these have a similarity of about 0.68
        sets[i] = set(rng.sample(base, 360)) | {rng.getrandbits(63) for _ in range(40)}
    for i in range(0, 120, 10):  # and some have a link, by which they meet more than one item before the last of their rare ones
        sets[200 + i] = set(list(sets[i])[:-15]) | {rng.getrandbits(63) for _ in range(15)}
    items = settle(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<long>"))
    buckets = settle(items.select(F.lit(1).cast("long").alias("key"), "id"))
    asked = []

    def confirm(pairs):
        pairs = settle(pairs)
        asked.append(pairs.count())
        return clusters.similar(pairs, items, 80)

    got = clusters.link(buckets, confirm, lambda some: items.join(some, "id", "left_semi"), 80)
    assert {i: i for i in sets} | {r["id"]: r["component"] for r in got.collect()} == joined(sets, 80)
    assert sum(asked) < 3 * len(sets), asked


def test_small_keys_meet_once_and_their_sketches_come_first(spark):
    rng = random.Random(13)
    sets, rows = {}, []
    for key in range(30):  # families of which two neighbours are linked or nearly so, in small keys and in one larger
        base = [rng.getrandbits(63) for _ in range(200)]
        for m in range(20 if key == 0 else 5):
            i = len(sets)
            sets[i] = set(base[: 200 - 8 * (m % 4)]) | {rng.getrandbits(63) for _ in range(16 * (m % 2))}
            sets[i] = sets[i] if m < 4 else {rng.getrandbits(63) for _ in range(60)} | set(base[:140])
            rows += [(key, i), (100 + key, i)]
    n = {k: sum(key == k for key, _ in rows) for k, _ in rows}
    items = settle(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<long>"))
    buckets = settle(spark.createDataFrame([(k, i, n[k]) for k, i in rows], "key long, id long, n long"))
    asked = []

    def confirm(pairs):
        pairs = settle(pairs)
        asked.append(pairs.collect())
        return clusters.similar(pairs, items, 80)

    got = clusters.link(buckets, confirm, lambda some: items.join(some, "id", "left_semi"), 80, at_once=12)
    assert {i: i for i in sets} | {r["id"]: r["component"] for r in got.collect()} == joined(sets, 80)
    # no pair of the small keys is asked for again, and none whose sets are far from a link
    assert not [r for pairs in asked[1:] for r in pairs if r["a"] >= 20]
    assert not [r for pairs in asked for r in pairs if 100 * len(sets[r["a"]] & sets[r["b"]]) < 60 * len(sets[r["a"]] | sets[r["b"]])]


def test_labels_and_sketches_are_joined_once_an_id_and_only_changed_components_are_united(spark, monkeypatch):
    rng = random.Random(14)
    base, sets = [rng.getrandbits(63) for _ in range(200)], {}
    for i in range(24):  # a large key: neighbours are linked, all others nearly so
        sets[i] = set(base[8 * i :] + base[: 8 * i - 30 if 8 * i > 30 else 0]) | {rng.getrandbits(63) for _ in range(10)}
    for i in range(100, 140):  # small keys, linked in the first round
        sets[i] = set(sets[i - 1]) ^ {rng.getrandbits(63)} if i % 2 else {rng.getrandbits(63) for _ in range(40)}
    items = settle(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<long>"))
    rows = [(1, i, 24) for i in range(24)] + [(i // 2, i, 2) for i in range(100, 140)]
    buckets = settle(spark.createDataFrame(rows, "key long, id long, n long"))
    keyed = clusters.finer_keys(settle(items.where("id < 24").select("id")), lambda some: items.join(some, "id", "left_semi"), 80)
    assert keyed.count() == 24  # not one row an item
    united, real = [], clusters.components
    monkeypatch.setattr(clusters, "components", lambda edges: (united.append(edges.count()), real(edges))[1])
    got = clusters.link(buckets, lambda pairs: clusters.similar(pairs, items, 80), lambda some: items.join(some, "id", "left_semi"), 80, at_once=12)
    assert {i: i for i in sets} | {r["id"]: r["component"] for r in got.collect()} == joined(sets, 80)
    assert united[0] >= 20 and all(n < 24 * 23 // 2 for n in united[1:]), united
    assert got.count() == got.select("id").distinct().count()
