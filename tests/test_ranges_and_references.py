import random

from briefmill.operators import relations as j


def test_first_range_of_nested_tied_and_open_ranges(spark):
    rng = random.Random(8)
    for low, width, n in ((0, 1, 3), (-7, 40, 60), (1000, 5000, 200)):
        scope = lambda: rng.choice(["a", "b", None])
        points = [(i, scope(), rng.choice([None, low + rng.randrange(width)])) for i in range(n)]
        starts = [rng.choice([None, low - 5 + rng.randrange(width + 9)]) for _ in range(n)]
        ranges = [(scope(), s, rng.choice([None, (s or 0) + rng.randrange(-2, width)]), rng.randrange(n // 2), i) for i, s in enumerate(starts)]
        want = {}
        for key, sc, at in points:
            held = [(place, label) for s, a, b, place, label in ranges if None not in (sc, at, a) and s == sc and a <= at and (b is None or at <= b)]
            want[key] = min(held)[1] if held else None
        got = j.first_range(spark.createDataFrame(points, "key int, scope string, at int"), spark.createDataFrame(ranges, "scope string, start int, stop int, place int, label int"))
        assert {r["key"]: r["label"] for r in got.collect()} == want


def test_many_ranges_over_one_point_make_few_rows(spark):
    ranges = spark.range(50_000).selectExpr("'s' as scope", "cast(0 as int) as start", "cast(1000 as int) as stop", "cast(id as int) as place", "id as label")
    points = spark.range(1001).selectExpr("id as key", "'s' as scope", "cast(id as int) as at")
    assert j.first_range(points, ranges).where("label = 0").count() == 1001
    assert j.first_range(points.limit(0), ranges).count() == 0 and j.first_range(points, ranges.limit(0)).where("label is null").count() == 1001


def test_references(spark):
    rows = [
        ("case", 1, "number", "D-1-FM-25-0002", 1, 0.95, 0.8, 0.7), ("case", 1, "name", "Smith v. Jones", 2, 0.9, 0.7, 0.6), ("case", 2, "name", "Smithson", 2, 0.9, 0.7, 0.6),
        ("person", 7, "name", "smith", 2, 0.9, 0.7, 0.6), ("person", 8, "name", None, 2, 0.9, 0.7, 0.6), ("person", 9, "bar", "  Smith ", 1, 0.95, 0.7, 0.6), ("person", 9, "name", "x smith", 2, 0.9, 0.7, 0.6),
    ]
    fields = spark.createDataFrame(rows, "kind string, id int, field string, value string, priority int, exact double, prefix double, substring double")
    asked = spark.createDataFrame([("SMITH ",), ("SMITH ",), ("ones",), ("v",), ("d-",), ("smithx",), ("",), (None,), ("x s",)], "text string")
    got = {}
    for r in j.resolve(asked, fields, limit=3).orderBy("text", "rank").collect():
        got.setdefault(r["text"], []).append((r["kind"], r["id"], r["matched_on"], r["confidence"], r["ambiguous"]))
    assert got == {
        "SMITH ": [("person", 9, "bar", 0.95, True), ("person", 7, "name", 0.9, True), ("case", 1, "name", 0.7, True)],
        "ones": [("case", 1, "name", 0.6, False)], "v": [("case", 1, "name", 0.6, False)], "d-": [("case", 1, "number", 0.8, False)], "x s": [("person", 9, "name", 0.7, False)],
    }
    assert j.resolve(asked, fields, limit=1).where("text = 'SMITH '").first()["ambiguous"]
    assert j.resolve(asked.limit(0), fields).count() == 0 and j.resolve(asked, fields.limit(0)).count() == 0


def test_exploded_cells_and_parts_are_not_broadcast(spark, tmp_path):
    """A small file of points or values makes many rows, which must not pass through the driver."""
    o = spark.range(1000).selectExpr("id as key", "id % 50 as scope", "cast(id as int) as at", "concat('value ', id) as value")
    o.write.parquet(str(tmp_path / "o"))
    o = spark.read.parquet(str(tmp_path / "o"))
    ranges = o.selectExpr("scope", "at as start", "at + 9 as stop", "key as place", "key as label")
    fields = o.selectExpr("'k' as kind", "key as id", "'value' as field", "1 as priority", "value", "0.9 as exact", "0.8 as prefix", "0.7 as substring")
    for got in (j.first_range(o.select("key", "scope", "at"), ranges), j.resolve(o.selectExpr("cast(key as string) as text"), fields)):
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert not any(f"BroadcastHashJoin [{key}" in plan for key in ("scope", "part")) and plan.count("SortMergeJoin [") >= 1


def test_references_by_parts_of_each_size(spark):
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "xabcdefghij", "\u00e9\U0001f600z", "bcdxbcde"]
    fields = spark.createDataFrame([("k", i, "f", w, 1, 0.9, 0.8, 0.7) for i, w in enumerate(words)], "kind string, id int, field string, value string, priority int, exact double, prefix double, substring double")
    texts = {w[a:b] for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)} | {"bcdef bc", "cba"}
    got = j.resolve(spark.createDataFrame([(t,) for t in texts], "text string"), fields, limit=20)
    assert {(r["text"], r["id"]) for r in got.collect()} == {(t, i) for t in texts for i, w in enumerate(words) if t in w}
