"""Line dedup against sets built by slicing, for lines whose shingles differ late, and its recall by set size."""

import random

from briefmill.llm.line_dedup import dedup_lines, shingles


def sliced(line):
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def kept(rows, percent=80):
    """The lines that stay, by line: the first of each component in the order of ``rows`` (id, line)."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [sliced(x) for _, x in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {d for i, (d, _) in enumerate(rows) if top(i) == i}


def check(spark, lines):
    rows = list(enumerate(lines))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["text"]} == kept(rows)
    assert all(r["text"] in ("", lines[r["doc_id"]]) for r in got)


def test_shingles_are_at_every_position(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab é語😀\t") for _ in range(n)) for n in (1, 8, 9, 10, 31, 32, 33, 39, 40, 41, 48, 64, 72, 73, 200, 1000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    from pyspark.sql import functions as F

    for r in df.withColumn("n", F.size(shingles(F.col("line")))).collect():
        assert r["n"] == len(sliced(r["line"]))


def test_lines_that_differ_after_nine_characters(spark):
    rng = random.Random(2)
    long_word = "".join(rng.choice("0123456789abcdef") for _ in range(300))
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    check(
        spark,
        ["https://example.com/a", "https://example.com/bcdefg", "同じ九文字で始まる一行目の文です", "同じ九文字で始まる別の話がここにある", "ภาษาไทยไม่มีช่องว่างหนึ่ง", "ภาษาไทยไม่มีที่เว้นวรรคเลย"]
        + ["order1234567890 id12345678901234 1111111111111", "order1234599999 id12345678988888 1111111112222"]
        + [long_word, long_word[:9] + long_word[40:][::-1], long_word[:-3] + "xyz", cjk, cjk[:9] + cjk[::-1], cjk[:-1] + "終"]
        + ["short", "shorts", "ninechars", "ninechars", "tencharsss"],
    )


def test_recall_at_the_threshold_does_not_fall_with_the_size(spark):
    rng = random.Random(4)
    for size in (5, 10, 20, 50):
        common, rows = size * 4 // 5, []
        for i in range(600):
            line = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(size + 8))
            assert 100 * len(sliced(line[: common + 8]) & sliced(line)) == 80 * len(sliced(line))
            rows += [(2 * i, line[: common + 8]), (2 * i + 1, line)]
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1 and text = ''").count()
        print(size, got / 600)
        assert got >= 0.974 * 600, (size, got)
