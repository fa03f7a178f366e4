"""Moves and claims: replays of small stories, and a brute-force walk through random ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from briefmill.streaming import moves

T = dt.datetime(2026, 1, 1)
SCHEMA = "hash string, path string, kind string, ts timestamp, seq long"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", moves.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(*told):
    return [(h, p, k, T + dt.timedelta(minutes=m), i) for i, (h, p, k, m) in enumerate(told)]


def walk(rows):
    """The rules, one event at a time, without timers."""
    out, record, live = [], {}, {}
    for h, p, k, ts, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        here = live.setdefault(h, set())
        if k == "gone":
            here.discard(p)
        elif k == "add":
            here.add(p)
            if h not in record:
                record[h] = [p, "DISCOVERED", False]
                out.append((h, ts, p, None, "DISCOVERED", "new"))
            elif record[h][0] != p and record[h][0] not in here:
                if record[h][1] == "ERROR":
                    record[h][1] = "QUEUED" if record[h][2] else "DISCOVERED"
                out.append((h, ts, p, record[h][0], record[h][1], "moved"))
                record[h][0] = p
        elif h in record and k == "error":
            record[h][1] = "ERROR"
        elif h in record and k == "filed":
            record[h][2] = True
    return out


def test_static_rows_as_walked(spark):
    rng = random.Random(6)
    rows = events(*[(rng.choice("abc"), rng.choice(["/1", "/2", "/3"]), rng.choice(["add", "add", "gone", "gone", "error", "filed"]), i) for i in range(120)])
    got = moves.tracked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted(walk(rows), key=lambda r: (r[0], r[1]))
    assert moves.tracked(spark.createDataFrame([(None, "/x", "add", T, 0), ("h", None, "add", T, 1)], SCHEMA)).count() == 0


def stream(spark, batches, tmp_path, name):
    path = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "0 seconds")
    q = moves.tracked(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(((r["hash"], r["path"], r["old_path"], r["status"], r["why"]) for r in spark.table(name).collect()), key=str)


def test_a_copy_that_came_first_hands_over(spark, tmp_path):
    """A copy is seen first, the real file is skipped as its duplicate, then the copy goes: a rename and a late survivor."""
    batches = [
        events(("h", "/a (1).pdf", "add", 0), ("h", "/a.pdf", "add", 1), ("k", "/old", "add", 1)),
        events(("h", "/a (1).pdf", "gone", 2), ("k", "/old", "gone", 2), ("k", "/old", "error", 2), ("k", "/old", "filed", 2)),
        events(("k", "/new", "add", 3), ("z", "/z", "add", 3)),
        events(("z", "/z", "add", 60)),
        events(("z", "/z", "add", 90)),
    ]
    got = stream(spark, batches, tmp_path, "handover")
    assert got == [("h", "/a (1).pdf", None, "DISCOVERED", "new"), ("h", "/a.pdf", "/a (1).pdf", "DISCOVERED", "moved"), ("k", "/new", "/old", "QUEUED", "moved"), ("k", "/old", None, "DISCOVERED", "new"), ("z", "/z", None, "DISCOVERED", "new")]


def test_claims_go_to_the_first_once(spark):
    at = lambda m: T + dt.timedelta(minutes=m)
    known = spark.createDataFrame([(1, "QUEUED", None, None), (2, "RUNNING", "w9", at(5)), (3, "RUNNING", "w9", at(50)), (4, "DONE", "w1", at(1))], "id long, status string, owner string, until timestamp")
    asks = spark.createDataFrame([(1, "w2", at(10)), (1, "w1", at(10)), (1, "w3", at(11)), (2, "w2", at(10)), (3, "w2", at(10)), (4, "w2", at(10)), (5, "w2", at(10)), (None, "w", at(1))], "id long, worker string, at timestamp")
    once = moves.claim(asks, known)
    assert sorted(tuple(r) for r in once.collect()) == [(1, "RUNNING", "w1", at(20)), (2, "RUNNING", "w2", at(20)), (3, "RUNNING", "w9", at(50)), (4, "DONE", "w1", at(1))]
    again = moves.claim(asks, once)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in once.collect())
    assert once.where(F.col("owner") == "w1").count() == 2


def test_query_of_moves_as_walked(spark):
    from briefmill.plans import intake
    from tests.conftest import SF

    rows = [tuple(r) for r in intake._file_events(spark, SF).collect()]
    got = sorted(tuple(r) for r in intake.file_moves(spark, SF).collect())
    assert got == sorted(walk(rows), key=lambda r: (r[0], r[1])) and {r[5] for r in got} == {"new", "moved"}
