"""Changes of stored tables, and stream plans against the same rows read at once."""

from pyspark.sql import functions as F

from briefmill.sources import stored
from briefmill.streaming import intake
from tests.conftest import SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_append_delete_and_stamp(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc int, page int, text string")
    stored.append(first, path, "doc")
    stored.append(spark.createDataFrame([(3, 0, "d", 0.5)], "doc int, page int, text string, score double"), path, "doc")
    now = stored.read_evolving(spark, path).select("doc", "page", "text", "score")
    assert rows(now) == [(1, 0, "a", None), (1, 1, "b", None), (2, 0, "c", None), (3, 0, "d", 0.5)]
    stored.delete(spark, path, "doc", spark.createDataFrame([(1, 1), (2, 0), (9, 9)], "doc int, page int"), ["page"])
    now = stored.read_evolving(spark, path).select("doc", "page", "text", "score")
    assert rows(now) == [(1, 0, "a", None), (3, 0, "d", 0.5)]
    told = stored.stamped(now, spark.createDataFrame([(1, None, 0.9, "ok"), (7, "x", 0.1, "no")], "doc int, text string, score double, state string"), "doc")
    assert told.columns == ["doc", "page", "text", "score", "state"]
    assert rows(told) == [(1, 0, "a", 0.9, "ok"), (3, 0, "d", 0.5, None)]


def test_delete_whatever_the_partition_is_called(spark, tmp_path):
    path, schema = str(tmp_path / "odd"), "part string, page int, text string"
    data = [("a:b", 1, "x"), ("c d", 1, "x"), ("x", 1, "x"), ("x", 2, "y"), (None, 1, "x"), (None, 2, "y"), ("q%2F/=#é", 1, "x"), ("x", 2, "y"), ("stays", 1, None), ("x", None, "n")]
    stored.append(spark.createDataFrame(data, schema), path, "part")
    stored.delete(spark, path, "part", spark.createDataFrame([("a:b", 1), ("c d", 1), ("x", 1), (None, 1), ("q%2F/=#é", 1), ("x", None), ("none", 1)], "part string, page int"), ["page"])
    assert rows(stored.read_evolving(spark, path).select("part", "page", "text")) == sorted([("x", 2, "y"), ("x", 2, "y"), (None, 2, "y"), ("stays", 1, None), ("x", None, "n")], key=str)
    stored.delete(spark, path, "part", spark.createDataFrame([(None, 2)], "part string, page int"), ["page"])
    assert rows(stored.read_evolving(spark, path).select("part", "page")) == sorted([("x", 2), ("x", 2), ("stays", 1), ("x", None)], key=str)


def run(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, parts, path):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_new_files_once_and_not_from_the_dead(spark, tmp_path):
    schema = "path string, hash string"
    parts = [spark.createDataFrame(x, schema) for x in ([("/a", "h1"), ("/b", "h2")], [("/a2", "h1"), ("/c", "h3"), ("/d", "h4")], [("/e", "h5")])]
    dead = spark.createDataFrame([("/c", None), (None, "h5")], schema)
    got = run(spark, intake.new_files(stream(spark, parts, str(tmp_path / "in")), dead), "append", "intake", tmp_path)
    assert rows(got.select("hash", "status")) == [("h1", "DISCOVERED"), ("h2", "DISCOVERED"), ("h4", "DISCOVERED")]


def test_latest_status_and_confirmed_survive_replays(spark, tmp_path):
    schema = "id long, link string, seq long, status string"
    a = [(1, "x", 1, "new"), (2, "x", 2, "new"), (1, "x", 5, "done")]
    parts = [spark.createDataFrame(x, schema) for x in (a, [(1, "x", 3, "busy"), (2, "y", 4, "busy")], a)]
    got = run(spark, intake.latest_status(stream(spark, parts, str(tmp_path / "in"))), "complete", "latest", tmp_path)
    assert rows(got) == [(1, 5, "done"), (2, 4, "busy")]
    got = run(spark, intake.confirmed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "complete", "confirmed", tmp_path)
    assert rows(got) == [("x", 5), ("y", 4)]


def test_event_rates_are_those_of_a_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts").orderBy("ts")
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    got = run(spark, intake.event_rates(spark.readStream.schema(events.schema).parquet(path)), "append", "rates", tmp_path)
    last = events.agg(F.max("ts")).first()[0]
    whole = intake.event_rates(events).where(F.col("start") + F.expr("interval 10 seconds") <= F.lit(last) - F.expr("interval 1 minute"))
    assert rows(got) == rows(whole) and got.count() > 100


def test_promotion_is_guarded_and_replayable(spark):
    known = spark.createDataFrame([(1, "DISCOVERED"), (2, "INDEXED"), (3, "PARSED")], "id long, status string")
    batch = spark.createDataFrame([(1, "PARSED"), (2, "PARSED"), (3, "INDEXED"), (4, "PARSED")], "id long, want string")
    rules = {"PARSED": "DISCOVERED", "INDEXED": "PARSED"}
    once = intake.promote(batch, known, rules)
    assert rows(once) == [(1, "PARSED"), (2, "INDEXED"), (3, "INDEXED")] == rows(intake.promote(batch, once, rules))
