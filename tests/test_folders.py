"""Folder batches: restarts, replays, drops of subtrees, and acknowledgement behind the store."""

import json

import pytest

from briefmill.streaming import folders


def leave(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(dict(zip(("link", "seq", "op", "path", "payload"), r))) for r in rows))


def now(spark, store):
    return sorted((r["path"], r["payload"]) for r in folders.current(folders.stored(spark, store)).collect())


def run(spark, tmp_path):
    folders.take_in(folders.batches(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "mark")).awaitTermination(120)


def test_restart_takes_nothing_twice(spark, tmp_path):
    store = str(tmp_path / "store")
    leave(tmp_path / "in", "1.json", [("a", 1, "put", "/x/1", "one"), ("a", 2, "put", "/x/y/2", "two"), ("a", 3, "put", "/xy", "three"), ("b", 1, "put", "/x/1", "b"), (None, 1, "put", "/n", "n"), ("a", None, "put", "/n", "n")])
    run(spark, tmp_path)
    assert now(spark, store) == [("/x/1", "b"), ("/x/1", "one"), ("/x/y/2", "two"), ("/xy", "three")]
    leave(tmp_path / "in", "2.json", [("a", 4, "drop", "/x/", None), ("a", 5, "put", "/x/1", "again"), ("a", 6, "put", "/xy", "new")])
    run(spark, tmp_path)
    assert now(spark, store) == [("/x/1", "again"), ("/x/1", "b"), ("/xy", "new")]
    n = spark.read.parquet(f"{store}/changes").count()
    run(spark, tmp_path)
    assert spark.read.parquet(f"{store}/changes").count() == n == 7
    assert sorted(tuple(r) for r in folders.acknowledged(spark, store).collect()) == [("a", 6), ("b", 1)]


def test_batch_that_failed_behind_the_store_counts_once(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    leave(tmp_path / "in", "1.json", [("a", 1, "put", "/1", "one"), ("a", 2, "drop", "/none", None)])
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped between")))
    with pytest.raises(Exception):
        run(spark, tmp_path)
    monkeypatch.undo()
    assert spark.read.parquet(f"{store}/changes").count() == 2 and not (tmp_path / "store" / "acks").exists()
    run(spark, tmp_path)
    assert spark.read.parquet(f"{store}/changes").count() == 4 and folders.stored(spark, store).count() == 2
    assert now(spark, store) == [("/1", "one")] and [tuple(r) for r in folders.acknowledged(spark, store).collect()] == [("a", 2)]


def test_query(spark):
    from briefmill.plans import intake
    from tests.conftest import SF

    want, dropped = {}, {}
    rows = sorted((tuple(r) for r in intake._folder_changes(spark, SF).collect()), key=lambda r: (r[0], r[1]))
    for link, seq, op, path, payload in rows:
        if op == "put":
            want[link, path] = (payload, seq)
        else:
            dropped[link, path] = seq
            want = {k: v for k, v in want.items() if k[0] != link or not (k[1] == path or k[1].startswith(path + "/"))}
    assert dropped and sorted(tuple(r) for r in intake.folder_state(spark, SF).collect()) == sorted((p, v[0], k, v[1]) for (k, p), v in want.items())
