import hashlib

from briefmill.sources import files


def test_walk_by_pattern_and_depth(spark, tmp_path):
    for name, data in (("a.pdf", b"one"), ("x/b.pdf", b"two"), ("x/y/z/c d.pdf", b"one"), ("x/n.txt", b"no"), ("x/empty.pdf", b"")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {("a.pdf", "a.pdf", 3, sha(b"one")), ("x/b.pdf", "b.pdf", 3, sha(b"two")), ("x/y/z/c d.pdf", "c d.pdf", 3, sha(b"one"))}
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {(r["path"], r["name"], r["size"], r["sha256"]) for r in files.walk(spark, root).collect()}
        assert got == want
    assert {r["path"] for r in files.walk(spark, str(tmp_path), depth=1).collect()} == {"a.pdf", "x/b.pdf"}
    assert files.walk(spark, str(tmp_path), "*.docx").count() == 0


def test_ensured_adds_what_is_missing_once(spark):
    known = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, id int")
    wanted = spark.createDataFrame([("/b", "B"), ("/c", "d"), ("/c", "C"), (None, "n")], "path string, name string")
    assert sorted((tuple(r) for r in files.ensured(known, wanted, "path").collect()), key=str) == [("/a", 1, None), ("/b", 2, None), ("/c", None, "C")]
