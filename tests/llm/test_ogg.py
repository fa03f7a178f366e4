import hashlib
import random
import zlib

import pytest

from briefmill.llm import ogg


def slow_crc(data):
    x = 0
    for b in data:
        x ^= b << 24
        for _ in range(8):
            x = ((x << 1) ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
    return x


def test_checksum_is_that_of_the_bitwise_definition():
    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 8192, 65025, 65280, 200_000])
def test_round_trip(n):
    text = "é" * (n // 2) + "x" * (n % 2)
    payload, size = ogg.padded(text)
    media = ogg.write(payload, size)
    back, length, told = ogg.read(media)
    assert back == payload and length == n and len(payload) % 64 == 0 and payload
    assert told["streams"] == 2 and told["seconds"] == len(payload) / 8000


def test_damage_is_found():
    payload, n = ogg.padded("some text " * 3000)
    media = ogg.write(payload, n)
    r = random.Random(1)
    for _ in range(60):
        k = r.randrange(len(media))
        bad = media[:k] + bytes([media[k] ^ (1 << r.randrange(8))]) + media[k + 1 :]
        with pytest.raises(ogg.Corrupt):
            ogg.read(bad)
    with pytest.raises(ogg.Corrupt):
        ogg.read(media[: len(media) // 2])


def test_query_on_a_small_table(spark, tmp_path):
    from briefmill.llm.queries import op7_ogg

    texts = ["abc", "", None, "é" * 40000, "abc"]
    spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op7_ogg(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] > r["payload_bytes"]
    assert tuple(rows[0])[1:] == tuple(rows[4])[1:] and tuple(rows[1])[1:] == tuple(rows[2])[1:]


def test_null_media(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"OggS"))], "doc_id long, media binary")
    assert all(r["payload"] is None and r["error"] for r in ogg.examine(df).collect())
    assert ogg.examine(ogg.store(df.select("doc_id").limit(0).selectExpr("doc_id", "'' as text"))).count() == 0


def test_times_follow_from_granules(spark):
    payload = bytes(range(256)) * 600
    streams = ogg.demultiplex(ogg.write(payload, 1))
    for k, serial in enumerate(ogg.SERIALS):
        times = ogg.timed(streams[serial]["packets"][1:], serial)
        assert [(a, b) for a, b, _, _ in times] == [(s, min(len(payload), s + 4096)) for s in range(4096 * k, len(payload), 8192)]
    # a stream of another writer: several packets end on a page, which names the last one's end alone
    assert [(a, b) for a, b, _, _ in ogg.timed([[b"x" * 10, -1], [b"y" * 20, 30], [b"z" * 5, 35]], 1)] == [(0, 10), (10, 30), (30, 35)]
    told = ogg.read(ogg.write(payload, 1))[2]
    assert told["seconds"] == len(payload) / ogg.RATE and [t[1] for t in told["times"]] == sorted(t[1] for t in told["times"])
    docs = spark.createDataFrame([(1, "a"), (1, "b" * 70), (None, None), (2, "")], "doc_id long, text string")
    rows = ogg.examine(ogg.store(docs), times=True).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], len(r["times"])) for r in rows) == [("1", 1, 1), ("1", 70, 1), ("2", 0, 1), ("None", 0, 1)]
