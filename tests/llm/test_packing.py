import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from briefmill.llm import packing


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_pieces_and_layout(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é漢\n'!s 12") for _ in range(rng.randrange(300))) for _ in range(120)]
    texts += [None, "", "word " * 9000, "x" * 30000, "a<|endoftext|>b", "it's  we'll \n\n x"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "n", 5), (3, texts[3], 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[i], key=lambda r: r["piece"])
        if i == 3:
            assert len(parts) == 2 and parts[0]["ids_crc32"] == parts[1]["ids_crc32"]
            continue
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for k, r in enumerate(parts):
            assert r["start"] == at and (r["length"] == 2048 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert check_layout(rows, 2048) >= packing.lower_bound(np.array([r["length"] for r in rows]), 2048)


def test_bounds_hold_and_are_reached_on_known_cases():
    for lengths, best in (([60] * 10, 10), ([50] * 10, 5), ([51, 49] * 7, 7), ([34] * 9, 5), ([100, 1], 2), ([], 0)):
        x = np.array(lengths, np.int64)
        bound = packing.lower_bound(x, 100)
        used = int(packing.best_fit_decreasing(x, 100)[0].max(initial=-1)) + 1
        assert bound <= best <= used
        assert used == best


def test_rounds_of_exchange_save_bins(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300)]), i) for i in range(6000)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(cut, per_task=200).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(rows)
    used = check_layout(out, 2048)
    whole = int(packing.best_fit_decreasing(np.array([r[3] for r in rows]), 2048)[0].max()) + 1
    apart = sum(int(packing.best_fit_decreasing(np.array([r[3] for r in rows[k::30]]), 2048)[0].max()) + 1 for k in range(30))
    assert whole <= used < apart


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_task_takes_all_where_every_bin_has_room(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randrange(700, 1000), i) for i in range(4000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), per_task=200).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(rows)
    assert check_layout(out, 2048) <= 2000 + 4000 // 200  # a task keeps one bin of one piece at most
    tasks = defaultdict(int)
    for r in out:
        tasks[r["sequence_id"] >> 32] += 1
    assert max(tasks.values()) < 2 * 200
