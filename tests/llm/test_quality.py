import random

from briefmill.llm.quality import quality
from tests.conftest import SF


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(1200):
        good = d % 3 != 0
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 80))]
        rows.append((d, " ".join(words) if good else " | ".join(words), "x"))
        labels.append((d, int(good) if d % 5 else None))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "w1 w2", "x"), (5002, "w1 " * 60000, "x"), (5003, "w1 | w2", "x"), (5003, "w1 | w2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    got = quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1200]
    assert sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_query_covers_all_documents(spark):
    from briefmill.llm.queries import op4_quality

    out = op4_quality(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
