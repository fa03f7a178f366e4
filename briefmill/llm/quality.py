"""Quality classifier (operator 4): random-indexing word vectors, pooled per document, and a two-layer numpy network.

A token's row (its hash modulo ``ROWS``) gathers the sparse index vectors of its neighbours over all documents; each task
sums its own and Spark adds the tasks' sums. A document's features are the mean and the spread of its tokens' vectors.
The network is fitted in one task on at most ``max_train`` labelled documents' features; a temperature calibrates it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm import textvec
from briefmill.llm.scratch import settle

ROWS, DIM, NONZERO, REACH, HIDDEN = 1 << 13, 32, 4, 2, 24
_rng = np.random.default_rng(11)
#: each row's index vector: places and signs of its entries
_PLACES = np.stack([_rng.permutation(DIM)[:NONZERO] for _ in range(ROWS)]).astype(np.int64)
_SIGNS = _rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def _rows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' rows and each text's first token; case counts."""
    h, first, _, _ = textvec.tokens(data, offsets, lower=False)
    return (h % np.uint64(ROWS)).astype(np.int64), first


def gather(total: np.ndarray, row: np.ndarray, first: np.ndarray) -> None:
    """Adds to ``total`` (ROWS x DIM) the index vectors of each token's neighbours up to ``REACH`` away in its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, REACH + 1):
        near = doc[step:] == doc[:-step]
        a, b = row[:-step][near], row[step:][near]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(x * DIM + _PLACES[y, k], weights=_SIGNS[y, k], minlength=ROWS * DIM).reshape(ROWS, DIM)


def _gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((ROWS, DIM))
    for batch in batches:
        for _, _, data, offsets in textvec.byte_chunks(batch.column(0)):
            gather(total, *_rows_of(data, offsets))
    used = np.flatnonzero(total.any(1))
    yield pa.record_batch([pa.array(used), *[pa.array(total[used, k].astype(np.int64)) for k in range(DIM)]], names=["row", *[f"x{k}" for k in range(DIM)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rows' vectors over all documents, of length one (zero where a row has no neighbours): ROWS * DIM numbers at any size."""
    part = docs.select(text_col).mapInArrow(_gathering, "row long, " + ", ".join(f"x{k} long" for k in range(DIM)))
    total = np.zeros((ROWS, DIM), np.float32)
    for r in part.groupBy("row").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(DIM)]).collect():
        total[r[0]] = r[1:]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def pooled(vectors: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's vectors; zeros for a text without tokens."""
    out = np.zeros((len(first) - 1, 2 * DIM), np.float32)
    n = np.diff(first)
    for d in np.flatnonzero(n):
        v = vectors[row[first[d] : first[d + 1]]]
        out[d, :DIM], out[d, DIM:] = v.mean(0), v.std(0)
    return out


def features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textvec.byte_chunks(batch.column(1)):
                x = pooled(shared.value, *_rows_of(data, offsets))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.ListArray.from_arrays(np.arange(0, x.size + 1, 2 * DIM, dtype=np.int32), x.ravel())], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<float>")


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> dict[str, np.ndarray]:
    """The network's parameters; every fifth row sets the temperature only."""
    r = np.random.default_rng(seed)
    p = {"mean": x.mean(0) if len(x) else np.zeros(2 * DIM), "scale": x.std(0) + 1e-6 if len(x) else np.ones(2 * DIM)}
    p |= {"A": r.normal(0, 0.2, (2 * DIM, HIDDEN)), "a": np.zeros(HIDDEN), "w": r.normal(0, 0.2, HIDDEN), "b": np.zeros(1), "t": np.ones(1)}
    val = np.arange(len(x)) % 5 == 4
    tx, ty = (x[~val] - p["mean"]) / p["scale"], y[~val].astype(float)
    if not 0 < ty.sum() < len(ty):
        return p
    names = ("A", "a", "w", "b")
    m1, m2 = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(tx))
        for i in range(0, len(order), 128):
            k = order[i : i + 128]
            h = np.tanh(tx[k] @ p["A"] + p["a"])
            d = (1 / (1 + np.exp(-(h @ p["w"] + p["b"]))) - ty[k]) / len(k)
            dh = d[:, None] * p["w"] * (1 - h * h)
            g = {"A": tx[k].T @ dh + 1e-4 * p["A"], "a": dh.sum(0), "w": h.T @ d + 1e-4 * p["w"], "b": d.sum(keepdims=True)}
            t += 1
            for n in names:
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.999 * m2[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - 0.005 * 0.5 ** (epoch / 20) * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8)
    z, vy = logits(p, x[val]), y[val]
    grid = np.geomspace(0.2, 10, 60)
    loss = [np.logaddexp(0, np.where(vy > 0, -z, z) / s).mean() for s in grid]
    p["t"] = np.array([grid[int(np.argmin(loss))]]) if len(z) else p["t"]
    return p


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - p["mean"]) / p["scale"] @ p["A"] + p["a"]) @ p["w"] + p["b"]) / p["t"]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` from 0 to 1 (higher: good) and ``predicted`` (score >= 0.5).

    Labels are read only of rows that are not held out, and at most ``max_train`` of those, chosen by a hash of their
    ids; the word vectors are made of all documents. Null and empty texts have the features zero and a score like any
    other. Without labels of both classes the scores are defined, but carry no information. Other columns are ignored.
    """
    made = settle(features(docs, word_vectors(docs, text_col), id_col, text_col))
    out_of = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & ~out_of)
    sample = known.join(made, "id").select(F.xxhash64("id").alias("o"), "id", "y", "x").orderBy("o", "id").limit(max_train)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["o"], r["id"], r["x"], r["y"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        model = fit(np.array([r[2] for r in rows], np.float32).reshape(-1, 2 * DIM), np.array([r[3] for r in rows]))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample.coalesce(1).mapInArrow(train, "model binary").first()
    model = pickle.loads(bytes(got["model"])) if got else fit(np.zeros((0, 2 * DIM)), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, 2 * DIM)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-logits(shared.value, x))), pa.float64())], names=["id", "score"])

    scored = made.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), out_of.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
