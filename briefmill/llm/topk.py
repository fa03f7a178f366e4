"""Exact top-k inner-product search with block-at-a-time pruning (operator 6).

Vectors are put in order of their ids and cut in blocks of ``BLOCK``, each with its forward index (the vectors) and the
maximum and minimum of every component; ``GROUP`` blocks make one row. Queries are cut in chunks the same way. A chunk
meets the groups of blocks slice by slice: for each query the blocks are ordered by the sum of its components' largest
products, and scored through their forward indexes until the bound falls below the k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.scratch import settle

BLOCK, GROUP = 64, 32
#: queries of a chunk: the more, the fewer times the vectors are shuffled, which is once for each chunk
CHUNK, MOST_CHUNK = 128, 4096
#: groups of blocks that one chunk of queries meets in one slice, carrying its thresholds from one to the next
SLICE = 64


def _packed(size: int):
    """Rows (part, ids, values) of up to ``size`` vectors in the order of their ids; ``part`` is numbered in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, values = [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, values
            out = pa.record_batch([pa.array([number]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(values).astype(np.int64).tobytes()], pa.binary())], names=["part", "ids", "vals"])
            number, ids, values = number + 1, [], []
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                values.append(v.values.to_numpy())
                if len(ids) == size:
                    yield flush()
        if ids:
            yield flush()

    return run


def search_group(q: np.ndarray, q_ids: np.ndarray, best: list[list[tuple[int, int]]], ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """Merges a group's vectors into each query's ``best`` [(-score, id)], pruned by its blocks' bounds; the number of blocks scored."""
    cuts = range(0, len(ids), BLOCK)
    high, low = np.stack([x[a : a + BLOCK].max(0) for a in cuts]), np.stack([x[a : a + BLOCK].min(0) for a in cuts])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    scored = 0
    for n in range(len(q)):
        mine = best[n]
        step, at = 1, 0
        while at < len(order[n]):
            # a bound equal to the k-th score may hide a tie with a smaller id
            floor = -mine[-1][0] if len(mine) == k else -np.inf
            take = order[n, at : at + step]
            take = take[bound[n, take] >= floor]
            if not len(take):
                break
            rows = np.concatenate([np.arange(b * BLOCK, min(len(ids), b * BLOCK + BLOCK)) for b in take])
            score = x[rows] @ q[n]
            keep = (score >= floor) & (ids[rows] != q_ids[n])
            top = sorted([*mine, *zip((-score[keep]).tolist(), ids[rows][keep].tolist(), strict=True)])[:k]
            mine[:] = top
            scored += len(take)
            at, step = at + step, step * 2
    return scored


def _search(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, q_ids, best = None, None, None, []

        def flush() -> pa.RecordBatch:
            rows = [(int(q_ids[n]), i, int(-s)) for n, b in enumerate(best) for s, i in b]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["chunk"], r["slice"])) != now:
                    if now is not None:
                        yield flush()
                    now, q_ids = key, np.frombuffer(r["q_ids"], np.int64)
                    q, best = np.frombuffer(r["q_vals"], np.int64).reshape(-1, dim), [[] for _ in q_ids]
                search_group(q, q_ids, best, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vals"], np.int64).reshape(-1, dim), k)
        if now is not None:
            yield flush()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest inner products of floor(scale * component): query_id, rank from 1, vec_id and score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of other ids (rows that repeat the
    query's id count as its own). Ties go to the smaller id; rows that repeat a candidate's id are candidates each.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Components
    that a vector lacks against the longest one count as 0. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(id_col).isNotNull()
    whole = settle(vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))
    sizes = whole.agg(F.max(F.size("v")).alias("n"), F.count("*").alias("count"), F.count_if(F.col("id") % every == 0).alias("asked")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sizes["asked"]:
        return empty
    dim, total = max(1, sizes["n"]), sizes["count"]
    whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    size = max(CHUNK, min(MOST_CHUNK, sizes["asked"] // 64))

    def packed(rows: DataFrame, size: int, n: int) -> DataFrame:
        parts = max(1, -(-n // (size * 16)))
        return settle(rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(_packed(size), "part long, ids binary, vals binary"))

    groups = packed(whole, BLOCK * GROUP, total)
    chunks = packed(whole.where(F.col("id") % every == 0), size, sizes["asked"])
    n_groups = groups.count()
    n_slices = -(-n_groups // SLICE)
    dealt = groups.select(F.pmod(F.xxhash64("part"), F.lit(n_slices)).alias("slice"), "part", "ids", "vals")
    asked = chunks.select(F.col("part").alias("chunk"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))).alias("slice"))
    n_chunks = chunks.count()
    met = asked.join(dealt, "slice").repartition(min(20_000, n_chunks * n_slices), "chunk", "slice").sortWithinPartitions("chunk", "slice", "part")
    found = met.mapInArrow(_search(k, dim), "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
