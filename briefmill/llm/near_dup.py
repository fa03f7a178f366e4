"""MinHash near-dedup with b-bit signatures (operator 10).

Each document's set of word shingles gets 128 minima. Their low bits, two of each, are packed in bit planes; bands of
six minima make the candidates; the bit counts of the planes estimate the similarity, corrected for chance collisions;
and what the estimate does not rule out is confirmed on the full sets. Documents with equal sets are one class from the
start, found by a grouping with partial aggregation, so a set that a third of all rows share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm import clusters, textvec
from briefmill.llm.scratch import broadcast_if_small, discard, settle

MINIMA, BAND_ROWS, BITS = 128, 6, 2
#: pairs with a smaller set are confirmed without an estimate
SMALL = 300
_rng = np.random.default_rng(20240607)
_MASKS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, text after text, and where each text's begin (one entry more at the end).

    A text of fewer words than ``width`` has its whole sequence as one shingle; a text without words has none.
    """
    h, first = textvec.words(data, offsets)
    n_docs, n = len(offsets) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        whole = textvec.mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(whole)])
    inside = doc[: len(whole)] == doc[width - 1 :] if len(whole) else np.zeros(0, bool)
    owner, value = doc[: len(whole)][inside], whole[inside]
    for d in np.flatnonzero((n > 0) & (n < width)):
        x = np.full(1, n[d], np.uint64)
        for w in h[first[d] : first[d + 1], None]:
            x = textvec.mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + w)
        owner, value = np.append(owner, d), np.append(value, x[0])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n_docs + 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_SIGNATURE = "id long, n_shingles long, node long, planes array<long>, bands array<long>"


def _nodes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one; equal sets are one node."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(full):
        at = first[:-1][full]
        sums = [np.add.reduceat(textvec.mix(value ^ np.uint64(salt)), at) for salt in (0x243F6A8885A308D3, 0xA5A5A5A55A5A5A5A)]
        out[full] = textvec.mix(textvec.mix(sums[0]) * np.uint64(0xC2B2AE3D27D4EB4F) + sums[1] + n[full].astype(np.uint64))
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textvec.byte_chunks(batch.column(1)):
                value, first = shingle_sets(data, offsets, width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                planes = np.zeros((hi - lo, MINIMA // 64 * BITS), np.uint64)
                bands = np.zeros((hi - lo, MINIMA // BAND_ROWS), np.uint64)
                if len(full):
                    at = first[:-1][full]
                    short = (value >> np.uint64(32)).astype(np.uint32)
                    least = np.stack([np.minimum.reduceat((short ^ m) * f, at) for m, f in zip(_MASKS, _FACTORS, strict=True)], axis=1)
                    # the top bits of one more product depend on all of a minimum, and so on its order; its own lowest are the shingle's
                    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                    for bit in range(BITS):
                        packed = np.packbits((low >> np.uint32(bit)) & np.uint32(1), axis=1, bitorder="little")
                        planes[full, bit * MINIMA // 64 : (bit + 1) * MINIMA // 64] = packed.view(np.uint64)
                    for b in range(bands.shape[1]):
                        key = np.full(len(full), b + 1, np.uint64)
                        for c in range(BAND_ROWS):
                            key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, b * BAND_ROWS + c])
                        bands[full, b] = key
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), _signed(x).ravel())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(_signed(_nodes(value, first))), lists(planes), lists(bands)], names=["id", "n_shingles", "node", "planes", "bands"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textvec.byte_chunks(batch.column(1)):
                value, first = shingle_sets(data, offsets, width)
                yield pa.record_batch([pa.array(_signed(_nodes(value, first))), pa.ListArray.from_arrays(first.astype(np.int32), _signed(value))], names=["id", "items"])

    return run


def estimate(x: str, y: str, minima: int = MINIMA, bits: int = BITS) -> Column:
    """The similarity that two arrays of planes suggest: equal positions, less those that are equal by chance."""
    words = minima // 64
    planes = lambda w: [F.get(x, F.lit(w + b * words)).bitwiseXOR(F.get(y, F.lit(w + b * words))) for b in range(bits)]
    differ = reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, planes(w))) for w in range(words)])
    return (1 - differ / minima - 0.5**bits) / (1 - 0.5**bits)


def floor_of(percent: int, minima: int, bits: int) -> float:
    """Five standard errors of the estimate below the threshold: what is less similar by the bits is no link."""
    p = 0.5**bits + (1 - 0.5**bits) * percent / 100
    return percent / 100 - 5 * (p * (1 - p) / minima) ** 0.5 / (1 - 0.5**bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept``.

    Linked are documents with 100 * intersection >= percent * union of their sets of ``width``-word shingles. Null and
    empty texts have no shingles and no links. Rows that repeat an id are one document, also where their texts differ:
    each has its own ``n_shingles``, and all have the same component. A null id has a null component and is kept. Other
    columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = settle(texts.mapInArrow(_signatures(width), _SIGNATURE))
    full = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    rows = sig.where(full).select("id", "node")
    classes = settle(rows.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("node", "rep"))
    reps = sig.where(full).join(broadcast_if_small(classes), "node", "left").where("rep is null or rep = id").select(F.col("node").alias("id"), F.col("id").alias("rep"), "n_shingles", "planes", "bands")
    buckets = settle(clusters.shared_buckets(reps.select(F.explode("bands").alias("key"), "id")))
    nodes = settle(buckets.select("id").distinct())
    about = settle(reps.join(broadcast_if_small(nodes), "id", "left_semi").select("id", "rep", "planes").dropDuplicates(["id"]))
    texts_of = settle(about.select(F.col("rep").alias("id")).distinct())
    sets = texts.join(broadcast_if_small(texts_of), "id", "left_semi").mapInArrow(_full_sets(width), "id long, items array<long>")
    sets = settle(sets.join(about.select("id", "planes"), "id").dropDuplicates(["id"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        held = lambda end, to: sets.select(F.col("id").alias(end), F.struct(F.size("items").alias("n"), "items", "planes").alias(to))
        least, most = F.least(F.col("u.n"), F.col("v.n")), F.greatest(F.col("u.n"), F.col("v.n"))
        likely = (least < SMALL) | (estimate("u.planes", "v.planes") >= floor_of(percent, MINIMA, BITS))
        near = F.when((least * 100 >= most * percent) & likely, clusters.jaccard_at_least("u.items", "v.items", percent)).otherwise(False)
        return pairs.join(held("a", "u"), "a").join(held("b", "v"), "b").where(near).select("a", "b")

    # rows of one id are one document, whatever their texts
    ends = settle(rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a"))
    again = rows.join(broadcast_if_small(ends), "id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    items = lambda some: sets.join(broadcast_if_small(some), "id", "left_semi").select("id", "items")
    linked = clusters.link(buckets, confirm, items, percent, known=again)

    links = broadcast_if_small(linked.withColumnRenamed("id", "node"))
    told = sig.select("id", "n_shingles", "node").join(links, "node", "left").select("id", "n_shingles", F.when(full, F.coalesce("component", "node")).alias("label"))
    least = settle(told.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("label", "component_id"))
    out = told.join(broadcast_if_small(least), "label", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    discard(buckets, nodes, about, texts_of, sets, classes, ends)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
