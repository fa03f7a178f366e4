"""Best-fit packing (operator 5) with certificates from dual-feasible functions.

Texts become token ids in a map over the documents; only the pieces' lengths take part in packing. Each partition packs
its pieces by best-fit decreasing and compares its bins with a lower bound. Where there is a gap, the documents of the
bins that are not full are exchanged, and a certified partition gives those of its emptiest bin: they are dealt anew to
as many partitions as their number needs, each of which repacks by best-fit decreasing. That ends when one partition
holds what is left, or when the pieces in open bins have become few no more; no task ever takes more than ``per_task``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.scratch import discard, settle

CAPACITY = 2048
#: pieces that one task packs in the first round, about 30 MB there
PIECES_PER_TASK = 100_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for the vocabulary file; built once in each worker.

    The same vocabulary and splits are run by a faster library, whose ids are equal; texts that spell a special token
    go to ``tokenizers`` itself.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, name: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name, self.exact = name, None

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return self.exact.encode(text, add_special_tokens=False).ids


def _cut(name: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(name)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of each document's ids and the end id: only what exceeds ``capacity`` is cut, and the first piece takes the rest."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that the dual-feasible functions f_k of lengths up to ``capacity`` certify.

    For k from 0 to half the capacity: lengths above capacity - k count as whole bins, those from k on as their share of
    a bin, and shorter ones not at all. k = 0 is the volume bound. Also counted are the lengths above a half, of which
    no two share a bin.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = volume[capacity - k] - np.where(k > 0, volume[np.maximum(k - 1, 0)], 0)
    best = large + -(-middle // capacity)
    return int(max(best.max(initial=0), number[-1] - number[capacity // 2]))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and its offset there; pieces go, longest first, to the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    room: list[int] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            at = open_bins[left]
            b = at.pop()
            if not at:
                del open_bins[left], room[k]
        else:
            left, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(room, left)
            open_bins[left].append(b)
    return bins, offsets


def _pack(capacity: int, level: int, last: bool):
    """Packs one partition's rows; ``open`` marks the pieces of bins with room in a partition that is not certified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=n_bins)
        spare = fill < capacity
        if n_bins == lower_bound(lengths, capacity):  # certified: only its emptiest bin can still be shared with others
            spare &= np.arange(n_bins) == np.argmin(fill)
        still = spare[bins] & (not last)
        number = (np.int64(level) << np.int64(58)) + (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + bins
        keep = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, x in (("sequence_id", number), ("offset", offsets), ("open", still)):
            keep = keep.append_column(name, pa.array(x))
        yield from keep.to_batches(max_chunksize=10_000)

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The settled rows of ``cut`` (see ``pieces``) with ``sequence_id`` and ``offset`` (gapless from 0)."""
    schema = f"{_PIECES}, sequence_id long, offset long, open boolean"
    rest, done, level, tasks = cut, [], 0, -(-cut.count() // per_task)
    last = tasks <= 1
    while True:
        by = rest.repartition(max(1, tasks), F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)))
        out = settle(by.mapInArrow(_pack(capacity, level, last), schema))
        done.append(out.where("not open").drop("open"))
        if last:
            break
        rest = out.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
        left = rest.count()
        if not left:
            break
        level, before = level + 1, tasks
        tasks = -(-left // per_task)
        # each round but the last has at most three quarters of the tasks of the one before, so there are few
        last = tasks <= 1 or tasks * 4 > before * 3 or level == 30
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is the end id alone. Rows that repeat a document id are packed each on its own; other columns
    are ignored, whatever their names.
    """
    cut = settle(pieces(docs, id_col, text_col, tokenizer, capacity))
    out = pack(cut, capacity)
    discard(cut)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
