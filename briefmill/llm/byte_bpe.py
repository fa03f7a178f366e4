"""Byte-level BPE encoding and decoding (operator 13) by a two-tier lookup.

Texts are split by a pattern into pre-tokens. A minimal perfect hash over the vocabulary finds the pre-tokens that are
one token; the others are merged by rank with a heap over linked bytes. Each distinct pre-token of a slice of documents
is looked up once. Encoding and decoding are maps over the rows, with no shuffle.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.textvec import mix, run_hashes, spread

#: code points split at a time
WINDOW = 1 << 18
#: code points of documents whose distinct pre-tokens are looked up together
SLICE = 1 << 22
#: ids decoded at a time
DECODE = 1 << 18
#: merged pre-tokens in each of the two generations kept between slices, about 50 MB in a worker
MERGED = 250_000


class PerfectHash:
    """Keys to 0..n-1 without gaps: a key's bucket holds the displacement that gives all keys of the bucket slots of
    their own. Buckets of one key hold their slot itself, as a negative number."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        hashes = hashes_of(keys)
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        ends = np.cumsum(sizes)
        taken = np.zeros(n, bool)
        self.at = np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size < 2:
                break
            mine = order[ends[b] - size : ends[b]]
            for first in range(1, 1 << 40, 64):  # 64 displacements at once
                tries = np.arange(first, first + 64, dtype=np.uint64)[:, None]
                slots = (mix(hashes[mine] ^ mix(tries)) % np.uint64(n)).astype(np.int64)
                free = ~taken[slots].any(1)
                if size > 1:
                    s = np.sort(slots, 1)
                    free &= (s[:, 1:] != s[:, :-1]).all(1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b] = first + k
                    taken[slots[k]] = True
                    self.at[slots[k]] = mine
                    break
        single = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(~taken)[: len(single)]
        self.shift[single] = -1 - slots
        self.at[slots] = order[ends[single] - 1]

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The one slot in which each key can stand; whether it does, the key there tells."""
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        hashed = (mix(hashes ^ mix(shift.astype(np.uint64))) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -1 - shift, hashed)


def hashes_of(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    return run_hashes(np.frombuffer(b"".join(keys), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends)


class Vocabulary:
    """Tokens by rank, from a file of base64 tokens and ranks."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        self.place = tokens  # for the merges' single lookups
        size = max(tokens.values(), default=-1) + 1
        by_rank = {r: k for k, r in tokens.items()}
        self.start = np.zeros(size + 1, np.int64)
        np.cumsum([len(by_rank.get(r, b"")) for r in range(size)], out=self.start[1:])
        self.bytes = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(size)), np.uint8)

    @functools.cached_property
    def table(self) -> tuple[PerfectHash, list[bytes], np.ndarray]:
        """The hash, and each slot's token and rank."""
        keys = list(self.place) or [b""]
        at = PerfectHash(keys)
        key = [keys[i] for i in at.at]
        return at, key, np.array([self.place.get(k, -1) for k in key], np.int64)

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """The rank of each piece that is a token as it stands, else -1."""
        at, key, rank = self.table
        slots = at.slots(hashes_of(pieces))
        same = np.fromiter(map(bytes.__eq__, map(key.__getitem__, slots.tolist()), pieces), bool, len(pieces))
        return np.where(same, rank[slots], -1)

    @functools.cached_property
    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """Each byte's rank, and the rank of each two bytes; -1 where they are no token."""
        one = np.array([self.place.get(bytes([b]), -1) for b in range(256)], np.int64)
        two = np.full(1 << 16, -1, np.int64)
        for key, r in self.place.items():
            if len(key) == 2:
                two[key[0] << 8 | key[1]] = r
        return one, two

    def merged(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Each piece's bytes, merged pair by pair: the lowest rank first, of equal ones the leftmost."""
        one, two = self.singles
        rows = np.frombuffer(b"".join(pieces) + b"\0", np.uint8).astype(np.int64)
        ids, first = one[rows[:-1]].tolist(), two[rows[:-1] << 8 | rows[1:]].tolist()
        at = 0
        for piece in pieces:
            end = at + len(piece)
            yield self._merge(piece, ids[at:end], first[at : end - 1])
            at = end

    def _merge(self, piece: bytes, ids: list[int], rank: list[int]) -> list[int]:
        """``rank`` has the rank of each place's pair. The heap holds ranks and left places as one number; an entry
        counts if its place still has a pair of that rank."""
        n, get, pop, push = len(piece), self.place.get, heapq.heappop, heapq.heappush
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        live = len(heap)  # places with a pair
        if not live:
            return ids
        heapq.heapify(heap)
        rank.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while live:
            top = pop(heap)
            i, r = top & low, top >> bits
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            live -= 1 if rank[j] < 0 else 2
            ids[i], ids[j], rank[j] = r, -1, -1
            before[k] = i
            q = rank[i] = get(piece[i : after[k]], -1) if k < n else -1
            if q >= 0:
                live += 1
                push(heap, q << bits | i)
            h = before[i]
            if h >= 0:
                if rank[h] >= 0:
                    live -= 1
                q = rank[h] = get(piece[h:k], -1)
                if q >= 0:
                    live += 1
                    push(heap, q << bits | h)
        return [x for x in ids if x >= 0]


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def pre_tokens(text: str, pattern, window: int = WINDOW) -> Iterator[list[str]]:
    """The pattern's matches, which cover the text, a window at a time.

    Matches that end within two code points of the window's end may go on beyond it ('re, white space) and are made
    anew at the start of the next window; a match as long as a window doubles it.
    """
    at, size = 0, window
    while at < len(text):
        end = at + size
        found = pattern.findall(text, at, end)
        if end >= len(text):
            yield found
            return
        stop = sum(map(len, found)) + at
        while found and stop > end - 2:
            stop -= len(found.pop())
        size = window if found else 2 * size
        at = stop
        if found:
            yield found


class _Numbers(dict):
    """Numbers its keys as they first come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    def __init__(self, vocab: Vocabulary, pattern: str) -> None:
        import regex

        self.vocab, self.pattern = vocab, regex.compile(pattern)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (with one entry more at the end)."""
        number = _Numbers()
        parts, sizes = [np.zeros(0, np.int32)], [0]
        for text in texts:
            n = 0
            for found in pre_tokens(text, self.pattern):
                parts.append(np.array(list(map(number.__getitem__, found)), np.int32))
                n += len(found)
            sizes.append(n)
        pieces = [p.encode("utf-8", "replace") for p in number]
        ranks = self.vocab.whole(pieces)
        others = np.flatnonzero(ranks < 0)
        made = self.split([pieces[i] for i in others.tolist()])
        length = np.ones(len(pieces), np.int64)
        length[others] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.r_[0, np.cumsum(length)].astype(np.int64)
        flat = np.empty(int(starts[-1]), np.int32)
        flat[starts[:-1]] = ranks
        flat[spread(starts[others], starts[others + 1])] = np.frombuffer(b"".join(made), np.int32)
        used = np.concatenate(parts)
        tokens = np.r_[0, np.cumsum(length[used])].astype(np.int64)
        return flat[spread(starts[used], starts[used + 1])], tokens[np.cumsum(sizes)]

    def split(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are no token, four bytes an id. The pieces of the last slices are kept: a full
        generation becomes the old one, and what is used of that comes into the young one again."""
        found = [self.young.get(p) or self.old.get(p) for p in pieces]
        new = self.vocab.merged([p for p, ids in zip(pieces, found) if ids is None])
        out = [array("i", next(new)).tobytes() if ids is None else ids for ids in found]
        self.young.update((p, ids) for p, ids in zip(pieces, out) if len(p) <= 64)
        if len(self.young) > MERGED:
            self.young, self.old = {}, self.young
        return out


def _path(ranks: str) -> str:
    import public_tokenizers

    return ranks if "/" in ranks else public_tokenizers.path(ranks)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """One row per document: id and ``ids``, the tokens of its whole text, without special tokens.

    ``ranks`` is a path, or the name of one of the public tokenizers' rank files. Null and empty texts have no ids.
    Repeated rows are encoded each; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(vocabulary(_path(ranks)), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < SLICE):
                    size += len(texts[end] or "")
                    end += 1
                ids, starts = encoder.encode([t or "" for t in texts[at:end]])
                rows = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(at, end - at), rows], names=["id", "ids"])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """One row per row: id, ``ids`` and ``bytes``, what the ids stand for; they need not be valid UTF-8. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_path(ranks))
        length = np.diff(vocab.start)
        for batch in batches:
            rows = batch.column(1)
            for at in range(0, len(rows), 64):
                part = rows.slice(at, 64)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(length[ids])]
                n = np.array([0 if x is None else x for x in part.value_lengths().to_pylist()], np.int64)
                data = b"".join(vocab.bytes[spread(vocab.start[some], vocab.start[some + 1])].tobytes() for some in (ids[i : i + DECODE] for i in range(0, len(ids), DECODE)))
                places = ends[np.r_[0, np.cumsum(n)]].tolist()
                made = pa.array([data[a:b] for a, b in zip(places, places[1:])], pa.binary())
                yield pa.record_batch([batch.column(0).slice(at, 64), part, made], names=["id", "ids", "bytes"])

    got = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, ids array<int>, bytes binary")
    return got.withColumnRenamed("id", id_col)
