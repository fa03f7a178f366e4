"""Vectorised splitting and hashing of whole texts, a bounded chunk of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, as many as the longest chunk so far needs."""

    def __init__(self) -> None:
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_BYTES + 2)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _ODD)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse)])
        return self.up, self.down


_POWERS = Powers()
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def run_bounds(inside: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; a run ends with its text, and where ``classes`` changes."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets[offsets < n]] = True
    edge[n] = edge[0] = True
    if classes is not None:
        edge[1:n] |= classes[1:] != classes[:-1]
    starts = inside & (edge[:n] | ~np.r_[False, inside[:-1]])
    ends = inside & (edge[1:] | ~np.r_[inside[1:], False])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands; runs in order, about ``CHUNK_BYTES`` of data at a time."""
    if len(data) <= 2 * CHUNK_BYTES or not len(starts):
        return _run_hashes(data, starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        if b - a <= 2 * CHUNK_BYTES:
            out[i:j] = _run_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a)
        else:  # one run longer than a chunk: the parts' sums, each times the power of its place
            total, up = np.zeros(1, np.uint64), _POWERS.of(CHUNK_BYTES + 1)[0]
            for part in range(int(a), int(b), CHUNK_BYTES):
                codes = _BYTE_CODES[data[part : min(part + CHUNK_BYTES, b)]]
                place = np.uint64(pow(int(_ODD), part - int(a), 1 << 64))
                total += (codes * up[: len(codes)]).sum(dtype=np.uint64) * place
            out[i:j] = mix(total + np.uint64(b - a))
        i = j
    return out


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS.of(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: 0 white space, 1 letters and digits and all bytes beyond ASCII, 2 other signs
_KIND = np.full(256, 2, np.uint8)
_KIND[_SPACE] = 0
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_lo:_hi] = 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, A-Z lowered, and each text's first word (with one entry more at the end)."""
    low = _LOWER[data]
    starts, ends = run_bounds(~_SPACE[data], offsets)
    return run_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word characters and runs of other signs: hashes, each text's first token, starts and ends."""
    kind = _KIND[data]
    starts, ends = run_bounds(kind > 0, offsets, kind)
    return run_hashes(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets), starts, ends


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions of all the ranges, one range after the other."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(n) - n), n)
