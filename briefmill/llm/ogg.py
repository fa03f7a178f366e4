"""Media columns in Ogg (operator 7): pages with checksums, lacing, multiplexed logical streams and granule positions.

A payload of 8-bit samples is stored as two logical streams of one physical stream: packets of ``SAMPLES`` samples go to
them in turn, each after a header packet and with pages of its own; the granule position of a page on which a packet
ends is the number of samples, of both streams, up to that end. Reading verifies every page's checksum, reassembles
packets from the lacing values, demultiplexes the streams by serial number, and derives each packet's start and end from
the granule positions; these times order the packets of both streams.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, SAMPLES, BLOCK = 8000, 4096, 64
SERIALS = (0x5350_4C30, 0x5350_4C31)
_HEAD = struct.Struct("<4sBBqIIIB")
_NONE = -1
_TIMES = pa.list_(pa.struct([("serial", pa.int64()), ("start", pa.float64()), ("end", pa.float64())]))
_BITS = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, most significant bit first, from 0, without a final inversion.

    That is the common CRC-32 of the bytes with their bits in reverse, with its inversions undone, itself in reverse.
    """
    x = zlib.crc32(page.translate(_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_BITS), "big")


def pages_of(packets: list[tuple[bytes, int]], serial: int, ends: bool = True) -> Iterator[bytes]:
    """The pages of one logical stream, of which each holds one packet or a part; ``packets`` are bytes with the granule position at their end."""
    number = 0
    for k, (data, granule) in enumerate(packets):
        table = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        for a in range(0, len(table), 255):
            part, body = table[a : a + 255], data[255 * a : 255 * (a + 255)]
            done = a + 255 >= len(table)
            flags = (1 if a else 0) | (2 if number == 0 else 0) | (4 if ends and done and k == len(packets) - 1 else 0)
            head = _HEAD.pack(b"OggS", 0, flags, granule if done else _NONE, serial, number, 0, len(part)) + part
            yield head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body
            number += 1


def write(payload: bytes, n_bytes: int) -> bytes:
    """The physical stream of a payload: the streams' first pages, then their other pages in turn."""
    packets: tuple[list, list] = ([], [])
    for stream in (0, 1):
        packets[stream].append((struct.pack("<8sBIQQ", b"SMPL8\0\0\0", stream, RATE, n_bytes, len(payload)), 0))
    for k, at in enumerate(range(0, len(payload), SAMPLES)):
        data = payload[at : at + SAMPLES]
        packets[k % 2].append((data, at + len(data)))
    made = [list(pages_of(p, s)) for p, s in zip(packets, SERIALS, strict=True)]
    rest = [made[0][1:], made[1][1:]]
    turns = [p for i in range(max(map(len, rest))) for part in rest for p in part[i : i + 1]]
    return b"".join([made[0][0], made[1][0], *turns])


class Corrupt(ValueError):
    """The bytes are no well-formed Ogg stream."""


def demultiplex(media: bytes) -> dict[int, dict]:
    """By serial number: ``packets`` [(bytes, granule position or -1)], ``pages``, and whether the stream ``ended``.

    A page's granule position is that of the last packet which ends on it; packets before that on the page have -1.

    Raises ``Corrupt`` where a capture pattern, checksum, page number, length or continuation does not fit.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise Corrupt("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise Corrupt("no capture pattern where a page should begin")
        table = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if len(table) < n or end > len(media):
            raise Corrupt("a page is cut off")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise Corrupt("a page's checksum is wrong")
        s = streams.setdefault(serial, {"packets": [], "pages": 0, "ended": False, "open": b"", "cut": False})
        if number != s["pages"] or bool(flags & 1) != s["cut"] or bool(flags & 2) != (number == 0) or s["ended"]:
            raise Corrupt("a page is missing or out of order")
        body, first = at + 27 + n, len(s["packets"])
        for size in table:
            s["open"] += media[body : body + size]
            body += size
            s["cut"] = size == 255
            if size < 255:
                s["packets"].append([s["open"], _NONE])
                s["open"] = b""
        if len(s["packets"]) > first:
            s["packets"][-1][1] = granule
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        at = end
    if any(s["cut"] or not s["ended"] for s in streams.values()):
        raise Corrupt("a stream has no end")
    return streams


def timed(packets: list, serial: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, serial, bytes) in samples of a stream's packets of one byte a sample, from the granule positions.

    A packet with a position ends there; one without ends where the next on its page starts.
    """
    out, end = [], None
    for data, granule in reversed(packets):
        end = granule if granule != _NONE else end
        if end is None or end < len(data):
            raise Corrupt("a packet has no granule position")
        out.append((end - len(data), end, serial, data))
        end -= len(data)
    return out[::-1]


def read(media: bytes) -> tuple[bytes, int, dict]:
    """The payload, its unpadded length, and what the container tells: pages, packets, streams, duration and ``times``
    [(serial, start, end)] of the packets in seconds, in their order."""
    streams = demultiplex(media)
    if not streams:
        raise Corrupt("no page")
    parts, n_bytes, size, rate = [], 0, 0, RATE
    for serial, s in streams.items():
        magic, _, rate, n_bytes, size = struct.unpack("<8sBIQQ", s["packets"][0][0])
        if magic != b"SMPL8\0\0\0" or not rate:
            raise Corrupt(f"stream {serial} is not of 8-bit samples")
        parts += timed(s["packets"][1:], serial)
    parts.sort()
    if any(a[1] != b[0] for a, b in zip(parts, parts[1:])) or (parts and parts[0][0]):
        raise Corrupt("the granule positions leave a gap or overlap")
    payload = b"".join(p[3] for p in parts)
    if len(payload) != size:
        raise Corrupt("the packets do not add up to the payload")
    told = {"pages": sum(s["pages"] for s in streams.values()), "packets": sum(len(s["packets"]) for s in streams.values()), "streams": len(streams)}
    return payload, n_bytes, told | {"seconds": parts[-1][1] / rate if parts else 0.0, "times": [(serial, a / rate, b / rate) for a, b, serial, _ in parts]}


def padded(text: str | None) -> tuple[bytes, int]:
    """A text as UTF-8 with bytes 0 up to a positive multiple of ``BLOCK``, and its own length; null counts as empty."""
    raw = (text or "").encode()
    return raw + bytes(max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def feature(payload: bytes, told: dict) -> str:
    """Container and signal features: counts, duration, mean, root mean square about 128 and share of sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    turns = np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))
    return f"pages={told['pages']};packets={told['packets']};streams={told['streams']};seconds={told['seconds']:.4f};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};turns={turns}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's payload as an Ogg stream. Null and empty texts are one block of bytes 0. Rows that repeat
    an id are stored each by its own text; a null id stays null. Other columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                media = [write(*padded(t.as_py())) for t in part.column(1)]
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, media binary").withColumnRenamed("id", id_col)


def examine(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", times: bool = False) -> DataFrame:
    """Reads each stream back: payload, its unpadded length and the features, with ``times`` also each packet's serial
    number, start and end in seconds; null or corrupt media give null in all but the id, ``media`` and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for x in part.column(1):
                    try:
                        payload, n, told = read(x.as_py() or b"")
                        rows.append((n, payload, feature(payload, told), None, told["times"] if times else None))
                    except (Corrupt, struct.error, IndexError) as e:
                        rows.append((None, None, None, str(e), None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string(), pa.string(), _TIMES), strict=True)]
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1).cast(pa.binary()), *columns], names=["id", "media", "n_bytes", "payload", "feature", "error", "times"])

    got = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, media binary, n_bytes long, payload binary, feature string, error string, times array<struct<serial: long, start: double, end: double>>")
    got = got.withColumnRenamed("id", id_col)
    return got if times else got.drop("times")
