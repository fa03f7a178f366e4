"""Source divergence audit (operator 12): which sources of a language use its terms differently, and which terms they favour.

Terms are encoded as integers. One map over the documents adds up, by batch, each source's occurrences of a term and the
documents that hold it; Spark adds up the batches. The terms of a language are then dealt to chunks by hash. A chunk
sorts its terms by their UTF-8 bytes, keeps those in enough documents of the language, and gives each row its id by
``searchsorted`` in that sorted array: ids keep the order of the terms, so that ties are broken by the id. Once the
totals of all chunks are known, each chunk makes dense vectors by ``bincount`` and adds its part to each pair of sources
and its best terms to each source. No dictionary is broadcast, and no language or source is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefmill.llm.scratch import discard, settle
from briefmill.llm.textvec import byte_chunks, run_bounds

#: counted (lang, source, term) rows in a chunk, about; more where a language has many pairs of sources
CHUNK_ROWS = 20_000
#: cells of a dense block of sources and terms
CELLS = 1 << 21
SCALE_STEPS, SCALE_STEP = 3, 1000  # p is a share of SCALE_STEP ** SCALE_STEPS, a thousand million

_TERM = np.zeros(256, bool)
_TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each row's number, and the distinct values by number."""
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row of each term, and the terms in lower case, as they stand in the texts."""
    starts, ends = run_bounds(_TERM[data], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    letters = _LOWER[data[_TERM[data]]]
    return row, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(letters))


def term_counts(docs: DataFrame) -> DataFrame:
    """Sums by ``lang``, ``source`` and ``term``: occurrences ``n`` and documents ``docs``. The term '' holds the source's
    documents, so that sources without terms are there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, langs = _codes(batch.column(1))
            source, sources = _codes(batch.column(2))
            group = lang * len(sources) + source
            all_groups, n = np.unique(group, return_counts=True)
            yield pa.record_batch([langs.take(all_groups // len(sources)), sources.take(all_groups % len(sources)), pa.array([""] * len(n)), pa.array(n * 0), pa.array(n)], schema=_COUNTED)
            for first, _, data, offsets in byte_chunks(batch.column(0), 8 << 20):
                row, terms = _terms(data, offsets)
                term, known = _codes(terms)
                if not len(term):
                    continue
                row += first
                by_doc, times = np.unique(row * len(known) + term, return_counts=True)  # each document's terms once
                key = group[by_doc // len(known)] * len(known) + by_doc % len(known)
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                key, of = key[begin], key[begin] // len(known)
                cols = [langs.take(of // len(sources)), sources.take(of % len(sources)), known.take(key % len(known)).cast(pa.string()), np.add.reduceat(times, begin), np.diff(np.r_[begin, len(times)])]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=_COUNTED)

    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    return docs.select(text, lang, source).mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _encode(least: int):
    """Of a chunk's counted rows: its kept terms in order (a row without a source), and each source's ids and counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        term, known = _codes(table["term"].chunk(0))
        order = pc.sort_indices(known).to_numpy()  # by bytes, which is the order of UTF-8
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.zeros(len(order), np.int64)
        np.add.at(docs, place[term], table["docs"].to_numpy())
        kept = np.flatnonzero(docs >= least)
        ids = np.searchsorted(kept, place[term])
        mine = np.flatnonzero(docs[place[term]] >= least)
        source, sources = _codes(table["source"].chunk(0))
        mine = mine[np.lexsort((ids[mine], source[mine]))]
        present, begin = np.unique(source[mine], return_index=True)
        rows = len(present) + 1
        places = pa.array(np.r_[0, begin, len(mine)][[0, *range(1, rows), rows]], pa.int32())  # the head's lists are empty
        return pa.table({
            "lang": pa.array([table["lang"][0].as_py()] * rows),
            "chunk": pa.array([table["chunk"][0].as_py()] * rows, pa.int64()),
            "source": pa.array([None, *sources.take(pa.array(present)).to_pylist()], pa.string()),
            "terms": pa.array([known.take(pa.array(order[kept])).to_pylist(), *[None] * (rows - 1)], pa.list_(pa.string())),
            "ids": pa.ListArray.from_arrays(places, pa.array(ids[mine], pa.int32())),
            "n": pa.ListArray.from_arrays(places, pa.array(table["n"].to_numpy()[mine], pa.int64())),
        })

    return run


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), by long division in steps, so that 64 bits hold it for totals up to 9 * 10^15."""
    out, rest = np.divmod(count + 5, total)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * SCALE_STEP, total)
        out = out * SCALE_STEP + digits
    return out + 1


def _compare(top: int):
    """A chunk's part of each pair of sources, once a pair, and its ``top`` terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = rows["source"].index(None)
        lang, terms, v = rows["lang"][head], rows["terms"][head], rows["v"][head]
        sources = [g["source"] for g in rows["groups"][head]]
        n_sources, at = len(sources), {s: i for i, s in enumerate(sources)}
        totals = np.array([g["total"] for g in rows["groups"][head]], np.int64) + 5 * v
        whole = int(totals.sum()) - 5 * v * (n_sources - 1)
        size = [len(x) for x in rows["ids"]]
        source = np.repeat([at.get(s, 0) for s in rows["source"]], size)
        ids, n = (np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) for c in ("ids", "n"))
        pairs, found = np.zeros((n_sources, n_sources), np.int64), []
        width = max(1, CELLS // n_sources)
        for first in range(0, len(terms), width):
            cols = min(width, len(terms) - first)
            here = (ids >= first) & (ids < first + cols)
            cells = np.bincount(source[here] * cols + ids[here] - first, n[here], n_sources * cols)  # exact below 2^53
            dense = cells.astype(np.int64).reshape(n_sources, cols)
            p, q = share(dense, totals[:, None]), share(dense.sum(0), np.int64(whole))
            for i in range(n_sources):
                pairs[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
                over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                more = p[i][over] - q[over]
                best = np.argsort(-more, kind="stable")[:top]  # equal values by id, the order of the terms
                found += [(sources[i], terms[first + t], int(x)) for t, x in zip(over[best].tolist(), more[best].tolist())]
        a, b = np.triu_indices(n_sources, 1)
        out = [["pair"] * len(a) + ["term"] * len(found), [sources[i] for i in a] + [f[0] for f in found], [sources[i] for i in b] + [f[1] for f in found], pairs[a, b].tolist() + [f[2] for f in found]]
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64())))], names=["lang", "part", "source", "item", "value"])

    return run


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """One row per pair of sources of a language (part ``pair``: item is the other source) and per favoured term of a source
    (part ``term``, the ``top`` first): ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    A language keeps the terms in at least ``least`` of its documents. Null texts, languages and sources count as
    empty; sources without terms take part in pairs, with 0 where the language keeps no term. Repeated rows are
    documents each; equal values are ranked by the item's UTF-8 bytes; other columns are ignored, whatever their names.
    A chunk holds one number per pair of a language's sources, which the result lists anyway.
    """
    counted = settle(term_counts(docs))
    groups = counted.where("term = ''").select("lang", "source")
    pairs = groups.groupBy("lang").count().agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0]
    chunks = max(1, counted.count() // max(CHUNK_ROWS, min(pairs, 1_000_000)))
    dealt = counted.where("term <> ''").withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)))
    coded = settle(dealt.groupBy("lang", "chunk").applyInArrow(_encode(least), "lang string, chunk long, source string, terms array<string>, ids array<int>, n array<long>"))

    heads, rows = coded.where("source is null and size(terms) > 0"), coded.where("source is not null")
    totals = rows.groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    by_lang = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    size = heads.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    langs = settle(by_lang.join(size, "lang", "left").select("lang", "groups", F.coalesce("v", F.lit(0)).alias("v")))

    parts = heads.join(langs, "lang").unionByName(rows.where(F.size("ids") > 0), allowMissingColumns=True).groupBy("lang", "chunk").applyInArrow(_compare(top), "lang string, part string, source string, item string, value long")
    sums = parts.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = sums.select("lang", "part", F.explode(F.when(F.col("part") == "pair", ways).otherwise(F.slice(ways, 1, 1))).alias("w"), "value")
    bare = langs.where("v = 0").select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", F.lit("pair").alias("part"), "source", F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value"))
    told = both.select("lang", "part", "w.source", "w.item", "value").unionByName(bare.where("source <> item"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = settle(told.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank"))
    discard(counted, coded, langs)
    return out
