"""A stored lexical index: postings with positions in buckets by stem, searched by BM25 or for phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions.stems import _SPECIAL, STOPWORDS, stem
from briefmill.operators.scan import folded

BUCKETS = 256
K1, B = 1.2, 0.75
SCHEMA = "id long, n int, stem string, positions array<int>"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without marks."""
    return F.regexp_extract_all(F.lower(folded(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _begins(asked: str) -> str:
    """What a word of this stem begins with: all but the last three letters, since a stem is a word's beginning with at most
    "le" behind it; words that have a stem of their own begin with the same letter, as all do."""
    return asked[:-3] if len(asked) > 3 and asked not in _SPECIAL.values() else asked[:1]


def postings(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(id, n, stem, positions) from (id, text): where each stem stands, and the number of words that are no stopwords.

    Positions count all words from 0, so that stopwords keep their places in phrases. Null, empty and stopword texts
    have no postings; ids are unique; other columns are ignored. With ``only``, just the postings of these stems: words
    that begin otherwise are not stemmed.
    """
    if only is not None:
        return _postings_of(rows, only)
    stop = frozenset(STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, stems, places = [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found: dict[str, list[int]] = {}
                    n = 0
                    for p, w in enumerate(text or ()):
                        if w not in stop:
                            n += 1
                            found.setdefault(stem(w) if w.isascii() else w, []).append(p)
                    ids += [i] * len(found)
                    sizes += [n] * len(found)
                    stems += found
                    places += found.values()
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(stems, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["id", "n", "stem", "positions"])

    return rows.select(F.col("id").cast("long").alias("id"), words(F.col("text")).alias("w")).mapInArrow(run, SCHEMA)


def _postings_of(rows: DataFrame, only: list[str]) -> DataFrame:
    stems = frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = []
                for i, n, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    found: dict[str, list[int]] = {}
                    for x in text:
                        s = stem(x["w"]) if x["w"].isascii() else x["w"]
                        if s in stems:
                            found.setdefault(s, []).append(x["p"])
                    made += [(i, n, s, places) for s, places in found.items()]
                cols = list(zip(*made)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())))], names=["id", "n", "stem", "positions"])

    told = rows.select(F.col("id").cast("long").alias("id"), words(F.col("text")).alias("w"))
    begins = sorted({_begins(s) for s in stems})
    might = lambda w: reduce(Column.__or__, [F.startswith(w, F.lit(b)) for b in begins], F.lit(False)) & ~w.isin(STOPWORDS)
    mine = F.filter(F.transform("w", lambda w, p: F.struct(p.alias("p"), w.alias("w"))), lambda x: might(x["w"]))
    n = F.size(F.filter("w", lambda w: ~w.isin(STOPWORDS)))
    return told.select("id", n.alias("n"), mine.alias("x")).where(F.size("x") > 0).mapInArrow(run, SCHEMA)


def append(rows: DataFrame, path: str) -> None:
    """Add new rows to the index at ``path``: postings in their buckets' folders, and each row's length. Two plain appends: a
    failure between them leaves postings of rows without a length, which searches ignore until they are added again."""
    made = postings(rows).withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).cast("int"))
    made.repartition("bucket").sortWithinPartitions("bucket", "stem", "id").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    size = F.size(F.filter(words(F.col("text")), lambda w: ~w.isin(STOPWORDS)))
    rows.select(F.col("id").cast("long").alias("id"), F.when(size > 0, size).otherwise(0).alias("n")).write.mode("append").parquet(f"{path}/rows")


def _asked(text: str) -> list[tuple[int, str]]:
    """(place, stem) of a query's words that are no stopwords."""
    from unicodedata import combining, normalize

    plain = "".join(c for c in normalize("NFKD", text.lower()) if not combining(c))
    return [(i, stem(w) if w.isascii() else w) for i, w in enumerate(re.findall(r"[^\W_]+", plain)) if w not in STOPWORDS]


def asked_stems(text: str) -> list[str]:
    """The stems that a query asks for."""
    return sorted({s for _, s in _asked(text)})


def _read(index: DataFrame, stems: list[str]) -> DataFrame:
    """The postings of ``stems``; of a stored index, from their buckets alone."""
    hit = index.where(F.col("stem").isin(stems))
    if "bucket" not in index.columns:
        return hit
    spark = index.sparkSession
    buckets = spark.createDataFrame([(s,) for s in stems], "stem string").select(F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).cast("int")).distinct().collect()
    return hit.where(F.col("bucket").isin([b[0] for b in buckets]))


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The postings and rows of the index at ``path``."""
    return spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{path}/postings"), spark.read.schema("id long, n int").parquet(f"{path}/rows")


def search(index: DataFrame, rows: DataFrame, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the rows that hold a stem of ``text``, by BM25; a stem that is asked twice counts twice.

    ``rows`` has (id, n) of all rows; their number and mean length are one row, and each stem's rows are counted from its
    postings. Only stopwords find nothing.
    """
    stems = [s for _, s in _asked(text)]
    if not stems:
        return index.sparkSession.createDataFrame([], "id long, score double")
    times = F.create_map(*[F.lit(x) for s in set(stems) for x in (s, stems.count(s))])
    hit = _read(index, sorted(set(stems))).select("id", "n", "stem", F.size("positions").alias("f"))
    df = hit.groupBy("stem").agg(F.count("*").alias("df"))  # as many rows as stems are asked
    df = df.withColumns({"docs": rows.agg(F.count("*")).scalar(), "mean": rows.agg(F.avg("n")).scalar()})
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * times[F.col("stem")]
    part = weight * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hit.join(F.broadcast(df), "stem").groupBy("id").agg(F.sum(part).alias("score"))


def phrase(index: DataFrame, text: str) -> DataFrame:
    """(id, n) of the rows where the words stand one after the other, with any word at a stopword's place; ``n`` times."""
    asked = _asked(text)
    if not asked:
        return index.sparkSession.createDataFrame([], "id long, n int")
    first = asked[0][0]
    hit = _read(index, sorted({s for _, s in asked})).groupBy("id").agg(*[F.first(F.when(F.col("stem") == s, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, (_, s) in enumerate(asked)])
    begin = None
    for i, (place, _) in enumerate(asked):
        shift = place - first
        moved = F.transform(f"p{i}", (lambda n: lambda p: p - n)(shift))
        begin = moved if begin is None else F.array_intersect(begin, moved)
    return hit.select("id", F.size(begin).alias("n")).where("n > 0")
