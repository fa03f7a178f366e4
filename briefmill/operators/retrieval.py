"""Ranking passages: vector and lexical retrieval, fusion, boosts, dedup and diversity. A passage table has ``id`` and ``text``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75


def passages(docs: DataFrame) -> DataFrame:
    """The lines of each document: doc_id, idx from 0, id (doc_id:idx) and text; the other columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", *rest, F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    return rows.withColumn("id", F.concat_ws(":", "doc_id", "idx"))


def l2_distance(v: Column, query: Sequence[float]) -> Column:
    """Euclidean distance to a fixed vector; vectors of another length are an error, as a wrong model would be."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) == len(query), F.sqrt(d)).otherwise(F.raise_error(F.lit(f"vectors must have {len(query)} components")))


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query``, with ``distance``; ties by id. Each task keeps k rows and one merges them."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("distance", l2_distance(F.col(vector_col), query)).orderBy("distance", id_col).limit(k)


#: prototypes, and short quotes, that meet all rows as one array
SHELF, SHORT = 10_000, 1_000
#: characters of short quotes that may be broadcast
SHORT_CHARS = 16_000_000


def nearest_label(points: DataFrame, labelled: DataFrame, id_col: str, vector_col: str, label_col: str, least: float = 0.3) -> DataFrame:
    """Each point's nearest of the ``labelled`` vectors (a table of label prototypes): label and confidence 1/(1+d).

    Confidences are capped at .99; below ``least`` the label is 'Other'; of equal distances the smaller label counts. The
    prototypes meet the points in blocks of about ``SHELF``; a single block is broadcast, more are not, and then ids must
    be unique, since the nearest of each block's is found by id.
    """
    n = labelled.count()
    block = F.pmod(F.xxhash64(F.col(label_col).cast("string"), vector_col), F.lit(max(1, -(-n // SHELF))))
    shelf = labelled.groupBy(block.alias("block")).agg(F.collect_list(F.struct(F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))).alias("shelf"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    rows = points.crossJoin(F.broadcast(shelf) if n <= SHELF else shelf)
    best = F.array_min(F.transform("shelf", lambda s: F.struct(F.sqrt(square(F.col(vector_col), s["v"])).alias("d"), s["label"].alias("label"))))
    near = rows.select(id_col, best.alias("best"))
    near = near if n <= SHELF else near.groupBy(id_col).agg(F.min("best").alias("best"))
    out = near.select(id_col, F.col("best.d").alias("distance"), F.col("best.label").alias("label"))
    confidence = F.least(F.lit(0.99), 1 / (1 + F.col("distance")))
    return out.select(id_col, F.when(confidence < least, F.lit("Other")).otherwise(F.col("label")).alias("label"), confidence.alias("confidence"))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def term_count(toks: Column | str, word: str) -> Column:
    return F.size(F.filter(toks, lambda x: x == F.lit(word)))


def bm25(rows: DataFrame, terms: Sequence[str], k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(id, score) of the passages that have a term. Term frequencies come from one scan without exploding tokens; the
    statistics are one row: number of passages, mean length, and each term's passages."""
    words = sorted({t.lower() for t in terms})
    toks = rows.select("id", tokens(F.col("text")).alias("t"))
    tf = [term_count("t", w).alias(f"f{i}") for i, w in enumerate(words)]
    counted = toks.select("id", F.size("t").alias("n"), *tf)
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hit = reduce(Column.__or__, [F.col(f"f{i}") > 0 for i in range(len(words))])
    parts = [
        F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        for i in range(len(words))
    ]
    return counted.where(hit).join(F.broadcast(stats)).select("id", reduce(Column.__add__, parts).alias("score"))


def phrase(text: Column, words: Sequence[str]) -> Column:
    """Whether the words stand in the text one after the other, by the tokens of ``tokens``."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {' '.join(w.lower() for w in words)} "))


def rrf(arms: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): (id, score) with the sum of 1 / (k + rank)."""
    return reduce(DataFrame.unionByName, [a.select("id", "rank") for a in arms]).groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def ranked(rows: DataFrame, order: Sequence[Column], depth: int) -> DataFrame:
    """The first ``depth`` rows with ``rank`` from 1. The rows are cut before they are numbered, so the window is small."""
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def boost_if(score: Column, condition: Column, factor: float) -> Column:
    return F.when(condition, score * factor).otherwise(score)


def has_all(text: Column, entities: Sequence[str]) -> Column:
    """All entities occur in the text, whatever the case; false without entities."""
    return reduce(Column.__and__, [F.contains(F.lower(text), F.lit(e.lower())) for e in entities]) if entities else F.lit(False)


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits (doc_id, page, text, score, sub_query) of several sub-queries, one row per doc_id, page and text: the highest
    score, raised by .15 for each further sub-query, and the sub-queries."""
    merged = hits.groupBy("doc_id", "page", "text").agg(F.max("score").alias("top"), F.sort_array(F.collect_set("sub_query")).alias("sub_queries"))
    return merged.withColumn("score", F.col("top") * (1 + 0.15 * (F.size("sub_queries") - 1))).drop("top")


def diversify(hits: DataFrame, limit: int, order: Sequence[Column], group: str = "doc_id", cap: int | None = None) -> DataFrame:
    """``limit`` hits with at most ``cap`` of a document first, and then the overflow in order; ``cap`` defaults to
    max(2, ceil(1.2 * limit / documents))."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rows = hits.withColumn("nth", n)
    if cap is None:
        docs = hits.agg(F.greatest(F.lit(2), F.ceil(F.lit(limit * 1.2) / F.greatest(F.lit(1), F.count_distinct(group)))).alias("cap"))
        rows = rows.join(F.broadcast(docs))
    else:
        rows = rows.withColumn("cap", F.lit(cap))
    return rows.orderBy(F.col("nth") > F.col("cap"), *order).limit(limit).drop("cap")


def pack_budget(hits: DataFrame, group: str, order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Greedy packing in order: a row that does not fit is skipped and later ones may still fit.

    Rows that exceed the budget alone go first. The others are sorted by group and order, spilling where they must, and
    each task reads them once with one running sum: no group is ever held in memory.
    """
    import pyarrow as pa

    at, names = hits.columns.index(group), hits.columns

    def run(batches):
        now, used = object(), 0
        for batch in batches:
            keep = []
            for g, n in zip(batch.column(at).to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if g != now:
                    now, used = g, 0
                keep.append(n is not None and used + n <= budget)
                used += n if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    rows = hits.withColumn("_size", size.cast("long")).where(F.col("_size") <= budget)
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, hits.schema)


def pack_until_full(hits: DataFrame, group: str, order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Packing that stops at the first row that does not fit: a running sum."""
    used = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).where(F.col("used") <= budget)


def score_health(scores: DataFrame) -> DataFrame:
    """Whether a reranker's scores can be trusted: not all equal, not all below .001, none NaN, not all negative, and a
    coefficient of variation of at least .001."""
    s = F.col("score")
    told = scores.agg(F.count("*").alias("n"), F.count_distinct(F.round(s, 6)).alias("distinct"), F.max(s).alias("top"), F.count_if(F.isnan(s)).alias("nan"), (F.stddev_pop(s) / F.abs(F.avg(s))).alias("cv"))
    ok = (F.col("nan") == 0) & (F.col("distinct") > 1) & (F.col("top") >= 0.001) & (F.col("cv") >= 0.001)
    return told.select("n", "distinct", F.coalesce(ok, F.lit(False)).alias("trusted"))


def holds_quote(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id): the ``docs`` (doc_id, text) that hold the text of a quote (item_id, quote), character for character.

    A quote's first and last word may be parts of words, so a document that holds it has its longest inner word as a
    word; they meet by that, and the text decides. Quotes without an inner word, a few words long, are tested against
    each text in blocks of about ``SHORT``, which are broadcast only if all together have at most ``SHORT_CHARS``
    characters. Empty and null quotes are in no document.
    """
    word = F.lit(r"[^\x20\x09-\x0D]+")
    asked = quotes.where("quote <> ''").select("item_id", "quote", F.regexp_extract_all("quote", word, F.lit(0)).alias("w"))
    inner = F.filter(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: x != "")
    asked = asked.withColumn("key", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", word, F.lit(0)))).alias("key"))
    pairs = words.join(asked.where("key is not null").select("item_id", "key"), "key").select("doc_id", "item_id")
    held = pairs.join(docs, "doc_id").join(quotes.select("item_id", "quote"), "item_id").where(F.contains("text", F.col("quote"))).select("doc_id", "item_id")
    few = asked.where("key is null").select("item_id", "quote")
    n, chars = few.agg(F.count("*"), F.coalesce(F.sum(F.length("quote")), F.lit(0))).first()
    block = F.pmod(F.xxhash64("quote"), F.lit(max(1, -(-n // SHORT), -(-chars // SHORT_CHARS))))
    short = few.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "quote")).alias("short"))
    found = docs.crossJoin(F.broadcast(short) if chars <= SHORT_CHARS else short).select("doc_id", F.explode(F.filter("short", lambda q: F.contains(F.col("text"), q["quote"]))["item_id"]).alias("item_id"))
    return held.unionByName(found).distinct()
