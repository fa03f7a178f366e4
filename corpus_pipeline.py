"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.llm.line_dedup import dedup_lines
from briefmill.llm.mixing import mix
from briefmill.llm.near_dup import near_duplicates
from briefmill.llm.packing import pack_documents
from briefmill.llm.scratch import broadcast_if_small, discard, settle, spare
from briefmill.llm.toxicity import toxicity as score_toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less all rows of the settled ``ids``; columns of any name are passed on."""
    own = spare(docs.columns, "_id")
    gone = broadcast_if_small(ids.withColumnRenamed("doc_id", own))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go, with all rows of their id. Texts without words and rows without an id stay."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = settle(scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct())
    return _without(docs, bad)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go but for the first. A document that had text and has none left goes with its
    last line; one that was null, empty or white space stays as it was."""
    lines, kept = (spare(docs.columns, c) for c in ("n_lines", "n_kept"))
    out = dedup_lines(docs, counts=(lines, kept))
    emptied = (F.col(kept) < F.col(lines)) & ~F.col("text").rlike("\\S")
    out = out.where(~F.coalesce(emptied, F.lit(False))).drop(lines, kept)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by five-word shingles and a similarity of 0.8; a document
    without words is no one's copy. Rows that repeat an id that stays all stay."""
    gone = settle(near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct())
    return _without(docs, gone)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares of sources, languages and topics meet the targets in expectation, as near as the
    probabilities allow; null sources and languages are values of their own. Documents without tokens are not drawn.
    Column names that begin with _bm_ are the operator's own."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text is an empty one. Rows that repeat an id or a
    text are packed each."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: models and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
        discard(before)
        before = docs if name != STAGES[-1][0] else None
    return docs
