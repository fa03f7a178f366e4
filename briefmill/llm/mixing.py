"""Mixing sources to target weights (operator 3) by iterative proportional fitting.

One pass over the documents counts tokens (words between white space) in cells of source, language and topic. Raking
scales the cells until their token shares meet the target marginals; each document is then drawn with its cell's
probability. The cells are few: up to ``LOCAL_CELLS`` of them are raked in numpy on the driver, beyond that by the same
steps in Spark. The draw is a hash of the document's id, so that it is the same in every run and after lost executors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.scratch import discard, settle

LOCAL_CELLS = 100_000
ITERATIONS = 30
#: topics by the first pattern that the text has; else the last name
TOPICS = (("licensed", "(?i)licensed? under"), ("table", " \\| "), ("signs", "[%#&$*]{3}"), ("shout", "!!"))
OTHER_TOPIC = "prose"
DIMENSIONS = ("source", "lang", "topic")
#: target share of a value is its token share to this power, made to sum to one
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def topic_of(text: Column) -> Column:
    return reduce(lambda rest, t: F.when(text.rlike(t[1]), F.lit(t[0])).otherwise(rest), reversed(TOPICS), F.lit(OTHER_TOPIC))


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def tempered_targets(cells: list[tuple], temperatures: dict[str, float] = TEMPERATURES) -> dict[str, dict]:
    """Target shares of each dimension's values, from the cells (source, lang, topic, tokens)."""
    out = {}
    for i, dim in enumerate(DIMENSIONS):
        total: dict = {}
        for c in cells:
            total[c[i]] = total.get(c[i], 0) + c[3]
        whole = sum(total.values()) or 1
        powers = {k: (v / whole) ** temperatures[dim] for k, v in sorted(total.items(), key=str) if v}
        norm = sum(powers.values())
        out[dim] = {k: v / norm for k, v in powers.items()}
    return out


def rake(cells: list[tuple], targets: dict[str, dict], iterations: int = ITERATIONS) -> np.ndarray:
    """A factor for each cell (source, lang, topic, tokens), so that the shares of tokens times factor meet ``targets``.

    Values without a target get the factor 0; targets of values that no cell has are left out, and the rest rescaled.
    """
    tokens = np.array([c[3] for c in cells], float)
    w = tokens / max(tokens.sum(), 1)
    keys = []
    for i, dim in enumerate(DIMENSIONS):
        names = sorted({c[i] for c in cells}, key=str)
        at = {k: n for n, k in enumerate(names)}
        goal = np.array([targets[dim].get(k, 0.0) for k in names])
        keys.append((np.array([at[c[i]] for c in cells], int), goal / max(goal.sum(), 1e-300)))
    for _ in range(iterations):
        for index, goal in keys:
            have = np.bincount(index, weights=w, minlength=len(goal))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[index]
    return np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)


def rake_in_spark(cells: DataFrame, targets: dict[str, dict] | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """The same as ``rake`` on a DataFrame of cells (source, lang, topic, tokens), with the column ``factor``."""
    spark = cells.sparkSession
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    now = settle(cells.withColumn("w", F.col("tokens") / F.lit(float(whole))))
    goals = {}
    for dim in DIMENSIONS:
        if targets is None:
            share = now.groupBy(dim).agg(F.pow(F.sum("w"), F.lit(TEMPERATURES[dim])).alias("goal")).where("goal > 0")
        else:
            share = spark.createDataFrame(list(targets[dim].items()), f"{dim} string, goal double")
            share = share.join(now.select(F.col(dim).alias("there")).distinct(), F.col(dim).eqNullSafe(F.col("there")), "left_semi")
        norm = share.agg(F.sum("goal")).first()[0] or 1.0
        goals[dim] = settle(share.withColumn("goal", F.col("goal") / F.lit(norm)))
    for _ in range(iterations):
        before = now
        for dim in DIMENSIONS:
            have = now.groupBy(dim).agg(F.sum("w").alias("have"))
            goal = goals[dim].withColumnRenamed(dim, "k")
            scale = have.join(goal, F.col(dim).eqNullSafe(F.col("k")), "left").select(F.col(dim).alias("k"), F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("f"))
            now = now.join(scale, now[dim].eqNullSafe(scale["k"])).withColumn("w", F.col("w") * F.col("f")).drop("k", "f")
        now = settle(now)
        discard(before)
    return now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)).drop("w")


def scale_for(tokens: np.ndarray, factor: np.ndarray, rate: float) -> float:
    """The scale at which min(1, scale * factor) keeps ``rate`` of all tokens in expectation, or all that can be kept."""
    whole = tokens.sum() * rate
    order = np.argsort(-factor)
    t, f = tokens[order], factor[order]
    full, rest = 0.0, float((t * f).sum())
    for i in range(len(f)):
        if f[i] <= 0 or rest <= 0:
            break
        scale = (whole - full) / rest
        if scale * f[i] <= 1:
            return scale
        full += t[i]
        rest -= t[i] * f[i]
    positive = f[f > 0]
    return 1 / positive.min() if len(positive) else 0.0


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the id's text; a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _drawn(docs: DataFrame, id_col: str, text_col: str, targets: dict[str, dict] | None, rate: float, local_cells: int) -> DataFrame:
    """``docs`` with _bm_topic, _bm_tokens, _bm_probability and _bm_kept; the texts are not shuffled where the cells are few."""
    own = {"_bm_source": F.col("source").cast("string"), "_bm_lang": F.col("lang").cast("string"), "_bm_topic": topic_of(F.coalesce(F.col(text_col), F.lit(""))), "_bm_tokens": token_count(F.col(text_col))}
    told = docs.withColumns(own)
    cells = settle(told.groupBy(F.col("_bm_source").alias("source"), F.col("_bm_lang").alias("lang"), F.col("_bm_topic").alias("topic")).agg(F.sum("_bm_tokens").alias("tokens")))
    spark = docs.sparkSession
    if cells.limit(local_cells + 1).count() <= local_cells:
        rows = sorted((tuple(r) for r in cells.collect()), key=str)
        factor = rake(rows, targets or tempered_targets(rows)) if rows else np.zeros(0)
        scale = scale_for(np.array([r[3] for r in rows], float), factor, rate)
        made = [(*r[:3], float(min(1.0, scale * f))) for r, f in zip(rows, factor, strict=True)]
        known = F.broadcast(spark.createDataFrame(made, "_bm_s string, _bm_l string, _bm_t string, _bm_probability double"))
    else:
        raked = settle(rake_in_spark(cells, targets))
        low, high = 0.0, 1.0 / (raked.where("factor > 0").agg(F.min("factor")).first()[0] or 1.0)
        whole = (cells.agg(F.sum("tokens")).first()[0] or 0) * rate
        for _ in range(50):  # the kept tokens grow with the scale
            middle = (low + high) / 2
            got = raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * middle))).first()[0] or 0.0
            low, high = (middle, high) if got < whole else (low, middle)
        known = raked.select(F.col("source").alias("_bm_s"), F.col("lang").alias("_bm_l"), F.col("topic").alias("_bm_t"), F.least(F.lit(1.0), F.col("factor") * high).alias("_bm_probability"))
    same = F.col("_bm_source").eqNullSafe(F.col("_bm_s")) & F.col("_bm_lang").eqNullSafe(F.col("_bm_l")) & (F.col("_bm_topic") == F.col("_bm_t"))
    return told.join(known, same, "left").withColumn("_bm_kept", uniform(F.col(f"`{id_col}`")) < F.coalesce("_bm_probability", F.lit(0.0)))


def probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, rate: float = 0.5, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(id, source, lang, topic, tokens, probability, kept) of every document.

    A document is kept if the number drawn from its id is below its cell's probability, so rows that repeat an id and
    differ in nothing else share their fate. Null sources and languages are values of their own; a null text has no
    tokens and the topic of an empty one. Other columns are ignored, whatever their names.
    """
    drawn = _drawn(docs.select(id_col, text_col, "source", "lang"), id_col, text_col, targets, rate, local_cells)
    return drawn.select(id_col, F.col("_bm_source").alias("source"), F.col("_bm_lang").alias("lang"), F.col("_bm_topic").alias("topic"), F.col("_bm_tokens").alias("tokens"), F.coalesce("_bm_probability", F.lit(0.0)).alias("probability"), F.col("_bm_kept").alias("kept"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with their own columns."""
    return _drawn(docs, id_col, text_col, targets, rate, LOCAL_CELLS).where("_bm_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
