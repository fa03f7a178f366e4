"""Fuzzy line dedup by MinHash (operator 2), in DataFrame operations alone.

A line's shingles are the strings of nine characters at each of its positions; a shorter line is its own one shingle.
Twelve minima of the shingles' hashes are taken by one hash aggregation over the exploded positions, which at the same
time finds equal lines. Each minimum is in three of the twelve bands of three, and two bands share at most one minimum:
a pair of similarity 0.8 shares a band with probability 0.994, whatever the size of its sets.
Candidates are confirmed on the full shingle sets, and a distributed union-find makes components, each of which keeps
the one line that comes first by document id and line number.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.llm import clusters
from briefmill.llm.scratch import broadcast_if_small, discard, settle, spare

WIDTH = 9
#: each makes an order of one 32-bit hash: a mask, and an odd factor for what it gives, of which the low 31 bits count
_rng = random.Random(20240608)
ORDERS = [(_rng.getrandbits(32), _rng.getrandbits(31) | 1) for _ in range(12)]
#: any two bands share at most one minimum
BANDS = [[(b + r) % 12 for r in (0, 1, 3)] for b in range(12)]
#: positions that one exploded row takes
_STEP = 8
#: keys of so many lines at most are compared in full under the bounds of sketches; larger ones go by their rarest items
MEET = 1000


def _codes(line: Column) -> Column:
    """Four bytes a character, so that each character is found without reading those before it."""
    return F.encode(line, "UTF-32")


def _last(codes: Column) -> Column:
    """The position, from 0, of the last shingle."""
    return F.greatest((F.octet_length(codes) / 4).cast("int") - WIDTH, F.lit(0))


def _shingle(codes: Column, at: Column) -> Column:
    return F.substring(codes, at * 4 + 1, F.lit(4 * WIDTH))


def shingles(line: Column) -> Column:
    """The 64-bit hashes of a line's distinct shingles."""
    starts = lambda codes: F.sequence(F.lit(1), 4 * _last(codes) + 1, F.lit(4))
    of = lambda codes: F.transform(starts(codes), lambda i: F.xxhash64(F.substring(codes, i, F.lit(4 * WIDTH))))
    return F.array_distinct(F.get(F.transform(F.array(_codes(line)), of), F.lit(0)))  # the codes are made once


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose lines are near; their sets are built here from the lines, which are an eighth of them in size."""
    held = lambda end, to: texts.select(F.col("id").alias(end), F.col("line").alias(to))
    sets = F.struct(shingles(F.col("u")).alias("x"), shingles(F.col("v")).alias("y"))
    # exploded, the two sets are columns; a filter that names them directly would make them anew for each mention
    # only the lines of pairs are shuffled
    pairs = settle(pairs)
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = texts.join(broadcast_if_small(ends), "id", "left_semi")
    met = pairs.join(held("a", "u"), "a").join(held("b", "v"), "b").select("a", "b", F.explode(F.array(sets)).alias("s"))
    return met.where(clusters.jaccard_at_least("s.x", "s.y", percent)).select("a", "b")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, n, line, k1, k2): document, hash of its text, line number from 0, trimmed line and the line's two hashes."""
    # the text is hashed before its lines are dealt out, once a document
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    rows = rows.select("d", "t", F.posexplode("lines").alias("n", "raw")).where(F.ltrim("raw", F.lit(" \t\n\x0b\f\r")) != "")
    rows = rows.select("d", "t", "n", F.trim("raw").alias("line"))
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def line_components(lines: DataFrame, percent: int = 80) -> DataFrame:
    """A settled table (k1, k2, comp, keeper) of the ``lines`` (a settled table, as ``_lines`` makes it) that have an equal or a near line; ``keeper`` is the document that keeps its first."""
    codes = lines.select("d", "k1", "k2", _codes(F.col("line")).alias("codes")).withColumn("last", _last(F.col("codes")))
    each = codes.select("d", "k1", "k2", "codes", "last", F.explode(F.sequence(F.lit(0), F.expr(f"cast(last div {_STEP} as int)"))).alias("at"))
    # positions beyond the last are the last once more, which changes no minimum
    hashes = [F.hash(_shingle(F.col("codes"), F.least(F.col("at") * _STEP + j, F.col("last")))).cast("long").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"h{j}") for j in range(_STEP)]
    each = each.select("d", "k1", "k2", (F.col("at") == 0).alias("head"), *hashes)
    order = lambda h, mask, factor: (F.col(h).bitwiseXOR(F.lit(mask)) * F.lit(factor)).bitwiseAND(F.lit((1 << 31) - 1))
    minima = [F.min(F.least(*[order(f"h{j}", *o) for j in range(_STEP)])).cast("int").alias(f"m{i}") for i, o in enumerate(ORDERS)]
    known = settle(each.groupBy("k1", "k2").agg(F.min("d").alias("first"), F.count_if("head").alias("times"), *minima))

    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in band]) for b, band in enumerate(BANDS)])
    bands = known.select(F.explode(keys).alias("key"), F.col("k1").alias("id"))
    # a line is one row of ``known``, so a key of several rows has several lines
    many = settle(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = settle(bands.join(broadcast_if_small(many), "key"))
    ids = settle(buckets.select("id").distinct())
    texts = lines.select(F.col("k1").alias("id"), "line").join(broadcast_if_small(ids), "id", "left_semi")
    texts = settle(texts.groupBy("id").agg(F.min("line").alias("line")))
    linked = clusters.link(
        buckets,
        lambda pairs: _near(pairs, texts, percent),
        lambda some: texts.join(broadcast_if_small(some), "id", "left_semi").select("id", shingles(F.col("line")).alias("items")),
        percent,
        few=MEET,
        at_once=clusters.FEW,
        ids=ids,
    )

    seen = known.select("k1", "k2", "first", "times").join(linked, known["k1"] == linked["id"], "left").where("times > 1 or component is not null")
    seen = settle(seen.select("k1", "k2", "first", F.coalesce("component", "k1").alias("comp"), F.col("component").isNull().alias("alone")))
    discard(known, many, buckets, ids, texts)
    # a line without near lines is a component by both its hashes; the others go by the component's label
    own = seen.where("alone").select("k1", "k2", F.xxhash64("k1", "k2").alias("comp"), F.col("first").alias("keeper"))
    group = seen.where("not alone").select("k1", "k2", "comp", "first")
    keepers = group.groupBy("comp").agg(F.min("first").alias("keeper"))
    out = settle(own.unionByName(group.join(keepers, "comp").select("k1", "k2", "comp", "keeper")))
    discard(seen)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the repeated and near-repeated lines of ``text_col`` taken out; with ``counts`` also,
    under these two names, how many lines there were and how many are left.

    Lines are compared without spaces at their ends. Lines of white space alone stay. Each
    component of lines with 100 * intersection >= ``percent`` * union of their shingles, directly or through others,
    keeps its first line in the order of document id and line number. No row is dropped: a document that loses all its
    lines has an empty text; a null text stays null. Rows that repeat a document id with the same text are one document
    and get the same result; a null id orders last. Other columns are passed on as they are, whatever their names.
    """
    lines = settle(_lines(docs, id_col, text_col))
    parts = line_components(lines, percent)
    at = lines.select("d", "t", "n", "k1", "k2").join(broadcast_if_small(parts), ["k1", "k2"]).withColumn("r", F.rank().over(Window.partitionBy("comp", "d").orderBy("t", "n")))
    drops = settle(at.where(~F.col("d").eqNullSafe(F.col("keeper")) | (F.col("r") > 1)).groupBy("d", "t").agg(F.collect_set("n").alias("gone")))
    discard(lines, parts)
    size = drops.agg(F.sum(F.size("gone"))).first()[0] or 0
    taken = [*docs.columns, *(counts or ())]
    of_doc, of_text, gone, split, hashed = (spare(taken, f"_{c}") for c in ("d", "t", "gone", "lines", "hash"))
    drops = drops.select(F.col("d").alias(of_doc), F.col("t").alias(of_text), F.col("gone").alias(gone))
    text = F.col(text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    # the lines are split before the join, so that they are a column there and not split again for each kept line
    parts = docs.select(*rest, F.split(text, "\n", -1).alias(split), F.xxhash64(text_col).alias(hashed))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(of_doc)) & (F.col(hashed) == F.col(of_text))
    joined = parts.join(F.broadcast(drops) if size <= 2_000_000 else drops, same, "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    kept_text = F.when(F.col(gone).isNull(), F.array_join(split, "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col(split), i)), "\n"))
    out = [kept_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.greatest(F.size(split), F.lit(0))
        out += [n.alias(counts[0]), (n - F.coalesce(F.size(gone), F.lit(0))).alias(counts[1])]
    return joined.select(*out)
