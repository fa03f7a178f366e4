"""Joins between documents and the entities around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.sources.tables import spread


def related(rows: DataFrame, key: str, others: DataFrame, other_key: str, where: Column, negate: bool = False) -> DataFrame:
    """Rows with (or, negated, without) a related row for which ``where`` holds; null keys have no relation."""
    keys = others.where(where).select(F.col(other_key).alias(key)).distinct()
    return rows.join(keys, key, "left_anti" if negate else "left_semi")


def narrowest_range(points: DataFrame, ranges: DataFrame, key: str, at: str, id_col: str, width: int) -> DataFrame:
    """Each point's narrowest range of the same key that holds it, ties by range id; no range gives nulls.

    ``ranges`` has start, end (null: open) and ``range_id``. Bounded ranges are cut at multiples of ``width`` and joined
    by (key, cell), so that a key with many points and ranges is not one nested loop. Where no bounded range holds the
    point, of the open ranges that start at or before it the one with the smallest id does: all are equally wide.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    closed = ranges.where(F.col("end").isNotNull()).withColumn("cell", cells)
    inside = points.withColumn("cell", F.floor(F.col(at) / width)).join(closed, [key, "cell"]).where(F.col(at).between(F.col("start"), F.col("end")))
    best = inside.groupBy(id_col).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "range_id")).alias("best"))
    # an as-of join by a running minimum of the ids
    starts = ranges.where(F.col("end").isNull()).groupBy(key, "start").agg(F.min("range_id").alias("range_id"))
    both = points.select(key, F.col(at).alias("p"), F.col(id_col).alias("pid"), F.lit(1).alias("o"), F.lit(None).cast(ranges.schema["range_id"].dataType).alias("rid")).unionByName(
        starts.select(key, F.col("start").alias("p"), F.lit(None).cast(points.schema[id_col].dataType).alias("pid"), F.lit(0).alias("o"), F.col("range_id").alias("rid"))
    )
    least = F.min("rid").over(Window.partitionBy(key).orderBy("p", "o").rowsBetween(Window.unboundedPreceding, 0))
    open_ = both.withColumn("open_id", least).where("pid is not null").select(F.col("pid").alias(id_col), "open_id")
    return points.join(best, id_col, "left").join(open_, id_col, "left").withColumn("range_id", F.coalesce("best.range_id", "open_id")).drop("best", "open_id")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) of the same keys that overlap, joined by cells of
    ``width``; a pair is kept in the first cell that both touch, so it appears once."""
    lc = left.withColumn("cell", F.explode(F.sequence(F.floor(F.col("l_start") / width), F.floor(F.col("l_end") / width))))
    rc = right.withColumn("cell", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor(F.col("r_end") / width))))
    met = lc.join(rc, [*keys, "cell"]).where("l_start <= r_end and r_start <= l_end")
    return met.where(F.col("cell") == F.floor(F.greatest("l_start", "r_start") / width)).drop("cell")


def survey(files: DataFrame, known: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files (path, hash) against known documents (doc_path, doc_hash, id) and ignored (path, hash): each file's state -
    known by path, else ignored by path or hash, else moved by hash, else new - and the documents that no file has."""
    by_path = known.groupBy(F.col("doc_path").alias("path")).agg(F.min("id").alias("path_id"))
    by_hash = known.groupBy(F.col("doc_hash").alias("hash")).agg(F.min("id").alias("hash_id"))
    out = files.join(by_path, "path", "left").join(by_hash, "hash", "left")
    out = out.join(ignored.select("path", F.lit(True).alias("ip")).distinct(), "path", "left").join(ignored.select("hash", F.lit(True).alias("ih")).distinct(), "hash", "left")
    state = F.when(F.col("path_id").isNotNull(), "known").when(F.col("ip") | F.col("ih"), "ignored").when(F.col("hash_id").isNotNull(), "moved").otherwise("new")
    told = out.select("path", "hash", state.alias("state"), F.coalesce("path_id", "hash_id").alias("id"))
    orphans = known.join(files.select(F.col("path").alias("doc_path")), "doc_path", "left_anti").join(files.select(F.col("hash").alias("doc_hash")), "doc_hash", "left_anti")
    return told.unionByName(orphans.select(F.col("doc_path").alias("path"), F.col("doc_hash").alias("hash"), F.lit("orphaned").alias("state"), "id"))


#: names of more words than these are compared by their rarest words, not by sets of words
MOST_WORDS = 8


def _key(*parts: Column | str | int) -> Column:
    """96 bits that stand for a group's name."""
    told = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.struct(F.xxhash64(*told).alias("k"), F.hash(*told).alias("l"))


def _each(rows: DataFrame, *keys: Column, where: Column | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return rows.select("id", F.explode(F.array_compact(F.array(*keys))).alias("key")).select("id", "key.k", "key.l")


def _shorter(rows: DataFrame, text: str, at: str, to: str) -> DataFrame:
    """``rows`` with ``to``, their ``text`` without its letter ``at``, for each of its letters; ``first`` marks the first of
    equal neighbours, since without any of these the text is the same."""
    each = rows.where(F.length(text) > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.length(text))))
    c, i = F.col(text), F.col(at)
    letter = lambda n: F.substring(c, n, F.lit(1))
    return each.withColumns({to: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))), f"{at}_first": (i == 1) | (letter(i) != letter(i - 1))})


def _words(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Keys of what is found, and of what is asked, by sets of words: the words that two names share, and the other's number of words."""
    few = rows.select("id", F.array_sort("toks").alias("t"), F.size("toks").alias("n")).where(F.col("n").between(1, MOST_WORDS))
    masks = few.withColumn("mask", F.explode(F.sequence(F.lit(1), F.expr("cast(shiftleft(1, n) - 1 as int)"))))
    shared = masks.withColumns({"s": F.expr("array_join(filter(t, (x, i) -> (shiftright(mask, i) & 1) = 1), ' ')"), "c": F.bit_count("mask").cast("int")}).where(F.col("c") * 100 >= F.col("n") * percent)
    most = F.floor(F.col("c") * 100 / percent).cast("int") + F.col("c") - F.col("n")
    asked = shared.withColumn("m", F.explode(F.sequence("c", F.greatest(F.col("c"), F.least(most, F.lit(MOST_WORDS))))))
    return _each(shared, _key("t", F.col("n"), F.col("s"))), _each(asked, _key("t", F.col("m"), F.col("s")))


def _many_words(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, other) that may be near, of which one at least has more than ``MOST_WORDS`` words: they share one of their rarest words."""
    least = -(-(MOST_WORDS + 1) * percent // 100)
    each = rows.where(F.size("toks") >= least).select("id", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    often = each.groupBy("tok").agg(F.count("*").alias("k"))
    ordered = each.join(often.hint("merge"), "tok").groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("k", "tok"))).alias("order"))
    first = ordered.select("id", "n", F.explode(F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))["tok"]).alias("tok"))
    met = first.where(F.col("n") > MOST_WORDS).join(first.select(F.col("id").alias("other"), F.col("n").alias("m"), "tok").hint("merge"), "tok")
    met = met.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return met.select("id", "other").unionByName(met.select(F.col("other").alias("id"), F.col("id").alias("other")))


def similar_names(people: DataFrame, percent: int = 50, top: int = 3) -> DataFrame:
    """Each person's up to ``top`` likely duplicates (id, other, score): equal bar number 1, equal e-mail .95, edit distance of at most 2, or
    a token Jaccard of ``percent``. ``people`` has id, name and email, and may have bar;
    a null or blank number or e-mail is equal to none.

    No person is compared with all others, nor with all of a group. Candidates come from groups whose members score at least
    what made the group: equal numbers, e-mails or names; names that are equal but for letters at the same
    one or two places, or once one or two letters are left out; names of so many words that have the same words in common. Of equal scores the
    smaller id leads, so of each group only the ``top`` smallest others count. Groups of two edits are asked only for those who have
    fewer than ``top`` better duplicates.
    """
    name = F.lower(F.trim("name"))
    filled = lambda c: F.nullif(F.trim(F.lower(c)), F.lit(""))
    bar = filled("bar") if "bar" in people.columns else F.lit(None).cast("string")
    rows = people.select("id", name.alias("name"), filled("email").alias("email"), bar.alias("bar"), F.array_distinct(F.split(name, r"\s+")).alias("toks"))
    rows = spread(rows)
    whole, when = F.col("name"), F.when
    some = [when(F.col(c).isNotNull(), _key(c[0], F.col(c))) for c in ("bar", "email", "name")]
    i, j, d, dd, first = F.col("i"), F.col("j"), F.col("d"), F.col("dd"), F.col("i_first")

    def once(of: DataFrame) -> DataFrame:
        return _shorter(of.select("id", "name"), "name", "i", "d")

    def twice(of: DataFrame) -> DataFrame:
        return _shorter(once(of), "d", "j", "dd").where(first | (j >= i))

    def meet(asked: DataFrame, held: DataFrame) -> DataFrame:
        near = held.withColumn("rank", F.dense_rank().over(Window.partitionBy("k", "l").orderBy("id"))).where(F.col("rank") <= top + 1)
        return asked.distinct().join(near.select("k", "l", F.col("id").alias("other")).hint("merge"), ["k", "l"]).where("id <> other").select("id", "other").distinct()

    a, b = rows.select("id", F.col("name").alias("an"), F.col("email").alias("ae"), F.col("bar").alias("ab"), F.col("toks").alias("at")), rows.select(F.col("id").alias("other"), F.col("name").alias("bn"), F.col("email").alias("be"), F.col("bar").alias("bb"), F.col("toks").alias("bt"))
    jac = F.size(F.array_intersect("at", "bt")) / F.size(F.array_union("at", "bt"))
    near = F.levenshtein(F.col("an"), F.col("bn"))
    score = F.greatest(F.when(F.col("ab") == F.col("bb"), 1.0), F.when(F.col("ae") == F.col("be"), 0.95), F.when(near <= 2, 0.9 - near * 0.1), F.when(jac * 100 >= percent, jac * 0.8))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(a.hint("merge"), "id").join(b.hint("merge"), "other").withColumn("score", score).where("score is not null").select("id", "other", "score")

    # at the same place another letter (w), without a letter (d)
    one = _each(once(rows), _key("w", i, d), when(first, _key("d", d)))
    of_words, asked_words = _words(rows, percent)
    held = _each(rows, *some).unionByName(of_words).unionByName(one)
    asked = _each(rows, *some, when(whole.isNotNull(), _key("d", whole))).unionByName(asked_words).unionByName(_each(once(rows), _key("w", i, d), when(first, _key("n", d))))
    found = meet(asked, held).unionByName(_many_words(rows, percent).where("id <> other")).distinct()
    sure = scored(found).where("score > 0.71").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("id")
    unsure = spread(rows.join(sure.hint("merge"), "id", "left_anti"))
    # two other letters (s), without two (y), without one and another letter (x)
    same, out = j >= i, first & (j >= i)
    held = _each(twice(rows), when(first, _key("x", j, dd)), when(same, _key("s", i, j, dd)), when(out, _key("y", dd))).unionByName(one).unionByName(_each(rows, when(whole.isNotNull(), _key("n", whole))))
    asked = _each(twice(unsure), when(first, _key("w", j, dd)), when(same, _key("s", i, j, dd)), when(out, _key("n", dd)))
    asked = asked.unionByName(_each(once(unsure), _key("x", i, d), when(first, _key("d", d)))).unionByName(_each(unsure, when(whole.isNotNull(), _key("y", whole))))
    every = scored(found.unionByName(meet(asked, held)).distinct())
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return every.withColumn("rank", rank).where(F.col("rank") <= top).select("id", "other", "score", "rank")


def overlapping_labels(spans: DataFrame, turns: DataFrame, width: int = 8) -> DataFrame:
    """(id, labels) of the ``spans`` (scope, id, start, stop) that overlap ``turns`` (scope, label, start, stop): whose they are, in order.

    A null stop is open: it ends with the last line that its scope tells. Null scopes, starts and labels tell nothing;
    a span without a turn is not listed. Ends count as inside.
    """
    both = spans.select("scope", "start", "stop").unionByName(turns.select("scope", "start", "stop"))
    last = both.groupBy("scope").agg(F.max(F.greatest("start", "stop")).alias("last"))
    ended = lambda df: df.where("start is not null").join(last, "scope").withColumn("stop", F.coalesce("stop", F.greatest("start", "last")))
    left = ended(spans).select("scope", "id", F.col("start").alias("l_start"), F.col("stop").alias("l_end"))
    right = ended(turns.where("label is not null")).select("scope", "label", F.col("start").alias("r_start"), F.col("stop").alias("r_end"))
    met = overlapping(left, right, ["scope"], width)
    return met.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def first_range(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first range of its group's list that holds each point: ``points`` (key, scope, at) with ``label``, null without one.

    ``ranges`` has scope, start, stop, place (in the list) and label; a null stop is open, a null start or scope holds
    nothing, and of equal places the smaller label wins. Ranges may be nested and tied. Each is cut into at most two
    cells a level of a binary tree over the places of points, of which a cell keeps its first range only; a point asks the one cell
    of each level that holds it. So neither many ranges over one point nor one long range multiply rows. Cells are joined by
    shuffles: they are many more than the files that Spark judges their size by, and would be broadcast by that.
    """
    span = points.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, high = (span["low"] or 0), (span["high"] or 0)
    levels = max(1, (high - low + 1).bit_length())
    a = F.greatest(F.col("start") - low, F.lit(0))
    b = F.least(F.coalesce(F.col("stop"), F.lit(high)), F.lit(high)) - low + 1  # half open
    cells = []
    for n in range(levels + 1):
        left, right = F.shiftright(a + ((1 << n) - 1), n), F.shiftright(b, n)
        cells.append(F.when((left < right) & (left % 2 == 1), F.struct(F.lit(n).alias("level"), left.alias("cell"))))
        cells.append(F.when((left < right) & (right % 2 == 1), F.struct(F.lit(n).alias("level"), (right - 1).alias("cell"))))
    cut = ranges.where("scope is not null and start is not null").select("scope", "place", "label", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    first = cut.groupBy("scope", "c.level", "c.cell").agg(F.min(F.struct("place", "label")).alias("best"))
    asked = points.where("at is not null and scope is not null").select("key", "scope", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col("at") - low, n).alias("cell")) for n in range(levels + 1)])).alias("c"))
    found = asked.select("key", "scope", "c.level", "c.cell").join(first.hint("merge"), ["scope", "level", "cell"]).groupBy("key").agg(F.min("best").alias("best"))
    return points.join(found, "key", "left").select("key", F.col("best.label").alias("label"))


#: letters of the parts by which texts find values
PART_SIZES = (1, 2, 3, 4, 6)


def resolve(asked: DataFrame, fields: DataFrame, limit: int = 5, gap: float = 0.15) -> DataFrame:
    """The records that a short text may mean: ``text``, ``rank``, ``kind``, ``id``, ``matched_on``, ``confidence``, ``ambiguous``.

    ``fields`` has kind, id, field, value, priority and the confidences exact, prefix and substring, one row a field of
    a record; a record counts by its best field, of equal ones by the smaller priority. ``ambiguous`` tells that the
    second of all candidates is within ``gap`` of the first, also where ``limit`` cuts it off. Case and outer blanks do
    not count; texts and values that are null or blank match nothing; repeated texts are answered once.

    A text can only stand in values that hold its rarest part of 1, 2, 3, 4 or 6 letters, the longest such size that it
    has, so it meets these and no others; all its parts must occur somewhere. A value has many parts, which its file's
    size does not tell; so they are joined by shuffles and never broadcast.
    """
    q = asked.select("text", F.lower(F.trim("text")).alias("q")).where("q <> ''").distinct()
    v = fields.withColumn("v", F.lower(F.trim("value"))).where("v <> ''")
    parts = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    whole = lambda n: F.when(F.length("v") >= n, parts(F.col("v"), n)).otherwise(F.array().cast("array<string>"))
    index = v.select("kind", "id", "field", "priority", "v", "exact", "prefix", "substring", F.explode(F.flatten(F.array(*map(whole, PART_SIZES)))).alias("part"))
    df = index.groupBy("part").agg(F.count("*").alias("n"))
    own = F.coalesce(*[F.when(F.length("q") >= n, parts(F.col("q"), n)) for n in reversed(PART_SIZES)])
    mine = q.select("text", "q", F.explode(own).alias("part"))
    rarest = mine.join(df.hint("merge"), "part", "left").groupBy("text", "q").agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.count("n").alias("known"), F.count("*").alias("all")).where(F.col("known") == F.col("all"))
    hit = rarest.join(index.hint("merge"), "part").where(F.contains("v", F.col("q")))
    sure = F.when(F.col("v") == F.col("q"), F.col("exact")).when(F.startswith("v", F.col("q")), F.col("prefix")).otherwise(F.col("substring"))
    by_record = hit.withColumn("confidence", sure).groupBy("text", "kind", "id").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "priority", "field")).alias("best"))
    told = by_record.select("text", "kind", "id", F.col("best.field").alias("matched_on"), (-F.col("best.minus")).alias("confidence"))
    w = Window.partitionBy("text").orderBy(F.desc("confidence"), "kind", "id")
    top = told.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(limit, 2))
    leads = Window.partitionBy("text")
    second = F.max(F.when(F.col("rank") == 2, F.col("confidence"))).over(leads)
    near = F.round(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).over(leads) - second, 9) <= gap
    return top.withColumn("ambiguous", F.coalesce(near, F.lit(False))).where(F.col("rank") <= limit).select("text", "rank", "kind", "id", "matched_on", "confidence", "ambiguous")


def first_per(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The ``value`` of each key's first row."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))
