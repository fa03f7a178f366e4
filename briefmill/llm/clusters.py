"""Groups of near-equal sets: band buckets, exact confirmation and a distributed union-find, all in DataFrame operations.

Within a bucket no pairs are enumerated: its members meet one pivot a round, and only members that are still in other
components than the pivot. Random pivots over many buckets join a family after a few rounds. What remains are buckets
that hold several components. The members of small ones meet each other; those of all others go through an exact
similarity join by their rarest items, which loses no link.

No two rows meet, in any of these joins, unless their sizes and sketches leave a link possible. A sketch has a bit for
each of its places, set if an odd number of a set's items fall there. Two sketches differ in as many places as the items
outside both sets' common ones fall an odd number of times on, so in no more than there are such items: the bound holds
for any hash, and members of a family of texts that are nearly but not quite similar enough are told apart before they
make a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from briefmill.llm.scratch import broadcast_if_small, discard, settle

#: buckets of up to so many rows are compared in full
FEW = 12


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps; each is a group-by with partial aggregation over a settled edge table,
    until every edge leads to an end that no edge leaves and every id has one edge.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = settle(small)
        discard(now, large)
        now = small
        ends = now.groupBy(F.col("b").alias("a")).agg(F.lit(2).alias("n"))
        if now.groupBy("a").agg(F.count("*").alias("n")).unionByName(ends).groupBy("a").agg(F.sum("n").alias("n")).where("n > 1 and n <> 2").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def shared_buckets(bands: DataFrame, one_shuffle: bool = False) -> DataFrame:
    """The rows (key, id) of ``bands`` whose key has several ids.

    By default the keys are aggregated first, so that a hot key costs no task more than its share; ``one_shuffle`` sends
    the rows once and looks at each key in a window, which halves the shuffled bytes but gives a key to one task.
    """
    if one_shuffle:
        from pyspark.sql import Window

        by = Window.partitionBy("key")
        return bands.select("key", "id", F.min("id").over(by).alias("lo"), F.max("id").over(by).alias("hi")).where("lo <> hi").select("key", "id")
    many = bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    return bands.join(many, "key", "left_semi")


def jaccard_at_least(x: Column | str, y: Column | str, percent: int) -> Column:
    """Each side is named once more than it is intersected: the sets meet only if their sizes allow it, and only once."""
    both, least = F.size(x) + F.size(y), F.least(F.size(x), F.size(y))
    # 100 * common >= percent * (both - common)
    return F.when(least * (100 + percent) >= both * percent, F.size(F.array_intersect(x, y)) * (100 + percent) >= both * percent).otherwise(False)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (id, items) have 100 * intersection >= percent * union."""
    held = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return held.where(jaccard_at_least("x", "y", percent)).select("a", "b")


def link(buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], items: Callable[[DataFrame], DataFrame], percent: int, rounds: int = 2, few: int = FEW, known: DataFrame | None = None, at_once: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """A settled table (id, component) of all ids that have a link; ``buckets`` is a settled table (key, id).

    ``confirm`` takes distinct pairs (a, b) and returns those that are links. ``items`` takes a table (id) and
    returns (id, items) with the sets of its ids. ``known`` are links (a, b) that need no confirmation. With ``at_once``,
    ``buckets`` also has ``n``, the number of a key's rows; all ids get sketches at first, and all rows of keys with up to
    so many meet in the first round, which spares them the later ones. Pivots meet first in the other buckets, then in the finer keys of those that still hold several components; there, at last, all pairs
    across components are decided.
    """
    found: DataFrame | None = None
    fits = _may_be_near(percent)

    def add(new: DataFrame) -> None:
        """Later links join components, so only these are looked at: a table of components that changed, not of all ids."""
        nonlocal found
        new = settle(new)
        if found is None:
            found = settle(components(new))
        elif not new.isEmpty():
            before, known_ones = found, broadcast_if_small(found)
            label = lambda end: known_ones.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
            ends = new.join(label("a"), "a", "left").join(label("b"), "b", "left")
            ends = settle(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
            if not ends.isEmpty():
                moved = settle(components(ends))
                to = broadcast_if_small(moved.select(F.col("id").alias("component"), F.col("component").alias("to")))
                same = before.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                found = settle(same.unionByName(moved.join(known_ones.select("id"), "id", "left_anti")))
                discard(before, moved)
            discard(ends)
        discard(new)

    def labelled(rows: DataFrame) -> DataFrame:
        """``rows`` with the component ``c`` of each ``id``."""
        if found is None:
            return rows.withColumn("c", F.col("id"))
        return rows.join(broadcast_if_small(found), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def mixed_of(rows: DataFrame) -> DataFrame:
        """The ``rows`` of keys with several components."""
        many = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        return rows.join(many, "key", "left_semi")

    def by_id(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.collect_list("key").alias("keys"))

    def spread(told: DataFrame) -> DataFrame:
        """A settled table of the rows (key, id, c, ...) of ``told``, which has one row an id, so that labels and sketches are joined once an id."""
        rows = labelled(told)
        rest = [c for c in rows.columns if c != "keys"]
        rows = rows.select(*rest, F.explode("keys").alias("key"))
        if isinstance(told.schema["keys"].dataType.elementType, StructType):
            rows = rows.select("key.*", *rest)
        return settle(mixed_of(rows))

    def pairs(left: DataFrame, right: DataFrame, more: Column) -> DataFrame:
        left, right = _no_nulls(left), _no_nulls(right)
        right = right.select("key", *[F.col(c).alias(f"_{c}") for c in right.columns if c != "key"])
        met = left.join(right, (left["key"] == right["key"]) & more)
        return met.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"))

    def pivots_of(rows: DataFrame, n: int) -> DataFrame:
        every = F.struct(*[c for c in rows.columns if c != "key"])
        return rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(n)).alias("o"), every.alias("p"))).alias("m")).select("key", "m.p.*")

    def meet_pivots(rows: DataFrame, n: int, more: Column) -> None:
        add(confirm(pairs(rows, pivots_of(rows, n), (F.col("c") != F.col("_c")) & more).distinct()))

    def may_be_near(some: DataFrame) -> DataFrame:
        """The pairs (a, b) that their sketches leave possible."""
        one = _no_nulls(sketches).withColumn("at", F.lit(0))
        other = one.select(*[F.col(c).alias(f"_{c}") for c in one.columns])
        return some.join(one.withColumnRenamed("id", "a"), "a").join(other.withColumnRenamed("_id", "b"), "b").where(fits).select("a", "b")

    if known is not None:
        add(known)
    if at_once:
        ids = ids or settle(buckets.select("id").distinct())
        sketches = settle(_sketches(items(ids)))
        small, buckets = buckets.where(F.col("n") <= at_once).select("key", "id"), buckets.where(F.col("n") > at_once).select("key", "id")
        first = pairs(small, small, F.col("id") < F.col("_id"))
        if rounds:
            first = first.unionByName(pairs(buckets, pivots_of(buckets, 0), F.col("id") != F.col("_id")))
        add(confirm(may_be_near(first.distinct())))
    elif rounds:
        meet_pivots(mixed_of(labelled(buckets)), 0, F.lit(True))
    mixed = spread(by_id(buckets))
    if not at_once:
        # most ids are done with by now; only those of keys with several components get sketches
        ids = settle(mixed.select("id").distinct())
        sketches = settle(_sketches(items(ids)))
    told = settle(by_id(mixed).join(broadcast_if_small(sketches, SKETCHES), "id").withColumn("at", F.lit(0)))
    for n in range(1, rounds):
        rows = spread(told)
        meet_pivots(rows, n, fits)
        discard(rows)
    rows = spread(told)
    sizes = settle(rows.groupBy("key").agg(F.count("*").alias("n")))
    small = rows.join(sizes.where(F.col("n") <= few), "key", "left_semi")
    met = pairs(small, small, (F.col("c") < F.col("_c")) & fits)
    many = settle(rows.join(sizes.where(F.col("n") > few), "key", "left_semi").select("id").distinct())
    if not many.isEmpty():
        finer = settle(finer_keys(many, items, percent).join(broadcast_if_small(sketches, SKETCHES), "id"))
        for n in range(min(rounds, 1)):
            item_rows = spread(finer)
            meet_pivots(item_rows.drop("before"), n, fits)
            discard(item_rows)
        item_rows = spread(finer)
        # a pair meets where no common item stands before: it has met there
        met = met.unionByName(pairs(item_rows, item_rows, (F.col("c") < F.col("_c")) & fits & ~F.arrays_overlap("before", "_before")))
        add(confirm(met.distinct()))
        discard(finer, item_rows)
    else:
        add(confirm(met.distinct()))
    discard(mixed, ids, sketches, told, rows, sizes, many)
    return found


#: words of 64 bits in a sketch
WORDS = 16
#: items that one exploded row takes
_STEP = 8
#: so many sketches may be broadcast: about 40 MB
SKETCHES = 200_000
#: so many items that stand before a common one are looked at
BEFORE = 8


def _no_nulls(rows: DataFrame) -> DataFrame:
    """The same ``rows`` with columns that Spark knows to hold no nulls, which makes code for a condition short enough to be compiled."""
    none = {"bigint": F.lit(0).cast("long"), "int": F.lit(0), "array<bigint>": F.array().cast("array<long>")}
    return rows.select(*[F.coalesce(c, none[kind]).alias(c) for c, kind in rows.dtypes])


def _sketches(sets: DataFrame) -> DataFrame:
    """(id, size, map0, ...): the sizes and sketches of the ``sets`` (id, items)."""
    each = sets.select("id", "items", F.explode(F.sequence(F.lit(0), F.greatest(F.size("items") - 1, F.lit(0)), F.lit(_STEP))).alias("from"))
    at = lambda j: F.when(F.col("from") + j < F.size("items"), F.pmod(F.xxhash64(F.get("items", F.col("from") + j)), F.lit(64 * WORDS)).cast("int"))
    places = [at(j).alias(f"p{j}") for j in range(_STEP)]
    each = each.select("id", F.size("items").alias("size"), *places)
    # places beyond the last item are null
    word, bit = (lambda j: F.coalesce(F.shiftright(f"p{j}", 6), F.lit(-1))), (lambda j: F.expr(f"shiftleft(1L, coalesce(p{j}, 0) % 64)"))
    each = each.select("id", "size", *[word(j).alias(f"w{j}") for j in range(_STEP)], *[bit(j).alias(f"b{j}") for j in range(_STEP)])
    none = F.lit(0).cast("long")
    odd = lambda w: reduce(Column.bitwiseXOR, [F.when(F.col(f"w{j}") == w, F.col(f"b{j}")).otherwise(none) for j in range(_STEP)])
    maps = [F.bit_xor(odd(w)).alias(f"map{w}") for w in range(WORDS)]
    return each.groupBy("id").agg(F.max("size").alias("size"), *maps)


def _may_be_near(percent: int) -> Column:
    """What the common item's places and the sketches of two rows leave possible."""
    both = F.col("size") + F.col("_size")
    odd = reduce(Column.__add__, [F.bit_count(F.col(f"map{w}").bitwiseXOR(F.col(f"_map{w}"))) for w in range(WORDS)])
    behind = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    return (behind * (100 + percent) >= both * percent) & (odd * (100 + percent) <= both * (100 - percent))


def finer_keys(ids: DataFrame, items: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, keys): the sets of the settled ``ids`` by items; ``keys`` has a struct (key, at, before) for each item that it meets others by.

    Items are ordered by their number of sets, and of two similar sets each has a common item among its first
    n - ceil(n * percent / 100) + 1. So sets meet by those alone, and ``at`` bounds how similar they can be: what is
    left behind the common item. ``before`` has the items that stand next before it.
    """
    each = settle(items(ids)).select("id", F.explode("items").alias("item"))
    often = broadcast_if_small(settle(each.groupBy("item").agg(F.count("*").alias("k")).where("k > 1")))
    ordered = each.join(often, "item", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "item"))).alias("order"))
    first = F.slice("order", F.lit(1), (F.size("order") - F.ceil(F.size("order") * percent / 100) + 1).cast("int"))
    before = lambda at: F.slice("first", F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE))).getField("item")
    keyed = F.transform("first", lambda x, at: F.when(x["k"] > 1, F.struct(x["item"].alias("key"), at.alias("at"), before(at).alias("before"))))
    return ordered.select("id", first.alias("first")).select("id", F.filter(keyed, lambda x: x.isNotNull()).alias("keys"))
