"""Ordered analytics: neighbours, ranges by the next start, turns, carried values and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.sources.tables import spread


def neighbours(rows: DataFrame, group: list[str], order: list[str], text: str, before: int, after: int) -> DataFrame:
    """Each row with the texts around it in its group, whether it is the first or the last, and whether its place is
    shared by another row (``ambiguous``)."""
    w = Window.partitionBy(*group).orderBy(*order)
    around = F.collect_list(text)
    return rows.withColumns(
        {
            "before": around.over(w.rowsBetween(-before, -1)),
            "after": around.over(w.rowsBetween(1, after)),
            "at_start": F.lag(text).over(w).isNull() & (F.row_number().over(w) == 1),
            "at_end": F.lead(F.lit(1)).over(w).isNull(),
            "ambiguous": F.count("*").over(Window.partitionBy(*group, order[0])) > 1,
        }
    )


def until_next(rows: DataFrame, group: str, start: str, total: Column) -> DataFrame:
    """Sections end one before the next section's start, the last at ``total``; a start that repeats counts once."""
    w = Window.partitionBy(group).orderBy(start)
    once = rows.withColumn("_prev", F.lag(start).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(start))).drop("_prev")
    return once.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, total))


def turns(rows: DataFrame, group: str, order: str, who: str) -> DataFrame:
    """Islands of consecutive rows of one speaker: (group, island, who, first, last, rows)."""
    w = Window.partitionBy(group).orderBy(order)
    new = (~F.lag(who).over(w).eqNullSafe(F.col(who)) | F.lag(order).over(w).isNull()).cast("int")
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(group, "island", who).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def carried(rows: DataFrame, group: str, order: str, value: Column) -> Column:
    """The last value that is not null up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def lineage(edges: DataFrame, seeds: DataFrame, hops: int = 4, most: int | None = None) -> DataFrame:
    """(seed, node, depth): what each seed reaches over ``edges`` (src, dst) in either direction, in at most ``hops``.

    With ``most``, each seed keeps that many nodes, the nearest and of equal depth the smallest; they are cut after each
    hop, so a hub does not multiply, and none that is cut could have led to one that stays. A hop is one join and one
    aggregation of what was reached so far, which takes the smaller depth: the plan grows with the hops and does not double.
    Hops are dealt by seed once for the aggregation and the cut, and joined by shuffles, to as many tasks as keep a task small.
    """
    both = edges.select(F.col("src").alias("_src"), "dst").unionByName(edges.select(F.col("dst").alias("_src"), F.col("src").alias("dst"))).where("_src is not null and dst is not null").distinct()
    reached = seeds.where("id is not null").select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    near = Window.partitionBy("seed").orderBy("depth", "node")
    for _ in range(hops):
        stay, go = F.struct("node", "depth"), F.struct(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
        told = reached.join(both.hint("merge"), F.col("node") == F.col("_src"), "left").select("seed", F.explode(F.when(F.col("dst").isNull(), F.array(stay)).otherwise(F.array(stay, go))).alias("n"))
        reached = spread(told.select("seed", "n.node", "n.depth"), "seed").groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        if most is not None:
            reached = reached.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= most).drop("_rank")
    return reached


def lineage_in_scope(edges: DataFrame, nodes: DataFrame, hops: int = 4, most: int = 50) -> DataFrame:
    """(seed, node, depth, place) of each node's lineage: the other nodes of the seed's scope, by revision.

    ``nodes`` has id, scope and revision (null counts as 0). Other scopes are passed through, and not told; ``most`` counts
    all that is reached, the seed too. A node without a scope is in no one's.
    """
    found = lineage(edges, nodes.select("id"), hops, most).where("depth > 0")
    side = lambda c, *more: nodes.select(F.col("id").alias(c), F.col("scope").alias(f"_{c}"), *more).hint("merge")
    told = found.join(side("seed"), "seed").join(side("node", "revision"), "node").where(F.col("_seed") == F.col("_node"))
    order = Window.partitionBy("seed").orderBy(F.coalesce("revision", F.lit(0)), "node")
    return told.select("seed", "node", "depth", F.row_number().over(order).alias("place"))
