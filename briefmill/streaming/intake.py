"""Plans over streams; each takes and returns a streaming DataFrame and works on a static one as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.sources import stored


def new_files(files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Files (path, hash, ...) that were not seen before by their hash and that no tombstone (path, hash) names by either.

    The state is one row a hash; a tombstone that is added later holds from the next start of the query on.
    """
    fresh = files.dropDuplicates(["hash"])
    dead = lambda c: tombstones.where(F.col(c).isNotNull()).select(F.col(c).alias(f"_t_{c}")).distinct()
    for c in ("path", "hash"):
        gone = dead(c)
        fresh = fresh.join(gone, fresh[c] == gone[f"_t_{c}"], "left_anti")
    return fresh.withColumn("status", F.lit("DISCOVERED"))


def latest_status(changes: DataFrame) -> DataFrame:
    """(id, seq, status) by id, from changes in any order and with replays: the one with the highest sequence number.

    For update mode. A tie of sequence numbers goes to the greater status, so that every replay ends the same.
    """
    last = F.max(F.struct("seq", "status")).alias("last")
    return changes.groupBy("id").agg(last).select("id", "last.seq", "last.status")


def confirmed(changes: DataFrame) -> DataFrame:
    """(link, confirmed): the highest sequence number of each link, which never falls."""
    return changes.groupBy("link").agg(F.max("seq").alias("confirmed"))


def event_rates(events: DataFrame, window: str = "10 seconds", slide: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """(start, n) of sliding windows over ``ts``; a window is final once the watermark, ``late`` behind, has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def promote(batch: DataFrame, known: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """``known`` (id, status) after the promotions asked for in ``batch`` (id, want): guarded, only from ``allowed[want]``.

    A document that has moved on meanwhile keeps its status, so a batch that is replayed changes nothing.
    """
    ask = batch.groupBy("id").agg(F.max("want").alias("want"))
    needs = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])
    fits = known.join(ask, "id").where(F.col("status") == needs[F.col("want")])
    return stored.stamped(known, fits.select("id", F.col("want").alias("status")), "id")
