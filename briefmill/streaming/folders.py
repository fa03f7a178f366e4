"""Batches of folder changes into a store that only grows: keyed puts, subtree drops, and acknowledgement after the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "link string, seq long, op string, path string, payload string"


def batches(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the change files (JSON lines) that senders leave in ``path``, ``files`` at a time. A folder that is the
    store's own checkpoint keeps which files were read, so that a restart goes on behind the last one."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All changes that have come, each (link, seq) once: a batch that is written again after a failure counts once."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{store}/changes")
    return rows.dropDuplicates(["link", "seq"]).drop("batch")


def current(changes: DataFrame) -> DataFrame:
    """(path, payload, link, seq): the last put of each path that no later drop of it, or of a folder above it, takes away.

    ``changes`` has link, seq, op (put or drop), path and payload; links count on their own, each by its sequence
    numbers. A row meets the drops of its own ancestors only, by equality: no path is compared with all drops.
    """
    w = Window.partitionBy("link", "path").orderBy(F.desc("seq"))
    puts = changes.where("op = 'put'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "op")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    drops = changes.where("op = 'drop'").groupBy("link", F.rtrim(F.col("path"), F.lit("/")).alias("above")).agg(F.max("seq").alias("dropped"))
    gone = puts.select("link", "path", "seq", F.explode(above).alias("above")).join(drops, ["link", "above"]).where("dropped > seq").select("link", "path").distinct()
    return puts.join(gone, ["link", "path"], "left_anti").select("path", "payload", "link", "seq")


def acknowledged(spark: SparkSession, store: str) -> DataFrame:
    """(link, seq): up to where each sender may forget its changes."""
    return spark.read.schema("link string, seq long, batch long").parquet(f"{store}/acks").groupBy("link").agg(F.max("seq").alias("seq"))


def take_in(changes: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of a stream to the store, then acknowledge its highest sequence number of each link.

    The acknowledgement is written only once the changes are; after a failure between, the batch is written and
    acknowledged again, which changes nothing. Rows without a link, number or path are left out.
    """

    def save(rows: DataFrame, number: int) -> None:
        good = rows.where("link is not null and seq is not null and path is not null and op in ('put', 'drop')").withColumn("batch", F.lit(number).cast("long"))
        good.write.mode("append").parquet(f"{store}/changes")
        good.groupBy("link").agg(F.max("seq").alias("seq"), F.max("batch").alias("batch")).write.mode("append").parquet(f"{store}/acks")

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
