"""Changes of stored Parquet tables: rows that come, go or are stamped, and the rewriting of what changed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may differ in their columns; a column that a file lacks is null there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Add files of ``rows``, with whatever columns they have, in the partitions of ``partition``."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def appended(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' rows with the columns of either."""
    return rows.unionByName(more, allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` less those whose ``keys``, all not null, are in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def stamped(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``updates``, which has at most one row a key; a null there, or no row, changes nothing.

    Columns that ``rows`` lacks are added. Other rows and the columns' order stay.
    """
    new = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key), *[F.col(c).alias(f"_u_{c}") for c in new])
    told = rows.join(u, key, "left")
    value = lambda c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) if c in rows.columns else F.col(f"_u_{c}")
    return told.select(*[value(c).alias(c) if c in new else F.col(c) for c in rows.columns], *[value(c).alias(c) for c in new if c not in rows.columns])


def rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``rows`` has and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete(spark: SparkSession, path: str, partition: str, gone: DataFrame, keys: Sequence[str]) -> None:
    """Rewrite the partitions of a stored table in which ``gone`` (``partition`` and ``keys``) names rows, without those.

    Only these partitions are read. Partition values may be null and hold any sign; null keys name no row. Rows that
    repeat a key all go. A partition that loses all its rows loses its files: first the partitions with rows left are
    rewritten, then those files are deleted, so that a failure between leaves rows that the same call deletes again.
    """
    table = read_evolving(spark, path)
    named = gone.select(partition, *keys).distinct()
    touched = named.select(F.col(partition).alias("_p")).distinct()  # one row a partition that the delete touches
    hit = table.withColumn("_file", F.col("_metadata.file_path")).join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    same = F.col(partition).eqNullSafe(F.col("_g"))
    for k in keys:
        same &= F.col(k) == F.col(f"_g_{k}")
    left = hit.join(named.select(F.col(partition).alias("_g"), *[F.col(k).alias(f"_g_{k}") for k in keys]), same, "left_anti")
    emptied = hit.join(left.select(F.col(partition).alias("_p")).distinct(), F.col(partition).eqNullSafe(F.col("_p")), "left_anti")
    files = [r[0] for r in emptied.select("_file").distinct().collect()]  # of the partitions that lose all their rows
    rewrite(left.select(*table.columns), path, partition)
    for name in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def any_of(columns: Sequence[str], value) -> Column:
    """Whether any of the ``columns`` equals ``value``."""
    return reduce(Column.__or__, [F.col(c).eqNullSafe(F.lit(value)) for c in columns])
