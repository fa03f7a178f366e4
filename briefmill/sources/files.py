"""Files below a folder, with the hash of their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _listed(path: Column, root: str) -> Column:
    """The part of a path below ``root``, whatever the scheme in front of either."""
    bare = lambda c: F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*:/+", "/")
    return F.substring(bare(path), F.length(bare(F.lit(root.rstrip("/")))) + 2, F.lit(1 << 20))


def walk(spark: SparkSession, root: str, pattern: str = "*.pdf", depth: int = 8) -> DataFrame:
    """(path below ``root``, name, size, modified, sha256) of the files that fit ``pattern``, at most ``depth`` folders down.

    Each task reads its own files and keeps their hashes, not their bytes. Empty files hold nothing and are not listed; a
    folder without such files has no rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = _listed(F.col("path"), root)
    rows = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return rows.where(F.size(F.split("path", "/")) <= depth + 1).select("path", F.substring_index("path", "/", -1).alias("name"), "size", "modified", "sha256")


def ensured(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``known`` and, of ``wanted``, the first row in all columns of each ``key`` that it lacks; null keys are not wanted."""
    new = wanted.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in wanted.columns if c != key])).alias("_r")).select(key, "_r.*")
    return known.unionByName(first, allowMissingColumns=True)
