"""The tables of a folder, one Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to enough tasks for all cores, by ``keys`` if there are any: for work that is much more than the bytes
    of its rows tell, by which Spark would deal out few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
