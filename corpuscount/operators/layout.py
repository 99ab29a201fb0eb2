"""The layout of results by reducer: crc32 of the key, and each reducer's keys by falling count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.functions.tokens import reducer


def assigned(counts: DataFrame, reducers: int) -> DataFrame:
    """(key, n, reducer_id)."""
    return counts.withColumn("reducer_id", reducer("key", reducers))


def laid_out(counts: DataFrame, reducers: int) -> DataFrame:
    """Partition r holds reducer r's keys, by falling count, ties by key."""
    return assigned(counts, reducers).repartitionById(reducers, F.col("reducer_id")).sortWithinPartitions("reducer_id", F.desc("n"), "key")


def load(counts: DataFrame, reducers: int) -> DataFrame:
    """(reducer_id, keys, total)."""
    return assigned(counts, reducers).groupBy("reducer_id").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").cast("long").alias("total"))


def split_keys(parts: DataFrame) -> DataFrame:
    """Keys that more than one reducer has, of rows (key, reducer_id): there must be none."""
    return parts.groupBy("key").agg(F.count_distinct("reducer_id").alias("reducers")).where("reducers > 1")
