"""Comparison of two results (key, n), key by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.functions.tokens import crc

#: Buckets of keys that have a checksum each.
BUCKETS = 1024


def matched(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, expected, actual, status) of all keys: same, differs, missing or extra.

    Both results are put one after the other and summed by key: one exchange with partial sums, no join. A key that a
    result has twice counts with the sum of its counts, as a result's reader adds up parts.
    """
    a = expected.select("key", F.col("n").cast("long").alias("expected"), F.lit(None).cast("long").alias("actual"))
    b = actual.select("key", F.lit(None).cast("long").alias("expected"), F.col("n").cast("long").alias("actual"))
    both = a.unionAll(b).groupBy("key").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    same = F.col("expected") == F.col("actual")
    return both.withColumn("status", F.when(same, "same").when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("differs"))


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, expected, actual, status): differing, missing and extra keys."""
    return matched(expected, actual).where("status <> 'same'")


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys whose count differs or is missing."""
    return diff(expected, actual).where("status <> 'extra'")


def extras(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, n) of the keys that only the actual result has."""
    return matched(expected, actual).where("status = 'extra'").select("key", F.col("actual").alias("n"))


def summary(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: distinct keys and totals of both, how many keys differ, are missing or extra, and whether all agrees."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    times = lambda s: F.count(F.when(F.col("status") == s, 1))
    # no second exchange of keys: one row from each task
    found = matched(expected, actual).agg(
        F.count("expected").alias("expected_keys"), F.count("actual").alias("actual_keys"), total("expected").alias("expected_total"), total("actual").alias("actual_total"),
        times("differs").alias("differing"), times("missing").alias("missing"), times("extra").alias("extra"),
    )
    return found.withColumn("equal", F.expr("differing + missing + extra = 0 and expected_keys = actual_keys and expected_total = actual_total"))


def bucket(key: str = "key", buckets: int = BUCKETS) -> Column:
    return F.pmod(crc(key), F.lit(buckets)).cast("int")


def checksums(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, keys, total, a, b): of each bucket of keys how many there are, their sum, and two hashes of its rows in any order.

    A written table of these stands for a result where it is compared again and again.
    """
    row = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "key", F.col("n").cast("long")))
    return counts.groupBy(bucket(buckets=buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").cast("long").alias("total"), row(1).alias("a"), row(2).alias("b"))


def differing_buckets(expected: DataFrame, actual: DataFrame) -> list[int]:
    """The buckets whose checksums aren't the same: a list of BUCKETS numbers at most."""
    both = expected.select("bucket", F.struct("keys", "total", "a", "b").alias("sum"), F.lit(1).alias("k")).unionAll(actual.select("bucket", F.struct("keys", "total", "a", "b").alias("sum"), F.lit(-1).alias("k")))
    odd = both.groupBy("bucket", "sum").agg(F.sum("k").alias("k")).where("k <> 0")
    return sorted({r["bucket"] for r in odd.select("bucket").collect()})


def diff_by_buckets(expected: DataFrame, actual: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """diff(), where only the buckets of keys whose checksums differ are compared key by key.

    Checksums need no exchange of keys: a row for each task and bucket. Of equal results nothing else is looked at. Rows that
    are equal in number, sum and both hashes (128 bits) of their bucket count as the same. Each result has a key once.
    """
    odd = differing_buckets(checksums(expected, buckets), checksums(actual, buckets))
    some = lambda df: df.where(bucket(buckets=buckets).isin(odd)) if odd else df.limit(0)
    return diff(some(expected), some(actual))


def agree(expected: DataFrame, actual: DataFrame) -> bool:
    return bool(summary(expected, actual).first()["equal"])
