"""Joins of many rows with one row for each key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.runtime import parallelism

#: A key is hot if it has more than a share of 1/HOT of all rows: so there are fewer than HOT hot keys, and they may be broadcast.
HOT = 1000
#: A hot key's rows are dealt to so many keys at most.
SALTS = 64


def joined(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with one, which has a row for each key.

    Keys are counted first, by partial sums. The rows of hot ones are dealt out over salted keys, for which one's row is
    repeated. Only the hot keys themselves are broadcast: fewer than HOT. Null keys meet none.
    """
    salts = max(1, min(SALTS, parallelism(rows.sparkSession)))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = counts.where(F.col("__n") > max(1, total // HOT)).select(*keys, F.lit(True).alias("__hot"))
    zero, long = F.lit(0).cast("long"), lambda n: F.lit(n).cast("long")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), long(salts))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), spread).when(F.col(f"`{keys[0]}`").isNull(), spread).otherwise(zero)).drop("__hot")
    right = one.join(F.broadcast(hot), keys, "left")
    right = right.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(zero, long(salts - 1))).otherwise(F.array(zero)))).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
