"""Machines: load samples (host, l1, l5, l15; nulls where a host didn't answer) and rows of a machine list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.functions.forms import full_name, numeric_or


def by_host(samples: DataFrame) -> DataFrame:
    """Hosts that answered first, then by name."""
    return samples.orderBy(F.col("l1").isNull(), "host")


def load_summary(samples: DataFrame) -> DataFrame:
    """One row: hosts, those that answered, and the means of their loads."""
    return samples.agg(F.count(F.lit(1)).alias("hosts"), F.count("l1").alias("reachable"), *[F.avg(c).alias(f"mean_{c}") for c in ("l1", "l5", "l15")])


def usable(machines: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows ``m`` (array of strings: name, alive, figures…) that are alive, long enough, and named as one of the prefixes."""
    name: Column = F.get("m", F.lit(0))
    known = F.lit(False)
    for p in prefixes:
        known = known | name.startswith(p)
    return machines.where((F.size("m") >= 5) & F.get("m", F.lit(1)).isin("true", "1", "True") & known)


def least_occupied(machines: DataFrame, prefixes: list[str], n: int = 10, per_figure: bool = True, domain: str = "") -> DataFrame:
    """(host, score) of the n least occupied machines, ties by name; the domain follows each name. score: the sum of the three figures.

    A figure that can't be read counts as 999; with per_figure False, one such makes the whole score 999.
    """
    figures = [F.get("m", F.lit(k)) for k in (2, 3, 4)]
    if per_figure:
        score = sum((numeric_or(x) for x in figures[1:]), numeric_or(figures[0]))
    else:
        score = numeric_or((figures[0].try_cast("double") + figures[1].try_cast("double") + figures[2].try_cast("double")).cast("string"))
    return usable(machines, prefixes).select(full_name(F.get("m", F.lit(0)), domain).alias("host"), score.alias("score")).orderBy("score", "host").limit(n)
