"""Scaling runs: rows (n_workers, t_total, t_map, t_reduce, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscount.functions.forms import amdahl

def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs that ended, by number of workers; an error if there is none."""
    ok = runs.where("t_total is not null")
    if not ok.limit(1).count():
        raise ValueError("no run has a total time")
    return ok.orderBy("n_workers")


def speedup(runs: DataFrame) -> DataFrame:
    """Adds ``baseline`` (the total of one worker, or else of the fewest) and ``speedup``; and ``speedup_adj``, without the longest
    download, where every run has t_map_adj."""
    whole = W.partitionBy(F.lit(0))
    fewest = whole.orderBy(F.when(F.col("n_workers") == 1, 0).otherwise(1), "n_workers").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = runs.where("t_total is not null").withColumn("baseline", F.first("t_total").over(fewest)).withColumn("speedup", F.col("baseline") / F.col("t_total"))
    if "t_map_adj" not in runs.columns:
        return out
    adj = F.col("t_total") - F.coalesce(F.col("t_download_max"), F.lit(0.0))
    least = whole.orderBy("n_workers").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    has = F.bool_and(F.col("t_map_adj").isNotNull()).over(whole)
    return out.withColumn("speedup_adj", F.when(has, F.first(adj).over(least) / adj))


#: Places of a grid, and how much closer together they are in the next one.
GRID, FINER = 1000, (1 / 1000, 1 / 400_000, 1 / 160_000_000)


def serial_fit(runs: DataFrame) -> DataFrame:
    """One row (f): the serial fraction in [0, 1] whose law is nearest to the speedups by least squares.

    Three grids of GRID + 1 places, each around the best place of the one before. Every run meets the places of a grid in its own
    task, and squared distances are summed by place: only one row goes from grid to grid.
    """
    rows = speedup(runs).select("n_workers", "speedup")
    best = None
    for step in FINER:
        steps = F.sequence(F.lit(0), F.lit(GRID)) if best is None else F.sequence(F.lit(-GRID // 2), F.lit(GRID // 2))
        around = rows.withColumn("at", F.lit(0.0)) if best is None else rows.join(F.broadcast(best.withColumnRenamed("f", "at")))  # one row
        places = around.select("n_workers", "speedup", F.explode(F.transform(steps, lambda i: F.col("at") + i / F.lit(1 / step))).alias("f")).where("f between 1e-12 and 1")
        off = amdahl(F.col("n_workers"), F.col("f")) - F.col("speedup")
        sums = places.groupBy("f").agg(F.sum(off * off).alias("e"))
        best = sums.agg(F.min_by("f", F.struct("e", "f")).alias("f")).where("f is not null")
    return best


def fit_serial(runs: DataFrame) -> float:
    return float(serial_fit(runs).first()["f"])


def amdahl_fit(runs: DataFrame) -> DataFrame:
    """One row: serial fraction and the speedup that it bounds."""
    return serial_fit(runs).select(F.round("f", 6).alias("serial_fraction"), F.round(1 / F.col("f"), 4).alias("max_speedup"))


def curve(runs: DataFrame, serial: float) -> DataFrame:
    return speedup(runs).select("n_workers", "speedup", amdahl(F.col("n_workers"), serial).alias("amdahl"))


def phase_breakdown(runs: DataFrame) -> DataFrame:
    """(n_workers, phase, seconds, percent) of mapping, reducing and the rest of each run: what a stacked figure shows."""
    rest = F.greatest(F.col("t_total") - F.col("t_map") - F.col("t_reduce"), F.lit(0.0))
    parts = F.array(*[F.struct(F.lit(p).alias("phase"), c.alias("seconds")) for p, c in (("map", F.col("t_map")), ("reduce", F.col("t_reduce")), ("other", rest))])
    rows = runs.where("t_total is not null").select("n_workers", "t_total", F.explode(parts).alias("p"))
    return rows.select("n_workers", "p.phase", "p.seconds", F.when(F.col("t_total") > 0, 100.0 * F.col("p.seconds") / F.col("t_total")).alias("percent"))


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the least total time; of equal ones that with the fewest workers."""
    return runs.where("t_total is not null").orderBy("t_total", "n_workers").limit(1)


def phase_durations(marks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(t_total, t_map, t_reduce) from the times at which a run began, ended mapping and ended."""
    return marks.select(*(keep or []), F.round(F.col("t_end") - F.col("t_start"), 3).alias("t_total"), F.round(F.col("t_map_end") - F.col("t_start"), 3).alias("t_map"), F.round(F.col("t_end") - F.col("t_map_end"), 3).alias("t_reduce"))


def worker_sums(records: DataFrame) -> DataFrame:
    """One row: the sum of every time in workers' records, and the longest download. Times that a record lacks count as 0."""
    names = ["t_download", "t_clean", "t_io_read", "t_compute", "t_io_write", "t_shuffle"]
    return records.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names], F.coalesce(F.max("t_download"), F.lit(0.0)).alias("t_download_max"))
