"""Timing records of real jobs, from Spark's own event log.

A listener writes the events of the jobs run under event_log() to the shared folder, in Spark's public format; all that
follows are DataFrames over those lines, so logs of any application and any length are read the same way. A task that read
no shuffle counts as MAP, one that read a shuffle as REDUCE.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.operators.scaling import phase_durations, worker_sums
from corpuscount.runtime import shared_dir
from corpuscount.sources.sinks import files_of

#: The property by which a run's jobs are known in a log that others write to as well.
MARK = "corpuscount.run"
_TASK = """`Stage ID` int, `Stage Attempt ID` int, `Task End Reason` struct<Reason: string>,
`Task Info` struct<Index: int, `Launch Time`: long, `Finish Time`: long, Accumulables: array<struct<Name: string, Update: string>>>,
`Task Metrics` struct<`Executor Run Time`: long, `Input Metrics`: struct<`Records Read`: long>, `Output Metrics`: struct<`Records Written`: long>,
 `Shuffle Read Metrics`: struct<`Fetch Wait Time`: long, `Total Records Read`: long, `Remote Blocks Fetched`: long, `Local Blocks Fetched`: long>,
 `Shuffle Write Metrics`: struct<`Shuffle Write Time`: long, `Shuffle Records Written`: long>>"""
_JOB = f"`Job ID` int, `Submission Time` long, `Completion Time` long, `Stage IDs` array<int>, Properties struct<`{MARK}`: string>"


@contextmanager
def event_log(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Writes the events of what runs inside to a log; gives its path, which holds the whole log once the block has ended.

    Events of other jobs that run at the same time are in it too; job_tasks() tells them apart by the path.
    """
    sc = spark.sparkContext
    jvm, context = spark._jvm, sc._jsc.sc()
    folder, name = folder or shared_dir(spark), f"run-{uuid.uuid4().hex}"
    fs, root = files_of(spark, folder)
    fs.mkdirs(root)
    conf = context.conf().clone().set("spark.eventLog.rolling.enabled", "false").set("spark.eventLog.compress", "false")
    listener = jvm.org.apache.spark.scheduler.EventLoggingListener(name, jvm.scala.Option.empty(), fs.makeQualified(root).toUri(), conf, sc._jsc.hadoopConfiguration())
    path = f"{folder.rstrip('/')}/{name}"
    before = sc.getLocalProperty(MARK)
    listener.start()
    context.addSparkListener(listener)
    sc.setLocalProperty(MARK, path)
    try:
        yield path
    finally:
        sc.setLocalProperty(MARK, before)
        context.listenerBus().waitUntilEmpty()
        context.removeSparkListener(listener)
        listener.stop()


def _events(spark: SparkSession, log: str, name: str, schema: str) -> DataFrame:
    lines = spark.read.text(log).where(F.col("value").startswith(f'{{"Event":"SparkListener{name}"'))
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def job_tasks(spark: SparkSession, log: str, run: str | None = None) -> DataFrame:
    """One row for each task that an event log's jobs needed: phase, stage_id, task, began, ended (ms) and its times (s) and rows.

    Failed and killed attempts don't count, and of several that succeeded (speculation, a stage run again) only the last. run:
    only jobs of that event_log() block.
    """
    e = _events(spark, log, "TaskEnd", _TASK).where("`Task End Reason`.Reason = 'Success'")
    if run:
        stages = _events(spark, log, "JobStart", _JOB).where(F.col(f"Properties.`{MARK}`") == run)
        e = e.join(stages.select(F.explode("`Stage IDs`").alias("Stage ID")).distinct(), "Stage ID", "left_semi")
    m, read, put = F.col("`Task Metrics`"), F.col("`Task Metrics`.`Shuffle Read Metrics`"), F.col("`Task Metrics`.`Shuffle Write Metrics`")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")

    def extra(name: str) -> Column:
        """A time that plans report beside the task's own metrics, in ms."""
        found = F.filter("`Task Info`.Accumulables", lambda a: a["Name"] == name)
        return F.aggregate(found, F.lit(0.0), lambda s, a: s + F.coalesce(a["Update"].try_cast("double"), F.lit(0.0)))

    shuffled = F.coalesce(read["Remote Blocks Fetched"], F.lit(0)) + F.coalesce(read["Local Blocks Fetched"], F.lit(0))
    rows = e.select(
        F.when(shuffled > 0, "REDUCE").otherwise("MAP").alias("phase"),
        F.col("Stage ID").alias("stage_id"), F.col("`Task Info`.Index").alias("task"), F.col("`Task Info`.`Launch Time`").alias("began"), F.col("`Task Info`.`Finish Time`").alias("ended"),
        zero(m["Executor Run Time"]).alias("run"), zero(read["Fetch Wait Time"]).alias("wait"), extra("scan time").alias("scan"), (zero(put["Shuffle Write Time"]) / 1e6 + extra("task commit time")).alias("put"),
        (F.coalesce(m["Input Metrics"]["Records Read"], F.lit(0)) + F.coalesce(read["Total Records Read"], F.lit(0))).alias("rows_in"),
        (F.coalesce(m["Output Metrics"]["Records Written"], F.lit(0)) + F.coalesce(put["Shuffle Records Written"], F.lit(0))).alias("rows_out"),
    )
    last = rows.groupBy("stage_id", "task").agg(F.max_by(F.struct(*rows.columns[3:], "phase"), "ended").alias("x")).select("stage_id", "task", "x.*")
    # what is measured beside one another may exceed the task's own time by a little
    part = lambda c, rest: F.least(F.col(c), rest)
    run_, wait = F.col("run"), part("wait", F.col("run"))
    scan = part("scan", run_ - wait)
    put_ = part("put", run_ - wait - scan)
    seconds = {"t_shuffle": wait, "t_io_read": scan, "t_io_write": put_, "t_compute": run_ - wait - scan - put_}
    return last.select("phase", "stage_id", "task", "began", "ended", *[F.round(c / 1000, 3).alias(n) for n, c in seconds.items()], "rows_in", "rows_out")


def worker_timings(tasks: DataFrame) -> DataFrame:
    """Tasks as workers' records: phase, split_id or reducer_id, the times of its steps, rows_in, rows_out.

    Spark downloads and cleans in the same pass as it computes: those times are 0.
    """
    task = lambda phase: F.when(F.col("phase") == phase, F.col("task"))
    none = F.lit(0.0)
    return tasks.select("phase", "stage_id", task("MAP").alias("split_id"), task("REDUCE").alias("reducer_id"), none.alias("t_download"), none.alias("t_clean"), "t_io_read", "t_compute", "t_io_write", "t_shuffle", "rows_in", "rows_out")


def job_timing(tasks: DataFrame) -> DataFrame:
    """One row: t_total, t_map, t_reduce of a run: from its first task's beginning to the last MAP task's end, and to the last end."""
    marks = tasks.agg((F.min("began") / 1000).alias("t_start"), (F.max(F.when(F.col("phase") == "MAP", F.col("ended"))) / 1000).alias("t_map_end"), (F.max("ended") / 1000).alias("t_end"))
    return phase_durations(marks.where("t_start is not null"))


def log_lines(tasks: DataFrame) -> DataFrame:
    """(value): the lines that a run's log has: a WORKER_TIMING record for each task and a TIMING record."""
    said = lambda df, mark: df.select(F.concat(F.lit(mark + ": "), F.to_json(F.struct(*df.columns))).alias("value"))
    return said(worker_timings(tasks), "WORKER_TIMING").unionAll(said(job_timing(tasks), "TIMING"))


def timed_tasks(spark: SparkSession, work: Callable[[], object]) -> DataFrame:
    """The tasks of what work() runs on this session."""
    with event_log(spark) as log:
        work()
    return job_tasks(spark, log, log)


def run_record(tasks: DataFrame, n_workers: int, n_splits: int, n_reducers: int) -> DataFrame:
    """One row in the form of scaling results: sizes, total and phase times, sums of the workers' times, the longest download."""
    sizes = [F.lit(v).alias(k) for k, v in (("n_workers", n_workers), ("n_splits", n_splits), ("n_reducers", n_reducers))]
    both = job_timing(tasks).join(worker_sums(worker_timings(tasks)))  # one row each
    return both.select(*sizes, "*", F.round(F.col("t_map") - F.col("t_download_max"), 3).alias("t_map_adj"))
