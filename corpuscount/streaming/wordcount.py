"""Incremental word counts: lines arrive in files, counts are kept in state, and each batch emits the keys it changed.

The changelog has a row (batch, key, n) for each key and micro-batch that changed it; the last one of a key is its
count. Batch and stream use the same token expression, so the folded changelog equals the batch result.
"""

from __future__ import annotations

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscount.functions.tokens import tokens
from corpuscount.runtime import shared_dir
from corpuscount.sources.splits import STRICT_HEADER, capped, cleaned

CHANGELOG = "batch long, key string, n long"


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, strict: bool = False) -> DataFrame:
    """Lines of the files in a folder, as they come. A Kafka source gives the same column, by ``kafka_lines``."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path)
    return lines.where(~F.col("value").rlike(STRICT_HEADER)) if strict else lines


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def publish(lines: DataFrame, folder: str, most: int = 200_000) -> None:
    """Put a crawl's lines (file, block, line_no, text) where line_stream() reads: headers out, then the first ``most`` (0: all)."""
    capped(cleaned(lines, "strict"), most).select(F.col("text").alias("value")).write.mode("append").text(folder)


def word_counts(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(tokens("value")).alias("token")).groupBy(F.lower("token").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def run(lines: DataFrame, changelog: str, checkpoint: str, timeout: float | None = None, stepwise: bool = False, records: bool = False) -> None:
    """Take all lines that are there, add what changes to the changelog, and end; go on from the checkpoint next time.

    stepwise: the source itself says how much a batch takes. records: the changelog has a row for each occurrence of a key, with
    the count that it brings about; else one for each key and batch. A batch that is run again after a failure overwrites its
    own rows. TimeoutError if lines are left after timeout seconds: those batches that ended count, and the next run goes on.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = df.select("key", "n")
        if records:
            rows = increments(rows, state_counts(df.sparkSession, checkpoint, batch - 1) if batch else None)
        rows.write.mode("overwrite").parquet(f"{changelog}/batch={batch}")

    out = word_counts(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    query = (out if stepwise else out.trigger(availableNow=True)).start()
    try:
        if not stepwise:
            ended = query.awaitTermination(timeout) if timeout is not None else query.awaitTermination() or True
        else:
            failed: list[Exception] = []
            drain = InheritableThread(target=lambda: _drained(query, failed))
            drain.daemon = True
            drain.start()
            drain.join(timeout)
            ended = not drain.is_alive()
            if failed:
                raise failed[0]
        if not ended:
            raise TimeoutError(f"lines are left after {timeout} s")
    finally:
        query.stop()


def _drained(query: StreamingQuery, failed: list[Exception]) -> None:
    try:
        query.processAllAvailable()
    except Exception as e:  # noqa: BLE001 (handed on to the thread that waits)
        failed.append(e)


def increments(after: DataFrame, before: DataFrame | None) -> DataFrame:
    """(key, n): a row for each occurrence: the counts that each key of after (key, n) went through since before (key, n)."""
    if before is not None:
        after = after.join(before.select("key", F.col("n").alias("m")), "key", "left")
    first = F.lit(0).cast("long") if before is None else F.coalesce("m", F.lit(0)).cast("long")
    return after.where(F.col("n") > first).select("key", F.explode(F.sequence(first + 1, F.col("n"))).alias("n"))


def state_counts(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, n): the counts that a query's state holds, after its last batch or an earlier one: no changelog is replayed."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    held = reader.load(checkpoint)
    only = lambda c: F.col(c)[held.schema[c].dataType.fieldNames()[0]]
    return held.select(only("key").alias("key"), only("value").alias("n"))


def read_changelog(spark: SparkSession, changelog: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).option("basePath", changelog).parquet(f"{changelog}/batch=*")


def well_formed(lines: DataFrame) -> DataFrame:
    """(key, n) of changelog lines of exactly two fields."""
    parts = F.split("value", r"\s+")
    return lines.where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).cast("long").alias("n"))


def latest(changelog: DataFrame, seq: str = "batch") -> DataFrame:
    """(key, n): the last value of each key."""
    return changelog.groupBy("key").agg(F.max_by("n", seq).alias("n"))


def count_folder(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(key, n) of a folder of text files, by a stream with new state."""
    base = shared_dir(spark)
    run(line_stream(spark, path, files_per_batch), f"{base}/changelog", f"{base}/state")
    return latest(read_changelog(spark, f"{base}/changelog"))
