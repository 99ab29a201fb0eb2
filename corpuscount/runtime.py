"""What every operator needs from the session: code on the executors, bounded Arrow batches, a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: An Arrow batch handed to Python holds at most so many bytes and rows, however long the texts are.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096
#: Bytes of a batch where whole texts go to Python and come back: JVM and worker hold several copies of it.
SMALL_BATCH = 4 << 20
#: Narrow rows for a task of few().
TASK_ROWS = 100_000

_shipped: set[str] = set()


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Make this package importable in Python workers and bound their Arrow batches."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        target = os.path.join(tempfile.mkdtemp(prefix="corpuscount-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. A folder of this machine stands in only where that setting is
    absent and all of Spark runs on this machine, as in tests; elsewhere that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "corpuscount-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpuscount-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder (or to path) and read again: lineage ends here.

    Nothing reads the shuffles of that write afterwards, so Spark deletes them once it has ended, and not when the driver's
    collector comes to them.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows at most, by no more tasks than these need: one for each TASK_ROWS, and one for each core at least.

    For steps that are repeated on narrow rows: a session whose number of shuffle partitions suits the texts would start as many
    tasks for a few thousand rows, each time, and write as many files. Nothing moves; where rows need as many tasks as there
    are shuffle partitions, df stays as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.coalesce(parts) if parts < parallelism(df.sparkSession) else df


def give_back(spark: SparkSession) -> None:
    """Have the JVMs of the executors collect what nothing refers to and give free memory back to the system.

    A JVM that isn't asked keeps its heap as large as an earlier step made it, and buffers outside the heap until it collects.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
