"""Writers: parts by reducer and splits by number, each a file of its own name; records; and the latest count of each key."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.operators.layout import laid_out
from corpuscount.runtime import setting


def files_of(spark: SparkSession, path: str):
    """(file system of a path, the path): of any kind that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_named(lines: DataFrame, path: str, column: str, names: Callable[[int], str], wanted: list[int]) -> None:
    """Text files of the column ``value``, one for each number in ``wanted``, an empty one where there are no rows.

    lines hold all rows of a number in one partition, in order. Executors write under a hidden folder beside the target; once
    the job is committed, the driver renames, and only then what was there goes: a job that fails leaves the old target whole.
    Between two renames there is no target, for a moment; a driver that ends there leaves the new files under the hidden name
    ``._staged`` and the old ones under ``._old``, each whole.
    """
    spark = lines.sparkSession
    staged = path.rstrip("/") + "._staged"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # nothing reads its shuffles again
        lines.select(column, "value").write.mode("overwrite").partitionBy(column).text(f"{staged}/rows")
    fs, root = files_of(spark, staged)
    new = spark._jvm.org.apache.hadoop.fs.Path

    def name(k: int) -> None:
        to, folder = new(f"{staged}/{names(k)}"), new(f"{staged}/rows/{column}={k}")
        found = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        if len(found) > 1:
            raise ValueError(f"rows of {k} lie in several partitions")
        if not found:
            fs.create(to).close()
        elif not fs.rename(found[0], to):
            raise OSError(f"could not rename {found[0]}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(name, wanted))
    fs.delete(new(f"{staged}/rows"), True)
    fs.create(new(f"{staged}/_SUCCESS")).close()
    target, old = new(path), new(path.rstrip("/") + "._old")
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not rename {path}")
    if not fs.rename(root, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not rename {staged}")
    fs.delete(old, True)


def write_parts(counts: DataFrame, path: str, reducers: int) -> None:
    """Files part-0.txt, part-1.txt, … of lines ``key<tab>count``, each reducer's by falling count; an empty one for a reducer without keys."""
    lines = laid_out(counts, reducers).select("reducer_id", F.concat_ws("\t", "key", F.col("n").cast("string")).alias("value"))
    write_named(lines, path, "reducer_id", lambda r: f"part-{r}.txt", list(range(reducers)))


def write_records(df: DataFrame, path: str) -> None:
    """Runs, samples or statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def show_top(counts: DataFrame, n: int = 20) -> None:
    counts.orderBy(F.desc("n"), "key").limit(n).show(n, truncate=False)
