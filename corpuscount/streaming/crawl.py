"""A crawl as a stream of lines: offsets are numbers of lines, and each batch takes so many more.

line_index() numbers the lines of a crawl's gzip files once: a row for each stretch of whole members, with the lines that it
keeps and the number of the first. A query then starts, stops and goes on at any line: what is in a batch follows from two
numbers, and a batch that is run again has the same lines. Headers are left out before lines are numbered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpuscount.runtime import prepare, written
from corpuscount.sources.ranges import RANGE, file_of, member_index, member_lines, read_members, some
from corpuscount.sources.splits import STRICT_HEADER

_HEADER = re.compile(STRICT_HEADER.encode())


def line_index(spark: SparkSession, sources: DataFrame, path: str, range_bytes: int = RANGE) -> None:
    """Writes to path: (split_id, file, start, stop, begins_line, lines, first) of gzip files (split_id, path), in their order.

    lines are those that stay once headers are out; first is the number of the stretch's first one, from 0.
    """
    paths = [r["path"] for r in sources.select("path").toLocalIterator()]
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/+", "/")
    named = sources.select("split_id", plain(F.col("path")).alias("__file"))
    index = member_index(spark, paths, range_bytes=range_bytes)
    index = written(index.join(named, plain(F.col("file")) == F.col("__file")).drop("__file"))
    kept = read_members(index).where(~F.col("text").rlike(STRICT_HEADER))
    counts = kept.groupBy("file", F.col("block").alias("start")).agg(F.count(F.lit(1)).alias("lines"))
    order = W.partitionBy(F.lit(0)).orderBy("split_id", "start")  # a row a stretch, not a line
    rows = index.join(counts, ["file", "start"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    first = F.coalesce(F.sum("lines").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows.select("split_id", "file", "start", "stop", "begins_line", "lines", first.alias("first")).write.mode("overwrite").parquet(path)


@dataclass
class Lines(InputPartition):
    file: str
    start: int
    stop: int
    begins_line: bool
    skip: int
    take: int


class _CrawlReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.index, self.most, self.step, self.checkpoint = options["index"], int(options["most"]), int(options["perBatch"]), options["checkpoint"]
        self.rows, self.at = None, None

    def _stretches(self) -> list[dict]:
        """The index: numbers of a few stretches a file, held by the driver as any source holds its list of files."""
        if self.rows is None:
            import pyarrow.parquet as pq

            system, path = file_of(self.index)
            self.rows = sorted(pq.read_table(path, filesystem=system).to_pylist(), key=lambda r: r["first"])
        return self.rows

    def _begun(self) -> int:
        """The line that the query has planned up to, as its checkpoint says; 0 for a new query."""
        from pyarrow import fs

        system, path = file_of(f"{self.checkpoint}/offsets")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        planned = [x for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.isdigit()]
        if not planned:
            return 0
        with system.open_input_file(max(planned, key=lambda x: int(x.base_name)).path) as f:
            last = f.read().decode().strip().splitlines()[-1]
        return json.loads(last)["line"] if last.startswith("{") else 0

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        """Where the next batch ends: so many lines on, at the cap, or at the last line."""
        if self.at is None:
            self.at = self._begun()
        rows = self._stretches()
        end = rows[-1]["first"] + rows[-1]["lines"] if rows else 0
        return {"line": max(self.at, min(end, self.most or end, self.at + self.step))}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        a, b = start["line"], end["line"]
        self.at = max(self.at or 0, b)
        inside = [(r, max(a - r["first"], 0), min(b - r["first"], r["lines"])) for r in self._stretches() if r["first"] < b and r["first"] + r["lines"] > a]
        return [Lines(r["file"], r["start"], r["stop"], r["begins_line"], low, high - low) for r, low, high in inside]

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["line"])

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        system, path = file_of(partition.file)
        with system.open_input_file(path) as f:
            found = (x for x in member_lines(f, partition.start, partition.stop, partition.begins_line) if not _HEADER.match(x))
            for _ in range(partition.skip):
                next(found)
            left = partition.take
            while left and (lines := some(found, left)):
                left -= len(lines)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["content"])


class CrawlLines(DataSource):
    """Options: index (line_index()'s table), perBatch, most (0: all), checkpoint (the query's own)."""

    @classmethod
    def name(cls) -> str:
        return "crawl_lines"

    def schema(self) -> str:
        return "content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _CrawlReader(self.options)


def crawl_stream(spark: SparkSession, index: str, checkpoint: str, per_batch: int = 1_000_000, most: int = 200_000) -> DataFrame:
    """(value): the first ``most`` lines of an indexed crawl (0: all) as a stream, per_batch lines at a time.

    checkpoint is that of the query that reads it: a query that starts again goes on behind the last line that was planned,
    with whatever per_batch and most are then.
    """
    prepare(spark)
    spark.dataSource.register(CrawlLines)
    lines = spark.readStream.format(CrawlLines.name()).options(index=index, perBatch=per_batch, most=most, checkpoint=checkpoint).load()
    return lines.select(F.col("content").cast("string").alias("value"))
