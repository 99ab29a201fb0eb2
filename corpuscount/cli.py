"""Command line: run, ingest, count, validate, crawl, stream.

    python -m corpuscount.cli run -i wet.paths.gz --base s3a://bucket --splits-dir SPLITS -o OUTPUT -j wordcount [-n SPLITS] [--log LOG]

    python -m corpuscount.cli ingest -i wet.paths.gz --base s3a://bucket -o SPLITS [-n SPLITS] [--clean predownload] [--missing-only]
    python -m corpuscount.cli crawl -i wet.paths.gz --base s3a://bucket -o FOLDER [--index 0] [--max-lines 200000]

    python -m corpuscount.cli count -i INPUT -o OUTPUT -j wordcount -r 8 [-n SPLITS] [--clean direct] [--direct-read [--by-members] --base s3a://bucket]
    python -m corpuscount.cli validate -i INPUT -o OUTPUT -j wordcount [-n SPLITS] [--show 10]
    python -m corpuscount.cli stream -i FOLDER -o CHANGELOG -c CHECKPOINT [--top 20] [--timeout 15]

run takes in what lacks, counts and validates. validate and run end with 0 if all agrees, 1 if not, 2 where there is nothing to compare.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.operators import compare, jobs, timing
from corpuscount.sources import sinks, splits
from corpuscount.streaming import wordcount as stream


def _counts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Splits of any length: as they are, by byte ranges; with a clean mode, or straight from a crawl's files, by lines."""
    if not a.direct_read and not a.clean:
        return jobs.count_ranges(splits.read_ranges(spark, a.input, a.splits), a.job)
    if a.direct_read:
        read = splits.read_packed if a.by_members else splits.read_sources
        lines = read(spark, splits.below(_listed(spark, a), a.splits))
    else:
        lines = splits.split_lines(spark, a.input, a.splits)
    lines = splits.cleaned(lines, a.clean or "direct")
    return jobs.long_split_bigrams(lines, ["block", "line_no"], "file") if jobs.job(a.job).pairs else jobs.count(lines.select("split_id", "text"), a.job, dealt=a.direct_read and a.by_members)


def _listed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(split_id, path): a crawl's list of paths below --base."""
    paths = splits.read_paths(spark, a.input)
    return paths.select(F.col("index").cast("int").alias("split_id"), F.concat(F.lit(a.base.rstrip("/") + "/" if a.base else ""), "path").alias("path"))


def _count(spark: SparkSession, a: argparse.Namespace, counts: DataFrame) -> None:
    """Write the parts; with --log also a log with a record of each task, and show the run's times."""
    work = lambda: sinks.write_parts(counts, a.output, a.reducers)
    if not a.log:
        work()
        return
    tasks = timing.timed_tasks(spark, work)
    timing.log_lines(tasks).write.mode("append").text(a.log)
    timing.job_timing(tasks).show(truncate=False)


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    expected, actual = _counts(spark, a), splits.read_parts(spark, a.output).select("key", "n")
    found = compare.summary(expected, actual).first()
    print(found.asDict())
    if not found["expected_keys"] or not found["actual_keys"]:
        return 2
    compare.diff(expected, actual).orderBy("key").limit(a.show).show(a.show, truncate=False)
    sinks.show_top(actual, a.show)
    return 0 if found["equal"] else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpuscount", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("count", "validate", "run"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True, help="a folder of splits, or a crawl's list of paths")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-j", "--job", choices=sorted(jobs.JOBS), default="wordcount")
        c.add_argument("-n", "--splits", type=int)
        c.add_argument("--clean", choices=splits.CLEAN_MODES)
        c.add_argument("-r", "--reducers", type=int, default=8)
        c.add_argument("--show", type=int, default=10)
        c.add_argument("--direct-read", action="store_true", help="the input is a crawl's list of paths, read where they are")
        c.add_argument("--by-members", action="store_true", help="with --direct-read: several tasks unpack each gzip file")
        c.add_argument("--base")
        c.add_argument("--log", help="a folder for the run's timing records")
    sub.choices["run"].add_argument("--splits-dir", required=True, help="where the splits go; those that are there stay")
    sub.choices["run"].set_defaults(clean="predownload")
    for name in ("ingest", "crawl"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True, help="a crawl's list of paths")
        c.add_argument("--base", help="what stands before each path")
        c.add_argument("-o", "--output", required=True)
    sub.choices["ingest"].add_argument("-n", "--splits", type=int)
    sub.choices["ingest"].add_argument("--clean", choices=splits.CLEAN_MODES, default="predownload")
    sub.choices["ingest"].add_argument("--missing-only", action="store_true")
    sub.choices["crawl"].add_argument("--index", type=int, default=0)
    sub.choices["crawl"].add_argument("--max-lines", type=int, default=200_000)
    c = sub.add_parser("stream")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-c", "--checkpoint", required=True)
    c.add_argument("--top", type=int, default=20)
    c.add_argument("--timeout", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpuscount").getOrCreate()
    if a.command == "count":
        _count(spark, a, _counts(spark, a))
        return 0
    if a.command == "run":
        splits.add_missing(spark, splits.below(_listed(spark, a), a.splits), a.splits_dir, a.clean)
        a.input, a.clean, a.direct_read = a.splits_dir, None, False
        _count(spark, a, _counts(spark, a))
        return _validate(spark, a)
    if a.command == "ingest":
        (splits.add_missing if a.missing_only else splits.ingest)(spark, splits.below(_listed(spark, a), a.splits), a.output, a.clean)
        return 0
    if a.command == "crawl":
        stream.publish(splits.read_sources(spark, _listed(spark, a).where(F.col("split_id") == a.index)), a.output, a.max_lines)
        return 0
    if a.command == "stream":
        stream.run(stream.line_stream(spark, a.input, strict=True), a.output, a.checkpoint, a.timeout)
        sinks.show_top(stream.latest(stream.read_changelog(spark, a.output)), a.top)
        return 0
    return _validate(spark, a)


if __name__ == "__main__":
    sys.exit(main())
