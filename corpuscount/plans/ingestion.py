"""Queries over what is read and written: splits, crawls, logs, results, machines and streams, made of the test tables."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.functions.forms import plain_host, rounded, without_download
from corpuscount.functions.tokens import decoded, tokens
from corpuscount.operators import fleet, jobs, scaling, timing
from corpuscount.plans.catalogue import _LOADS, _RUNS, _TOK, _docs, _loads, _runs, _table, query
from corpuscount.runtime import shared_dir
from corpuscount.sources import ranges, records, sinks, splits
from corpuscount.streaming import crawl
from corpuscount.streaming import wordcount as stream

SPLITS, CAP = 8, 500
#: Bytes of text in a file of the command line's crawl, about.
FILE = 64 << 20
_HEADS = ("WARC/1.0", "WARC-Type: conversion", "Content-Type: text/plain", "content-length: 7", "Metadata-x: y")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(split_id, doc_id, value): documents by their ids' remainder, every third with header lines before it."""
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("".join(x + "\n" for x in _HEADS))).otherwise("")
    return _table(spark, d, "documents").where("text is not null").select((F.col("doc_id") % SPLITS).cast("int").alias("split_id"), "doc_id", F.concat(head, "text").alias("value"))


def _crawl(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """(split_id, path) of gzip files that hold these texts.

    With most, a split is several files where it has more bytes of text, each with a number of its own, as a crawl has more files
    and not longer ones: no task writes or reads more than about that.
    """
    path, texts, files = shared_dir(spark), _texts(spark, d), SPLITS
    if most:
        largest = texts.groupBy("split_id").agg(F.sum(F.octet_length("value")).alias("n")).agg(F.max("n")).first()[0] or 0
        parts = max(1, -(-largest // most))
        files = SPLITS * parts
        texts = texts.withColumn("split_id", (F.col("split_id") + SPLITS * F.pmod(F.xxhash64("doc_id"), F.lit(parts))).cast("int"))
    rows = texts.repartitionById(files, F.col("split_id")).sortWithinPartitions("split_id", "doc_id").select("split_id", "value")
    rows.write.partitionBy("split_id").option("compression", "gzip").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    return spark.createDataFrame([(p,) for p in files], "path string").select(F.regexp_extract("path", r"split_id=(\d+)", 1).cast("int").alias("split_id"), "path")


_CRAWL = (
    "lines AS (SELECT doc_id, doc_id % 8 AS split_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN "
    + " || ".join(f"'{x}' || chr(10)" for x in _HEADS)
    + " || text ELSE text END, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"
)
_BATCH = "kept AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^(WARC/|CONTENT-|Content-|Metadata-)'))"
_WORDS = "t AS (SELECT lower(unnest(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS key FROM {}) SELECT key, count(*) AS n FROM t GROUP BY key"


@query(f"WITH {_CRAWL}, {_BATCH} SELECT CAST(split_id AS INTEGER) AS split_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(sum(len(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS BIGINT) AS tokens FROM kept GROUP BY 1")
def ingested_splits(spark: SparkSession, d: str) -> DataFrame:
    """A crawl taken in by two runs, the second only what the first left out; the split files' sizes and tokens."""
    crawl, target = _crawl(spark, d), shared_dir(spark)
    splits.ingest(spark, crawl.where("split_id % 3 = 0"), target)
    splits.add_missing(spark, crawl, target)
    return splits.split_sizes(spark, target)


@query(f"WITH {_CRAWL}, {_BATCH}, {_WORDS.format('kept')}")
def direct_read(spark: SparkSession, d: str) -> DataFrame:
    """The crawl's files read where they are, headers out."""
    return jobs.count(splits.cleaned(splits.read_sources(spark, _crawl(spark, d)).select("split_id", "text"), "direct"), "wordcount")


@query(f"WITH {_CRAWL}, {_BATCH}, {_WORDS.format('kept')}")
def command_line(spark: SparkSession, d: str) -> DataFrame:
    """One command takes in a crawl, counts, validates and writes a log; its part files, which must be found equal."""
    from corpuscount import cli

    listed, base = shared_dir(spark), shared_dir(spark)
    _crawl(spark, d, FILE).repartition(1).sortWithinPartitions("split_id").select(F.col("path").alias("value")).write.text(listed)
    ended = io.StringIO()
    with contextlib.redirect_stdout(ended):
        code = cli.main(["run", "-i", listed, "--splits-dir", f"{base}/splits", "-o", f"{base}/parts", "-j", "wordcount", "-r", str(SPLITS), "--log", f"{base}/log"])
    if code:
        raise ValueError(ended.getvalue())
    return splits.read_parts(spark, f"{base}/parts").select("key", "n")


@query(f"WITH {_CRAWL}, {_BATCH}, {_WORDS.format('kept')}")
def member_read(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of gzip files with a member for each document, unpacked by many tasks a file; headers out."""
    lines = splits.read_packed(spark, _members(spark, d))
    return jobs.count(splits.cleaned(lines.select("split_id", "text"), "direct"), "wordcount", dealt=True)


@query("""WITH s AS (SELECT doc_id % 8 AS split_id, regexp_extract_all(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), '[A-Za-z0-9]+') AS a FROM documents GROUP BY 1),
t AS (SELECT unnest(list_transform(range(1, len(a)), lambda i: lower(a[i] || ' ' || a[i + 1]))) AS key FROM s WHERE len(a) > 1) SELECT key, count(*) AS n FROM t GROUP BY key""")
def range_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of adjacent tokens in a few long split files, each read by many tasks, a byte range each: no row holds a file."""
    path = shared_dir(spark)
    rows = _table(spark, d, "documents").select((F.col("doc_id") % SPLITS).cast("int").alias("split_id"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows = rows.repartitionById(SPLITS, F.col("split_id")).sortWithinPartitions("split_id", "doc_id")
    sinks.write_named(rows, path, "split_id", lambda k: f"commoncrawl-{k:04d}.txt", list(range(SPLITS)))
    return jobs.count_ranges(splits.read_ranges(spark, path), "bigram")


@query(f"WITH {_CRAWL}, {_WORDS.format('lines')}")
def on_demand(spark: SparkSession, d: str) -> DataFrame:
    """Splits that are there are read as they are, the others from the crawl; headers stay."""
    crawl, local = _crawl(spark, d), shared_dir(spark)
    splits.ingest(spark, crawl.where("split_id < 4"), local, "ondemand")
    wanted = splits.acquire(spark, SPLITS, local, crawl.select(F.col("split_id").cast("long").alias("index"), "path"))
    return jobs.count(splits.cleaned(splits.read_sources(spark, wanted).select("split_id", "text"), "ondemand"), "wordcount")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """A gzip list of paths with a blank line after every second one."""
    path = shared_dir(spark)
    line = F.concat(F.lit("crawl/"), F.col("doc_id").cast("string"), F.lit(".warc.wet.gz"), F.when(F.col("doc_id") % 2 == 1, "\n  ").otherwise(""))
    _table(spark, d, "documents").select("doc_id", line.alias("value")).repartition(1).sortWithinPartitions("doc_id").select("value").write.option("compression", "gzip").text(path)
    return splits.read_paths(spark, path)


_PATHS = "p AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS index, 'crawl/' || CAST(doc_id AS VARCHAR) || '.warc.wet.gz' AS path FROM documents)"


@query(f"WITH {_PATHS} SELECT index, path FROM p")
def crawl_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d)


@query(f"WITH {_PATHS} SELECT index, path FROM p WHERE index = 17")
def crawl_nth_path(spark: SparkSession, d: str) -> DataFrame:
    return splits.nth_path(_paths(spark, d), 17)


@query(f"WITH {_CRAWL}, kept AS (SELECT line FROM lines WHERE NOT regexp_matches(lower(line), '^(warc/|warc-|content-|metadata-)') ORDER BY split_id, doc_id, pos LIMIT {CAP}), {_WORDS.format('kept')}")
def crawl_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of a crawl, put where the stream reads them; the stream drains them within its time."""
    folder, base = shared_dir(spark), shared_dir(spark)
    lines = splits.read_sources(spark, _crawl(spark, d))
    stream.publish(lines, folder, CAP)
    stream.run(stream.line_stream(spark, folder), f"{base}/changelog", f"{base}/state", timeout=600)
    return stream.latest(stream.read_changelog(spark, f"{base}/changelog"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(split_id, path) of gzip files with a member for each document."""
    path, k = shared_dir(spark), F.col("id").cast("int")
    value = F.concat("value", F.lit("\n")).cast("binary")
    rows = _texts(spark, d).repartitionById(SPLITS, F.col("split_id")).sortWithinPartitions("split_id", "doc_id").select("split_id", value.alias("value"))
    ranges.write_members(rows, path)
    names = spark.range(SPLITS).select(k.alias("split_id"), F.concat(F.lit(f"{path}/"), k.cast("string"), F.lit(".gz")).alias("path"))
    return names.join(_texts(spark, d).select("split_id").distinct(), "split_id")


@query(f"WITH {_CRAWL}, kept AS (SELECT line FROM lines WHERE NOT regexp_matches(lower(line), '^(warc/|warc-|content-|metadata-)') ORDER BY split_id, doc_id, pos LIMIT {CAP}), {_WORDS.format('kept')}")
def crawl_stream_rows(spark: SparkSession, d: str) -> DataFrame:
    """A crawl read as a stream with offsets in lines: batches of 150 lines up to 200, then a new start that goes on to the cap."""
    index, base = shared_dir(spark), shared_dir(spark)
    crawl.line_index(spark, _members(spark, d), index)
    for most in (200, CAP):
        lines = crawl.crawl_stream(spark, index, f"{base}/state", per_batch=150, most=most)
        stream.run(lines, f"{base}/changelog", f"{base}/state", timeout=600, stepwise=True)
    return stream.latest(stream.read_changelog(spark, f"{base}/changelog"))


@query(f"WITH {_TOK} SELECT t AS key, count(*) AS n, count(*) AS records, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS total, count(*) AS held FROM tok GROUP BY t")
def stream_records(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a stream: the last count of each key, its rows in a changelog of every occurrence and their sum (counts from 1
    on, each once), and what the state holds."""
    folder, base = shared_dir(spark), shared_dir(spark)
    docs = _docs(spark, d)
    for half in (0, 1):
        docs.where(F.col("split_id") % 2 == half).select("text").write.mode("append").option("compression", "gzip").text(folder)
        stream.run(stream.line_stream(spark, folder), f"{base}/changelog", f"{base}/state", timeout=900, records=True)
    log = stream.read_changelog(spark, f"{base}/changelog").groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("records"), F.sum("n").alias("total"))
    held = stream.state_counts(spark, f"{base}/state").withColumnRenamed("n", "held")
    return log.join(held, "key").select("key", "n", "records", "total", "held")


@query(f"WITH {_TOK} SELECT t AS key, count(*) AS n FROM tok GROUP BY t")
def stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """Half of the texts, then a restart from the checkpoint with the others; a run with state of its own counts anew."""
    folder, base = shared_dir(spark), shared_dir(spark)
    docs = _docs(spark, d)
    for half in (0, 1):
        docs.where(F.col("split_id") % 2 == half).select("text").write.mode("append").text(folder)
        stream.run(stream.line_stream(spark, folder), f"{base}/changelog", f"{base}/state", timeout=600)
    kept = stream.latest(stream.read_changelog(spark, f"{base}/changelog"))
    fresh = stream.count_folder(spark, folder)
    return kept.join(fresh.withColumnRenamed("n", "m"), "key").where("n = m").select("key", "n")


@query("SELECT event_type AS key, CAST(max(event_id) AS BIGINT) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def changelog_lines(spark: SparkSession, d: str) -> DataFrame:
    """A changelog as text, in which lines of one field or three don't count."""
    path, k = shared_dir(spark), F.col("event_id")
    line = F.when(k % 10 == 0, F.col("event_type")).when(k % 10 == 5, F.concat_ws(" ", "event_type", k.cast("string"), F.lit("x"))).otherwise(F.concat_ws("\t", "event_type", k.cast("string")))
    _table(spark, d, "events").select(line.alias("value")).write.text(path)
    rows = stream.well_formed(spark.read.text(path))
    return stream.latest(rows.withColumn("seq", F.col("n")), "seq")


@query("SELECT t_total, t_map, t_reduce, count(*) AS n FROM (SELECT (event_id % 100)::DOUBLE AS t_total, (event_id % 7)::DOUBLE AS t_map, CASE WHEN event_id % 3 <> 0 THEN (event_id % 5)::DOUBLE END AS t_reduce FROM events WHERE event_id % 4 = 1) GROUP BY 1, 2, 3")
def log_timings(spark: SparkSession, d: str) -> DataFrame:
    return records.timing_records(_log(spark, d)).groupBy("t_total", "t_map", "t_reduce").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT sum(a)::DOUBLE AS t_download, 0::DOUBLE AS t_clean, 0::DOUBLE AS t_io_read, sum(b)::DOUBLE AS t_compute, 0::DOUBLE AS t_io_write, coalesce(sum(c), 0)::DOUBLE AS t_shuffle, max(a)::DOUBLE AS t_download_max
FROM (SELECT event_id % 11 AS a, event_id % 13 AS b, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS c FROM events WHERE event_id % 4 = 2)""")
def log_worker_sums(spark: SparkSession, d: str) -> DataFrame:
    return scaling.worker_sums(records.worker_records(_log(spark, d)))


@query(f"""WITH {_TOK} SELECT 'MAP' AS phase, CAST(NULL AS BIGINT) AS parts, count(*) AS n_rows, true AS timed FROM documents
UNION ALL SELECT 'REDUCE', 8, count(DISTINCT t), true FROM tok""")
def job_timings(spark: SparkSession, d: str) -> DataFrame:
    """A word count run and timed: its tasks' records as log lines, written and read again as any log is.

    n_rows are those that map tasks read from the table and those that the last reduce tasks wrote; parts are these tasks.
    timed: no record's steps are negative, all of a run's records lie within its total, and its phases add up to it.
    """
    words = jobs.job("wordcount").keys(_docs(spark, d), []).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    tasks = timing.timed_tasks(spark, lambda: sinks.write_parts(words, shared_dir(spark), SPLITS))
    path = shared_dir(spark)
    timing.log_lines(tasks).write.text(path)
    log = records.read_log(spark, path)
    steps = F.col("t_io_read") + F.col("t_compute") + F.col("t_io_write") + F.col("t_shuffle")
    workers = records.worker_records(log).withColumns({"steps": steps, "least": F.least("t_io_read", "t_compute", "t_io_write", "t_shuffle")})
    whole = records.timing_records(log).select("t_total", (F.abs(F.col("t_map") + F.col("t_reduce") - F.col("t_total")) < 0.0015).alias("adds_up"))
    n = F.when(F.col("phase") == "MAP", F.sum("rows_in")).otherwise(F.sum("rows_out"))
    stages = workers.groupBy("phase", "stage_id").agg(F.count("reducer_id").alias("parts"), n.alias("n_rows"), F.max("steps").alias("most"), F.min("least").alias("least"))
    # of a few stages: what all map tasks read, and what the last reduce tasks wrote
    last = lambda c, every: F.when(F.col("phase") == "MAP", every(c)).otherwise(F.max_by(c, "stage_id"))
    sums = stages.groupBy("phase").agg(last("parts", F.sum).alias("parts"), last("n_rows", F.sum).alias("n_rows"), F.max("most").alias("most"), F.min("least").alias("least"))
    timed = F.col("adds_up") & (F.col("least") >= 0) & (F.col("most") <= F.col("t_total") + 0.01)
    return sums.join(whole).select("phase", F.when(F.col("phase") == "REDUCE", F.col("parts")).alias("parts"), "n_rows", timed.alias("timed"))  # whole is one row


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A log: records of the master and of workers, plain lines, and records cut off."""
    path, k = shared_dir(spark), F.col("event_id")
    num = lambda n: (k % n).cast("string")
    reduce = F.when(k % 3 != 0, F.concat(F.lit(', "t_reduce": '), num(5))).otherwise("")
    shuffle = F.when(k % 3 != 0, F.concat(F.lit(', "t_shuffle": '), num(5))).otherwise("")
    master = F.concat(F.lit('[12:00] [MASTER] TIMING: {"t_total": '), num(100), F.lit(', "t_map": '), num(7), reduce, F.lit("}"))
    worker = F.concat(F.lit('WORKER_TIMING: {"phase": "map", "t_download": '), num(11), F.lit(', "t_compute": '), num(13), shuffle, F.lit("}"))
    line = F.when(k % 4 == 1, master).when(k % 4 == 2, worker).when(k % 4 == 3, 'TIMING: {"t_total": 1').otherwise("all is well")
    _table(spark, d, "events").select(line.alias("value")).write.text(path)
    return records.read_log(spark, path)


@query(f"WITH {_RUNS} SELECT CAST(n_workers AS INTEGER) AS n_workers, round(t_total, 6) AS t_total, 'new' AS form FROM r WHERE n_workers <> 3 UNION ALL SELECT n_workers, round(t_total, 6), 'old' FROM r")
def scaling_results(spark: SparkSession, d: str) -> DataFrame:
    """Results as a list of records (one without a total time) and in the older form, written and read."""
    runs = _runs(spark, d)
    out = None
    total = F.when(F.col("n_workers") != 3, F.col("t_total"))
    old = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("n_workers").cast("string"), "t_total"))).alias("times")))
    new = F.to_json(F.collect_list(F.struct("n_workers", total.alias("t_total"))))
    for form, value in (("new", new), ("old", old)):
        path = shared_dir(spark)
        runs.agg(value.alias("value")).coalesce(1).write.text(path)
        got = scaling.valid_runs(records.read_runs(spark, path)).select("n_workers", F.round("t_total", 6).alias("t_total"), F.lit(form).alias("form"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {_RUNS} SELECT n_workers, rank() OVER (ORDER BY n_workers) AS place, round(t_total, 6) AS t_total FROM r")
def runs_by_workers(spark: SparkSession, d: str) -> DataFrame:
    """The order in which valid runs come, by the place of each row as it is written to a JSON file and read."""
    path = shared_dir(spark)
    sinks.write_records(scaling.valid_runs(_runs(spark, d)).coalesce(1), path)
    rows = spark.read.schema("n_workers int, t_total double").json(path)
    return rows.withColumn("at", F.monotonically_increasing_id()).select("n_workers", (F.col("at") + 1).alias("place"), F.round("t_total", 6).alias("t_total"))


@query(f"WITH {_RUNS}, a AS (SELECT n_workers, t_total - (1 + n_workers % 3)::DOUBLE AS adj, t_map - (1 + n_workers % 3)::DOUBLE AS t_map_adj FROM r) SELECT n_workers, round(t_map_adj, 6) AS t_map_adj, round((SELECT adj FROM a WHERE n_workers = 1) / adj, 6) AS speedup_adj FROM a")
def speedup_adjusted(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).withColumn("t_download_max", (1 + F.col("n_workers") % 3).cast("double"))
    runs = runs.withColumn("t_map_adj", without_download(F.col("t_map"), F.col("t_download_max")))
    return scaling.speedup(runs).select("n_workers", rounded(F.col("t_map_adj"), 6).alias("t_map_adj"), rounded(F.col("speedup_adj"), 6).alias("speedup_adj"))


@query(f"WITH {_RUNS}, p AS (SELECT n_workers, t_total, unnest(['map', 'reduce', 'other']) AS phase, unnest([t_map, t_reduce, greatest(t_total - t_map - t_reduce, 0)]) AS seconds FROM r) SELECT n_workers, phase, round(seconds, 4) AS seconds, round(100 * seconds / t_total, 4) AS percent FROM p")
def phase_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return scaling.phase_breakdown(_runs(spark, d)).select("n_workers", "phase", rounded(F.col("seconds"), 4).alias("seconds"), rounded(F.col("percent"), 4).alias("percent"))


@query("SELECT user_id, round((max(event_id) - min(event_id)) / 8.0::DOUBLE, 3) AS t_total, round((max(event_id) - min(event_id)) / 16.0::DOUBLE, 3) AS t_map, round((max(event_id) - min(event_id)) / 16.0::DOUBLE, 3) AS t_reduce FROM events GROUP BY user_id")
def phase_durations(spark: SparkSession, d: str) -> DataFrame:
    marks = _table(spark, d, "events").groupBy("user_id").agg((F.min("event_id") / 8).alias("t_start"), (F.max("event_id") / 8).alias("t_end"))
    marks = marks.withColumn("t_map_end", (F.col("t_start") + F.col("t_end")) / 2)
    return scaling.phase_durations(marks, keep=["user_id"])


@query("SELECT host, plain, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '::ffff:10.0.0.' ELSE '10.0.0.' END || CAST(c_custkey % 50 AS VARCHAR) AS host, '10.0.0.' || CAST(c_custkey % 50 AS VARCHAR) AS plain FROM customer WHERE c_custkey % 7 > 2) GROUP BY 1, 2")
def host_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of hosts with blank lines, comments and this machine; addresses in both forms."""
    path, k = shared_dir(spark), F.col("c_custkey")
    host = F.concat(F.when(k % 3 == 0, "::ffff:10.0.0.").otherwise("10.0.0."), (k % 50).cast("string"))
    line = F.when(k % 7 == 0, "  ").when(k % 7 == 1, F.concat(F.lit("# "), host)).when(k % 7 == 2, "localhost").otherwise(F.concat(F.lit(" "), host))
    _table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return records.read_hosts(spark, path).groupBy("host", plain_host(F.col("host")).alias("plain")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOADS} SELECT host, round(l1, 2) AS l1, round(l5, 2) AS l5, round(l15, 2) AS l15 FROM ld")
def collected_loads(spark: SparkSession, d: str) -> DataFrame:
    """Load files of the hosts that answered, read; nulls for the others."""
    path, loads = shared_dir(spark), _loads(spark, d)
    line = F.concat_ws(" ", *[F.format_string("%.2f", c) for c in ("l1", "l5", "l15")], F.lit("1/2 3"))
    loads.where("l1 is not null").select("host", line.alias("value")).write.partitionBy("host").text(path)
    got = records.read_load(spark, path, F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)", 1))
    return fleet.by_host(records.with_missing(loads, got))


@query("""WITH m AS (SELECT (CASE WHEN c_custkey % 3 = 0 THEN 'tp-' ELSE 'xx-' END) || CAST(c_custkey AS VARCHAR) AS name, c_custkey % 5 <> 0 AS alive, c_custkey % 11 AS a, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 7 END AS b, c_nationkey AS c FROM customer)
SELECT name || '.example.org' AS host, coalesce(CAST(a + b + c AS DOUBLE), 999) AS score FROM m WHERE alive AND starts_with(name, 'tp-') ORDER BY score, host LIMIT 50""")
def machine_list(spark: SparkSession, d: str) -> DataFrame:
    """A machine list in JSON; one figure that can't be read spoils a machine's whole score."""
    k, path = F.col("c_custkey"), shared_dir(spark)
    name = F.concat(F.when(k % 3 == 0, "tp-").otherwise("xx-"), k.cast("string"))
    figures = (F.to_json(F.array(name)), F.when(k % 5 != 0, "true").otherwise("false"), (k % 11).cast("string"), F.when(k % 13 == 0, '"n/a"').otherwise((k % 7).cast("string")), F.col("c_nationkey").cast("string"))
    row = F.concat(F.lit("["), F.concat_ws(", ", F.regexp_replace(figures[0], r"[\[\]]", ""), *figures[1:]), F.lit("]"))
    _table(spark, d, "customer").agg(F.concat(F.lit('{"data": ['), F.array_join(F.collect_list(row), ", "), F.lit("]}")).alias("value")).write.text(path)
    return fleet.least_occupied(records.read_machines(spark, path), ["tp-"], 50, per_figure=False, domain=".example.org")


@query("SELECT doc_id, md5('xy' || coalesce(text, '')) AS digest FROM documents")
def invalid_bytes_out(spark: SparkSession, d: str) -> DataFrame:
    """Texts behind bytes that are no UTF-8: those go, and what stands around them is joined."""
    bad = F.lit(bytearray(b"x\xe9y\xf0\x9f\xff"))
    return _table(spark, d, "documents").select("doc_id", F.md5(decoded(F.concat(bad, F.coalesce("text", F.lit("")).cast("binary")))).alias("digest"))


@query(f"WITH {_TOK} SELECT substr(t, 1, 1) AS key, count(*) AS n FROM tok GROUP BY 1")
def own_job(spark: SparkSession, d: str) -> DataFrame:
    """A job added to the registry: first letters."""
    if "first" not in jobs.JOBS:
        jobs.register(jobs.JobSpec("first", lambda corpus, kept: corpus.select(*kept, F.explode(tokens("text")).alias("token")).select(*kept, F.lower(F.substring("token", 1, 1)).alias("key"))))
    return jobs.count(_docs(spark, d), "first")
