"""Readers of text splits, with the four ways in which their text is cleaned.

A missing or unreadable file ends the job: nothing is left out in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscount.functions.tokens import decoded, latin1, tokens
from corpuscount.runtime import written
from corpuscount.sources.ranges import RANGE, member_index, read_members, read_token_ranges
from corpuscount.sources.sinks import files_of, write_named

#: Numbers have four digits, and more from 10,000 on.
SPLIT_NAME = r"commoncrawl-(\d{4,})\.txt$"
#: How header lines begin, in batch (case matters) and in strict cleaning (case doesn't).
BATCH_HEADER = "^(WARC/|CONTENT-|Content-|Metadata-)"
STRICT_HEADER = "(?i)^(WARC/|WARC-|Content-|Metadata-)"
#: predownload: headers out, invalid UTF-8 dropped; ondemand: invalid UTF-8 dropped, headers stay; direct: headers out,
#: bytes as they are; strict: more headers out, bytes as they are.
CLEAN_MODES = ("predownload", "ondemand", "direct", "strict")
_WHOLE = {"ignoreMissingFiles": "false", "ignoreCorruptFiles": "false"}


def split_id(path: Column) -> Column:
    """The number in a split's name; null for other names."""
    return F.regexp_extract(path, SPLIT_NAME, 1).try_cast("int")


def split_name(split: Column) -> Column:
    return F.format_string("commoncrawl-%04d.txt", split)


def below(df: DataFrame, n: int | None) -> DataFrame:
    """Splits with a number below n; those without a number stay."""
    return df if n is None else df.where(F.col("split_id").isNull() | (F.col("split_id") < n))


def read_splits(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(split_id, text), a row for each file: its bytes, one character each."""
    files = spark.read.format("binaryFile").options(**_WHOLE).option("recursiveFileLookup", "true").option("pathGlobFilter", "commoncrawl-*.txt").load(path)
    return below(files.select(split_id(F.col("path")).alias("split_id"), latin1("content").alias("text")), n)


def read_ranges(spark: SparkSession, path: str, n: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(split_id, file, start, prior, text) of splits of any length: their bytes, one character each, in rows of about 128 KB.

    Files are cut into byte ranges where no token is; prior is the token before a row (jobs.count_ranges).
    """
    rows = read_token_ranges(spark, path, range_bytes=range_bytes)
    return below(rows.select(split_id(F.col("file")).alias("split_id"), "*"), n)


def split_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(split_id, file, block, line_no, text) of the split files of a folder and its subfolders, a row for each line."""
    files = spark.read.options(**_WHOLE).option("recursiveFileLookup", "true").option("pathGlobFilter", "commoncrawl-*.txt").option("lineSep", "\n").text(path)
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))
    return below(lines.select(split_id(F.col("file")).alias("split_id"), "*"), n)


def split_sizes(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(split_id, bytes, tokens) of the split files that read_splits() reads, a row for each file that holds a byte.

    No token goes beyond a line, so that tokens are counted line by line, in parts of files: no row holds a whole split.
    """
    files = spark.read.options(**_WHOLE).option("recursiveFileLookup", "true").option("pathGlobFilter", "commoncrawl-*.txt").option("lineSep", "\n").text(path)
    own = F.size(tokens(latin1(F.col("value").cast("binary")))).cast("long")
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), own.alias("tokens"))
    sizes = lines.groupBy("file", "bytes").agg(F.sum("tokens").alias("tokens"))
    return below(sizes.select(split_id(F.col("file")).alias("split_id"), F.col("bytes").cast("long").alias("bytes"), "tokens"), n)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text or gzip files, a row for each line: splits of any length.

    line_no rises along each file; it is made where the file is read, before any exchange.
    """
    lines = spark.read.options(**_WHOLE).option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def kept_lines(text: Column, mode: str = "direct") -> Column:
    """Array of the lines of a text (or of a line) that one of CLEAN_MODES leaves, as it leaves them."""
    if mode not in CLEAN_MODES:
        raise ValueError(f"unknown clean mode {mode!r}: one of {', '.join(CLEAN_MODES)}")
    # any line break counts where text is decoded; at the end of a line that was cut at \n it belongs to that break
    lines = F.split(F.regexp_replace(decoded(text), r"\r\z", ""), "\r\n|\r|\n") if mode in ("predownload", "ondemand") else F.split(text, "\n")
    header = STRICT_HEADER if mode == "strict" else BATCH_HEADER
    return lines if mode == "ondemand" else F.filter(lines, lambda x: ~x.rlike(header))


def cleaned(lines: DataFrame, mode: str = "direct", col: str = "text") -> DataFrame:
    """Lines as one of CLEAN_MODES leaves them."""
    return lines.withColumn(col, F.explode(kept_lines(F.col(col), mode)))


def capped(lines: DataFrame, most: int = 200_000) -> DataFrame:
    """The first ``most`` lines (file, block, line_no, …) in the order of files; all of them for 0."""
    return lines.orderBy("file", "block", "line_no").limit(most) if most else lines


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(index, path): the non-blank lines of a crawl's list of paths, gzip or plain, numbered from 0.

    The list is one file of some megabytes, in the order that counts, which one task numbers.
    """
    lines = read_lines(spark, path).where(F.trim("text") != "")
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("file", "block", "line_no"))
    return lines.select((place - 1).cast("long").alias("index"), F.trim("text").alias("path"))


def nth_path(paths: DataFrame, index: int) -> DataFrame:
    return paths.where(F.col("index") == index)


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Split numbers that are wanted and not there."""
    return wanted.select("split_id").distinct().join(present.select("split_id"), "split_id", "left_anti")


def acquire(spark: SparkSession, wanted: int, local: str, remote: DataFrame) -> DataFrame:
    """(split_id, path) of the first ``wanted`` splits: the local file where there is one, else the remote path of that index.

    Fails where neither exists. Reading is Spark's: remote paths may be of any file system that it knows.
    """
    here = split_files(spark, local).withColumnRenamed("path", "local")
    there = remote.select(F.col("index").cast("int").alias("split_id"), F.col("path").alias("remote"))
    ids = spark.range(wanted).select(F.col("id").cast("int").alias("split_id"))
    found = ids.join(here, "split_id", "left").join(there, "split_id", "left").select("split_id", F.coalesce("local", "remote").alias("path"))
    return found.select("split_id", F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no source for split "), F.col("split_id").cast("string")))).otherwise(F.col("path")).alias("path"))


def _plain(path: Column | str) -> Column:
    """A path with one slash after its scheme, as file listings and users write it."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1:/")


def read_sources(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(split_id, file, block, line_no, text): the lines of sources (split_id, path), text or gzip files that Spark reads where they are.

    One scan of all files; nothing is fetched to a disk first, so there is nothing to delete. Only the paths come to the
    driver, as for any scan.
    """
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).toString().rstrip("/")
    named = sources.select("split_id", "path", F.when(F.col("path").startswith("/"), F.concat(F.lit(default), "path")).otherwise(F.col("path")).alias("whole"))
    paths = [r["path"] for r in named.select("path").toLocalIterator()]
    if not paths:
        raise ValueError("no source")
    lines = spark.read.options(**_WHOLE).option("lineSep", "\n").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))
    # the paths are broadcast: they are on the driver already, and lines don't move to the files' names
    return lines.join(F.broadcast(named.select("split_id", _plain("whole").alias("__file"))), _plain(F.col("file")) == F.col("__file")).drop("__file")


def read_packed(spark: SparkSession, sources: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(split_id, file, block, line_no, text), as read_sources() gives, of gzip files that many tasks unpack at once.

    The files' members are found first: each file is unpacked once for that and once to be read, by as many tasks as it has
    stretches. It pays where there are fewer files than cores, or they are very long; else read_sources() does.
    """
    paths = [r["path"] for r in sources.select("path").toLocalIterator()]
    if not paths:
        raise ValueError("no source")
    index = member_index(spark, paths, range_bytes=range_bytes)
    plain = lambda c: F.regexp_replace(_plain(c), "^file:", "")
    named = sources.select("split_id", plain(F.col("path")).alias("__file"))
    return read_members(written(index.join(named, plain(F.col("file")) == F.col("__file"))))


def dealt(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows by split, the same number of splits to each partition: one, up to 10,000 of them. A hash would put several together."""
    parts = max(1, min(len(ids), 10_000))
    places = rows.sparkSession.createDataFrame([(k, n % parts) for n, k in enumerate(ids)], "split_id int, __place int")
    return rows.join(F.broadcast(places), "split_id").repartitionById(parts, F.col("__place")).drop("__place")


def ingest(spark: SparkSession, sources: DataFrame, target: str, mode: str = "predownload") -> None:
    """Clean sources (split_id, path) into the split files of the target folder, which read_splits() reads. One job for all.

    The lines are cleaned where they are read, and meet by split in the one exchange.
    """
    lines = read_sources(spark, sources)
    value = F.array_join(kept_lines(F.col("text"), mode), "\n")
    # a line of the file may be several, or none once headers are out
    rows = lines.where(F.size(kept_lines(F.col("text"), mode)) > 0).select("split_id", "block", "line_no", value.alias("value"))
    ids = sorted({r[0] for r in sources.select("split_id").toLocalIterator()})
    rows = dealt(rows, ids).sortWithinPartitions("split_id", "block", "line_no")
    write_named(rows, target, "split_id", lambda k: f"commoncrawl-{k:04d}.txt", ids)


def add_missing(spark: SparkSession, wanted: DataFrame, target: str, mode: str = "predownload") -> list[int]:
    """Ingest those of wanted (split_id, path) that the target folder lacks, into a folder of their own in it; their numbers.

    A target that isn't there yet lacks all of them.
    """
    present = split_files(spark, target)
    new = missing(wanted, present).join(wanted, "split_id")
    ids = sorted(r[0] for r in new.select("split_id").toLocalIterator())
    if ids:
        ingest(spark, new, f"{target}/from-{ids[0]:04d}", mode)
    return ids


def split_files(spark: SparkSession, path: str) -> DataFrame:
    """(split_id, path) of the split files in a folder and its subfolders, empty ones too: Spark's own listing, nothing is read.

    None for a folder that doesn't exist.
    """
    fs, folder = files_of(spark, path)
    if not fs.exists(folder):
        return spark.createDataFrame([], "split_id int, path string")
    files = spark.read.format("binaryFile").options(**_WHOLE).option("recursiveFileLookup", "true").option("pathGlobFilter", "commoncrawl-*.txt").load(path)
    return spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(split_id(F.col("path")).alias("split_id"), "path")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, reducer_id, place) of a result: part files of lines ``key<tab>count``, cut at the last tab; blank lines don't count.

    place: the line's place among those of its file, from 1.
    """
    lines = spark.read.options(**_WHOLE).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    at = F.col("file")
    rid = F.coalesce(F.regexp_extract(at, r"reducer_id=(\d+)", 1).try_cast("int"), F.regexp_extract(at, r"part-(\d+)\.txt$", 1).try_cast("int"))
    v = F.col("value")
    return lines.where(F.trim(v) != "").select(v.substr(F.lit(1), F.char_length(v) - F.char_length(F.substring_index(v, "\t", -1)) - 1).alias("key"), F.substring_index(v, "\t", -1).cast("long").alias("n"), rid.alias("reducer_id"), "file", "block", "line_no").select("key", "n", "reducer_id", F.row_number().over(W.partitionBy("file").orderBy("block", "line_no")).cast("long").alias("place"))
