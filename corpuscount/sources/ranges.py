"""Files of any length in parts: splits by byte ranges, and gzip files by the members that they are made of.

Spark plans the parts and deals them out; a task opens its file where the part begins, through pyarrow's file systems
(local paths, file:, hdfs:, s3: and s3a:, gs:), and never holds more than a block of it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuscount.functions.tokens import latin1
from corpuscount.runtime import prepare

#: Bytes of a part, at most and (so that all cores have some) at least; of a row of a split; of what a task reads and unpacks at once.
RANGE, LEAST_RANGE, BLOCK, READ, UNPACKED = 64 << 20, 64 << 10, 128 << 10, 1 << 20, 4 << 20
_TOKEN = re.compile(rb"[A-Za-z0-9]+")
_NOT_TOKEN = re.compile(rb"[^A-Za-z0-9]")
#: Fixed value: how a gzip member begins (magic number, method deflate).
MEMBER = b"\x1f\x8b\x08"


def file_of(uri: str):
    """(file system, path) of a file, for pyarrow."""
    from pyarrow import fs

    plain = re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", plain))


def listed(path: str, name: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of the files of a folder and its subfolders whose own name fits; hidden ones don't count."""
    from pyarrow import fs

    system, root = file_of(path)
    scheme = m[0] if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path)) and not path.startswith("file:") else ""
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(scheme + info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = lambda p: p[len(root) :].strip("/").split("/")
    return sorted((scheme + x.path, x.size) for x in found if x.is_file and re.search(name, x.base_name) and not any(p[0] in "._" for p in inside(x.path)))


@dataclass
class Range(InputPartition):
    file: str
    size: int
    start: int
    stop: int


class _Source(DataSource):
    """Options: files (a JSON list of files and folders), name (a pattern for names in folders), rangeBytes, parts (how many at
    least, where files allow it)."""

    reads: type

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.name, self.step, self.parts = options.get("name", ""), int(options["rangeBytes"]), int(options["parts"])

    def partitions(self) -> list[Range]:
        files = [f for x in self.files for f in listed(x, self.name)]
        self.files = []  # tasks don't need the list
        step = min(self.step, max(LEAST_RANGE, sum(size for _, size in files) // self.parts))
        return [Range(f, size, s, min(size, s + step)) for f, size in files for s in range(0, size, step)] or [Range("", 0, 0, 0)]


def before(f, start: int) -> tuple[bytes, bool]:
    """(the last token that begins before start, as far as it goes before start; whether its last byte is the one before start)."""
    size = 64
    while start:
        low = max(0, start - size)
        f.seek(low)
        got = f.read(start - low)
        last = None
        for last in _TOKEN.finditer(got):  # noqa: B007
            pass
        if last and (last.start() or not low):
            return last[0], last.end() == len(got)
        if not low:
            break
        size *= 8
    return b"", False


def token_rows(f, start: int, stop: int, block: int = BLOCK) -> Iterator[tuple[int, bytes, bytes]]:
    """(where it begins, the token before it, its bytes) for pieces of a file, cut where no token is.

    A token that goes over a border belongs to the range in which it begins: the one before reads it to its end, this one
    begins after it and knows it as the token before.
    """
    prior, open_ = before(f, start)
    f.seek(start)
    at = start
    if open_:
        while got := f.read(block):
            end = _NOT_TOKEN.search(got)
            cut = end.start() if end else len(got)
            prior, at = prior + got[:cut], at + cut
            if end:
                break
        f.seek(at)
    while at < stop:
        got = f.read(min(block, stop - at))
        if not got:
            return
        parts = [got]
        while _TOKEN.match(parts[-1][-1:]):  # to the end of the last token
            more = f.read(64)
            end = _NOT_TOKEN.search(more)
            parts.append(more[: end.start()] if end else more)
            if end or not more:
                break
        row = b"".join(parts)
        yield at, prior, row
        at += len(row)
        f.seek(at)
        last = None
        for last in _TOKEN.finditer(row, max(0, len(row) - 4096)):  # noqa: B007
            pass
        if last is None or last.start() == len(row) - 4096:  # none near the end, or a long one
            for last in _TOKEN.finditer(row):  # noqa: B007
                pass
        prior = last[0] if last else prior


class _TokenReader(_Reader):
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, path = file_of(partition.file)
        with system.open_input_file(path) as f:
            for at, prior, row in token_rows(f, partition.start, partition.stop):
                cols = [pa.array([partition.file], pa.string()), pa.array([at], pa.int64()), pa.array([prior or None], pa.binary()), pa.array([row], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "start", "prior", "content"])


class TokenRanges(_Source):
    """Pieces of files that are cut where no token is: file, start (its first byte's place), prior (the token before), content."""

    reads = _TokenReader

    @classmethod
    def name(cls) -> str:
        return "token_ranges"

    def schema(self) -> str:
        return "file string, start long, prior binary, content binary"


def _load(spark: SparkSession, source: type[DataSource], files: list[str], name: str, range_bytes: int) -> DataFrame:
    prepare(spark)
    spark.dataSource.register(source)
    options = {"files": json.dumps(files), "name": name, "rangeBytes": range_bytes, "parts": 2 * spark.sparkContext.defaultParallelism}
    return spark.read.format(source.name()).options(**options).load()


def read_token_ranges(spark: SparkSession, path: str, name: str = r"^commoncrawl-.*\.txt$", range_bytes: int = RANGE) -> DataFrame:
    """(file, start, prior, text) of split files of any length: rows of some BLOCK bytes, one character a byte.

    The rows of a file are all of its bytes, in the order of start; no token lies in two rows. prior is the token before the
    row, null for a file's first, so pairs of tokens need neither a file in a row nor an order of rows. An empty file has none;
    a path that doesn't exist is an error.
    """
    rows = _load(spark, TokenRanges, [path], name, range_bytes)
    return rows.select("file", "start", latin1("prior").alias("prior"), latin1("content").alias("text"))


class Damaged(ValueError):
    pass


def member(f, start: int) -> tuple[int, int, bytes]:
    """(where it ends, bytes unpacked, the last of them) of the gzip member that begins at a place; Damaged if none does."""
    f.seek(start)
    unpack, at, n, last = zlib.decompressobj(31), start, 0, b""
    while not unpack.eof:
        got = unpack.unconsumed_tail
        if not got:
            got = f.read(READ)
            at += len(got)
        try:
            out = unpack.decompress(got, UNPACKED)  # of nothing more: what is left to put out
        except zlib.error as e:
            raise Damaged(f"no member at {start}: {e}") from None
        if not (got or out or unpack.eof):
            raise Damaged(f"a member at {start} is cut off")
        n, last = n + len(out), out[-1:] or last
    return at - len(unpack.unused_data), n, last


def first_member(f, start: int, stop: int) -> int | None:
    """Where the first member of a range begins: the first place that looks like one and unpacks to its end, checksum and all."""
    at = start
    while at < stop:
        f.seek(at)
        got = f.read(READ + len(MEMBER))
        k = got.find(MEMBER)
        while k >= 0 and at + k < stop:
            try:
                member(f, at + k)
                return at + k
            except Damaged:
                k = got.find(MEMBER, k + 1)
        at += READ
    return None


def padded(f, start: int) -> bool:
    """Whether only zeros follow."""
    f.seek(start)
    while got := f.read(READ):
        if got.strip(b"\0"):
            return False
    return True


class _MemberReader(_Reader):
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, path = file_of(partition.file)
        with system.open_input_file(path) as f:
            first = at = first_member(f, partition.start, partition.stop) if partition.start else 0
            members = total = 0
            last = b""
            while at is not None and at < partition.stop:
                try:
                    at, n, end = member(f, at)
                except Damaged:
                    if members and padded(f, at):
                        at = partition.size
                    elif not partition.start:
                        raise
                    # else what looked like a member inside another, or damage that whoever unpacks the whole file meets
                    break
                members, total, last = members + 1, total + n, end or last
        if members:
            row = {"file": partition.file, "size": partition.size, "start": first, "stop": at, "members": members, "n_bytes": total, "ends_line": last == b"\n" if last else None}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("size", "start", "stop", "members", "n_bytes")), ("ends_line", pa.bool_())]))


class MemberRanges(_Source):
    """What gzip members begin in each byte range of files: where the first begins and the last ends, how many, bytes unpacked."""

    reads = _MemberReader

    @classmethod
    def name(cls) -> str:
        return "gzip_member_ranges"

    def schema(self) -> str:
        return "file string, size long, start long, stop long, members long, n_bytes long, ends_line boolean"


def member_index(spark: SparkSession, files: list[str], name: str = r"\.gz$", range_bytes: int = RANGE) -> DataFrame:
    """(file, start, stop, members, n_bytes, begins_line) of gzip files: stretches of whole members that tasks can unpack alone.

    A row for each byte range in which a member begins, a few for each file; begins_line says whether a line begins there.
    The stretches of a file follow one another from its first byte to its last: what looks like a member inside another breaks
    that order, and then the file is one stretch (a range of one task, as without an index). Write the index where files are
    read more than once. A damaged file is an error.
    """
    rows = _load(spark, MemberRanges, files, name, range_bytes)
    order = W.partitionBy("file").orderBy("start")
    whole = W.partitionBy("file")
    fits = F.col("start") == F.lag("stop", 1, 0).over(order)
    rows = rows.withColumn("fits", fits).withColumn("sound", F.bool_and("fits").over(whole) & (F.max("stop").over(whole) == F.col("size")))
    line = F.coalesce(F.last("ends_line", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("begins_line", line).where("sound or start = 0")
    one = lambda c, other: F.when(F.col("sound"), F.col(c)).otherwise(other).alias(c)
    none = F.lit(None).cast("long")
    return rows.select("file", "start", one("stop", F.col("size")), one("members", none), one("n_bytes", none), "begins_line")


def unpacked(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(the member that it is of, bytes) of all members from a place on."""
    at = start
    f.seek(start)
    unpack, got, begun = zlib.decompressobj(31), b"", False
    while True:
        got = got or f.read(READ)
        if not begun and not got.strip(b"\0"):
            if not got:
                return
            got = b""
            continue
        try:
            out = unpack.decompress(got, UNPACKED)
        except zlib.error as e:
            raise Damaged(f"no member at {at}: {e}") from None
        if not (got or out or unpack.eof):
            raise Damaged(f"a member at {at} is cut off")
        begun = True
        yield at, out
        got = unpack.unconsumed_tail
        if unpack.eof:
            got = unpack.unused_data
            at = f.tell() - len(got)
            unpack, begun = zlib.decompressobj(31), False


def member_lines(f, start: int, stop: int, begins_line: bool) -> Iterator[bytes]:
    """The lines that begin in the members from start to stop; the last is read to its end, whatever member that is in."""
    rest: list[bytes] = []
    skip = not begins_line
    for at, out in unpacked(f, start):
        beyond = at >= stop
        if beyond and not rest and not skip:
            return
        if beyond:
            k = out.find(b"\n")
            rest.append(out if k < 0 else out[:k])
            if k < 0:
                continue
            if not skip:
                yield b"".join(rest)
            return
        lines = out.split(b"\n")
        for x in lines[:-1]:
            if not skip:
                yield b"".join((*rest, x))
            rest, skip = [], False
        if lines[-1]:
            rest.append(lines[-1])
    if rest and not skip:
        yield b"".join(rest)


def read_members(index: DataFrame) -> DataFrame:
    """(split_id, file, block, line_no, text): the lines of a member_index()'s files, each stretch by a task of its own.

    The index has a column split_id besides its own. block and line_no order the lines of a file. Lines may go from one member,
    or stretch, to the next: the task where one begins reads it to its end.
    """
    prepare(index.sparkSession)
    names = ["split_id", "file", "block", "line_no", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            system, path = file_of(r["file"])
            with system.open_input_file(path) as f:
                found, first = member_lines(f, r["start"], r["stop"], r["begins_line"]), 0
                while lines := some(found):
                    n = len(lines)
                    cols = [pa.array([r["split_id"]] * n, pa.int32()), pa.array([r["file"]] * n), pa.array([r["start"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    first += n

    dealt = index.select(F.col("split_id").cast("int").alias("split_id"), "file", "start", "stop", "begins_line").repartition(max(1, min(10_000, index.count())))
    return dealt.mapInArrow(run, "split_id int, file string, block long, line_no long, content binary").select(*names[:4], F.col("content").cast("string").alias("text"))


def some(lines: Iterator[bytes], most: int = 4096) -> list[bytes]:
    """The next lines: some BLOCK bytes, and no more lines than most."""
    out, size = [], 0
    for x in lines:
        out.append(x)
        size += len(x)
        if size >= BLOCK or len(out) >= min(most, 4096):
            break
    return out


def write_members(rows: DataFrame, folder: str, column: str = "split_id") -> None:
    """Gzip files named by the number in ``column``, with a member for each row's value (binary), as crawls are written.

    The rows of a number lie in one partition, in order. A file is written under a name of its own and then renamed, so a task
    that is run again, or twice, leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_of(folder)
        system.create_dir(root, recursive=True)
        open_, number, made = None, None, None

        def close() -> None:
            if open_ is not None:
                open_.close()
                system.move(made, f"{root}/{number}.gz")

        for b in batches:
            for k, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != number:
                    close()
                    number, made = k, f"{root}/.{k}-{uuid.uuid4().hex}"
                    open_ = system.open_output_stream(made, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                open_.write(pack.compress(value) + pack.flush())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    prepare(rows.sparkSession)
    rows.select(F.col(column), F.col("value").cast("binary")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
