import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscount.plans import catalogue, ingestion
from corpuscount.runtime import setting
from corpuscount.streaming import crawl
from corpuscount.streaming import wordcount as stream

LINES = ["all streams lead to kafka", "hello kafka streams", "join kafka summit", "batch processing versus stream processing", "the cat sat on the mat the cat ran"]


def test_changelog_restart_and_fold(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, x in enumerate(LINES):
        (source / f"{k}.txt").write_text(x + "\n")
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    go = lambda: stream.run(stream.line_stream(spark, str(source), 1), log, state, timeout=120)
    go()
    rows = stream.read_changelog(spark, log)
    assert rows.count() == 21
    last = {r["key"]: r["n"] for r in stream.latest(rows).collect()}
    assert len(last) == 18 and sum(last.values()) == 25 and last["kafka"] == 3
    go()  # nothing new
    assert stream.read_changelog(spark, log).count() == 21
    (source / "9.txt").write_text("kafka kafka\n")
    go()
    assert {r["key"]: r["n"] for r in stream.latest(stream.read_changelog(spark, log)).collect()}["kafka"] == 5


def test_well_formed(spark):
    df = spark.createDataFrame([("a 1",), ("b",), ("c d 2",)], "value string")
    assert [tuple(r) for r in stream.well_formed(df).collect()] == [("a", 1)]


def counted(lines):
    out = {}
    for x in lines:
        for w in re.findall(rb"[A-Za-z0-9]+", x):
            out[w.decode().lower()] = out.get(w.decode().lower(), 0) + 1
    return out


def test_time_that_is_too_short_and_the_run_after_it(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(12):
        (source / f"{k}.txt").write_text(f"word{k} the\n" * 5)
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    with pytest.raises(TimeoutError, match="lines are left"):
        stream.run(stream.line_stream(spark, str(source), 1), log, state, timeout=0.5)
    stream.run(stream.line_stream(spark, str(source), 1), log, state, timeout=300)
    assert {r["key"]: r["n"] for r in stream.latest(stream.read_changelog(spark, log)).collect()} == {"the": 60} | {f"word{k}": 5 for k in range(12)}


def test_every_occurrence_and_the_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    texts = ["a b a\na\n", "b\n", "a c\n"]
    for k, x in enumerate(texts):
        (source / f"{k}.txt").write_text(x)
        stream.run(stream.line_stream(spark, str(source)), log, state, timeout=300, records=True)
    rows = stream.read_changelog(spark, log).orderBy("key", "n").collect()
    assert [(r["key"], r["n"], r["batch"]) for r in rows] == [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 2), ("b", 1, 0), ("b", 2, 1), ("c", 1, 2)]
    held = lambda batch: {r["key"]: r["n"] for r in stream.state_counts(spark, state, batch).collect()}
    assert held(None) == {"a": 4, "b": 2, "c": 1} and held(0) == {"a": 3, "b": 1}


@pytest.fixture
def indexed(spark, tmp_path):
    """A crawl of two files of many members, its lines but for headers, and its index."""
    rng, kept = random.Random(8), []
    for k in range(2):
        with open(tmp_path / f"{k}.gz", "wb") as f:
            for j in range(40):
                body = [b"word%d the" % rng.randrange(50) for _ in range(rng.randrange(0, 6))] + ([b"x\xe9y"] if j % 7 == 0 else [])
                kept += body
                f.write(gzip.compress(b"".join(x + b"\n" for x in (b"WARC/1.0", b"content-type: x", *body))))
    sources = spark.createDataFrame([(k, str(tmp_path / f"{k}.gz")) for k in range(2)], "split_id int, path string")
    crawl.line_index(spark, sources, str(tmp_path / "index"), range_bytes=500)
    return str(tmp_path / "index"), kept


def test_a_crawl_as_a_stream_goes_on_at_its_line(spark, tmp_path, indexed):
    index, kept = indexed
    rows = spark.read.parquet(index)
    assert rows.count() > 4 and rows.agg(F.sum("lines")).first()[0] == len(kept)
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    for most, step in ((10, 4), (10, 4), (57, 25), (0, 1000)):
        lines = crawl.crawl_stream(spark, index, state, per_batch=step, most=most)
        stream.run(lines, log, state, timeout=300, stepwise=True)
        got = {r["key"]: r["n"] for r in stream.latest(stream.read_changelog(spark, log)).collect()}
        assert got == counted(kept[: most or len(kept)])
    # 4, 4, 2; nothing; 25, 22; the rest
    assert [r["batch"] for r in stream.read_changelog(spark, log).select("batch").distinct().orderBy("batch").collect()] == list(range(6))


def test_a_crawl_stream_that_fails_says_so(spark, tmp_path, indexed):
    index, _ = indexed
    (tmp_path / "1.gz").write_bytes(b"no gzip")
    with pytest.raises(Exception, match="member"):
        stream.run(crawl.crawl_stream(spark, index, str(tmp_path / "s"), most=0), str(tmp_path / "l"), str(tmp_path / "s"), timeout=300, stepwise=True)


def test_staged_files_are_as_many_as_the_tables_parts(spark, tmp_path, monkeypatch):
    """No fixed number of files that grow with the table: neither before a restart nor for batches by files."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    for module in (ingestion, catalogue):
        monkeypatch.setattr(module, "shared_dir", lambda s: made.append(f"{tmp_path}/made-{len(made)}") or made[-1])
    with setting(spark, "spark.sql.files.maxPartitionBytes", "20000b"), setting(spark, "spark.sql.files.openCostInBytes", "20000b"):
        found = ingestion.stream_restart(spark, str(tmp_path))
        want = {r["key"]: r["n"] for r in catalogue.wordcount(spark, str(tmp_path)).collect()}
        assert {r["key"]: r["n"] for r in found.collect()} == want
        assert len(spark.read.text(made[0]).inputFiles()) >= 18
        folder = catalogue._staged(spark, str(tmp_path))
        assert len(spark.read.text(folder).inputFiles()) >= 9
        assert {r["key"]: r["n"] for r in catalogue.stream_wordcount(spark, str(tmp_path)).collect()} == want
