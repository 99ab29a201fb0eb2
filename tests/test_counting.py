import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscount.functions.tokens import decoded, latin1, reducer
from corpuscount.operators import compare, jobs, langdict, layout
from corpuscount.plans import ingestion
from corpuscount.runtime import setting
from corpuscount.sources import sinks, splits


def model(job, raws):
    out = Counter()
    lang = {}
    for k, ws in langdict.STOP_WORDS.items():
        for w in ws.split():
            lang.setdefault(w, set()).add(k)
    for raw in raws:
        toks = [t.decode() for t in re.findall(rb"[A-Za-z0-9]+", raw)]
        low = [t.lower() for t in toks]
        if job == "wordcount":
            out.update(low)
        elif job == "wordlen":
            out.update(str(len(t)) for t in toks)
        elif job == "bigram":
            out.update(" ".join(p) for p in zip(low, low[1:]))
        else:
            out.update(next(iter(lang[t])) for t in low if len(lang.get(t, ())) == 1)
    return dict(out)


def corpus(spark, raws):
    return spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "split_id int, content binary").select("split_id", latin1("content").alias("text"))


def got(df):
    return {r["key"]: r["n"] for r in df.collect()}


RAWS = [b"The cat's CAT_1 caf\xc3\xa9", b"a b\n\nc d", b"x", b"", b"x\xe9y", "\u212aelvin \u0130x".encode(), b"des que una con the le der los che LE", b"one\r\ntwo\x85three"]


@pytest.mark.parametrize("job", ["wordcount", "wordlen", "lang", "bigram"])
def test_jobs_equal_a_byte_level_model(spark, job):
    assert got(jobs.count(corpus(spark, RAWS), job)) == model(job, RAWS)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6))
def test_jobs_on_random_bytes(spark, raws):
    for job in ("wordcount", "bigram"):
        assert got(jobs.count(corpus(spark, raws), job)) == model(job, raws)


@pytest.mark.parametrize("parts", [1, 2, 7, 17])
def test_partitions_do_not_matter(spark, parts):
    assert got(jobs.count(corpus(spark, RAWS).repartition(parts), "bigram")) == model("bigram", RAWS)


def test_unknown_job(spark):
    with pytest.raises(ValueError):
        jobs.job("nope")
    with pytest.raises(ValueError):
        jobs.register(jobs.JobSpec("wordcount", None))


def test_one_tokenizer_call_in_each_plan(spark):
    for job in ("wordcount", "wordlen", "bigram"):
        plan = jobs.count(spark.createDataFrame([(1, "a b")], "split_id int, text string"), job)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan


def test_long_splits_by_line(spark):
    lines = ["a b", "", "--", "c", "d e f"]
    df = spark.createDataFrame([(s, k, x) for s in (0, 1) for k, x in enumerate(lines)], "split_id int, line_no int, text string")
    assert got(jobs.long_split_bigrams(df, ["line_no"])) == model("bigram", ["\n".join(lines).encode()] * 2)


def test_conservation_and_totals(spark):
    row = jobs.conservation(corpus(spark, RAWS)).first()
    assert row["conserved"] and row["tokens"] == sum(model("wordcount", RAWS).values())
    t = jobs.totals(jobs.count(corpus(spark, RAWS), "wordcount")).first()
    assert (t["distinct_keys"], t["total"]) == (len(model("wordcount", RAWS)), row["tokens"])


def test_dictionary(spark):
    words = langdict.language_words(spark).collect()
    assert len(words) == 77 and not {"des", "que", "una", "con"} & {r["word"] for r in words}


def test_layout_and_round_trip(spark, tmp_path):
    counts = jobs.count(corpus(spark, RAWS), "wordcount")
    for r in layout.assigned(counts, 5).collect():
        assert r["reducer_id"] == zlib.crc32(r["key"].encode()) % 5
    sinks.write_parts(counts, str(tmp_path / "p"), 5)
    back = splits.read_parts(spark, str(tmp_path / "p"))
    assert got(back) == got(counts)
    assert not layout.split_keys(back).count()
    assert not back.where(F.col("reducer_id") != reducer("key", 5)).count()
    assert sorted(f.name for f in (tmp_path / "p").iterdir() if f.suffix == ".txt" and not f.name.startswith(".")) == [f"part-{r}.txt" for r in range(5)]
    sinks.write_parts(counts.where("key = 'x'"), str(tmp_path / "q"), 3)
    assert sorted(f.stat().st_size for f in (tmp_path / "q").glob("part-*.txt")) == [0, 0, 4]
    for f in (tmp_path / "p").glob("part*"):
        n = [int(x.split("\t")[1]) for x in f.read_text().splitlines()]
        assert n == sorted(n, reverse=True)


@pytest.mark.parametrize("change", [[("a", 3), ("b", 1)], [("a", 2)], [("a", 2), ("b", 1), ("c", 1)], [("a", 1), ("b", 2)], []])
def test_comparison_fails_on_any_change(spark, change):
    a = spark.createDataFrame([("a", 2), ("b", 1)], "key string, n long")
    b = spark.createDataFrame(change, "key string, n long")
    assert compare.agree(a, a) and not compare.agree(a, b)


def test_comparison_is_one_exchange_without_a_join(spark):
    a, b = (spark.createDataFrame(x, "key string, n int") for x in ([("a", 2), ("b", 1), ("c", 4), ("e", 1), ("e", 2)], [("a", 2), ("b", 3), ("d", 5), ("e", 3)]))
    rows = {tuple(r) for r in compare.diff(a, b).collect()}
    assert rows == {("b", 1, 3, "differs"), ("c", 4, None, "missing"), ("d", None, 5, "extra")}
    assert {r["key"] for r in compare.mismatches(a, b).collect()} == {"b", "c"} and [tuple(r) for r in compare.extras(a, b).collect()] == [("d", 5)]
    assert tuple(compare.summary(a, b).first())[:7] == (4, 4, 10, 13, 1, 1, 1)
    plan = compare.diff(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_clean_modes(spark):
    lines = spark.createDataFrame([(x,) for x in ["WARC/1.0", "WARC-Type: conversion", "Content-Type: text/plain", "content-x: 1", "", "Hello"]], "text string")
    words = lambda mode: set(got(jobs.count(splits.cleaned(lines, mode).withColumn("split_id", F.lit(0)), "wordcount")))
    assert words("strict") == {"hello"}
    assert words("direct") == words("predownload") == {"warc", "type", "conversion", "content", "x", "1", "hello"}
    assert "plain" in words("ondemand")
    raw = spark.createDataFrame([(bytearray(b"x\xe9y"),)], "c binary")
    assert raw.select(decoded("c")).first()[0] == "xy"
    with pytest.raises(ValueError):
        splits.cleaned(lines, "other")


def test_split_files(spark, tmp_path):
    for k, raw in enumerate(RAWS):
        (tmp_path / f"commoncrawl-{k:04d}.txt").write_bytes(raw)
    (tmp_path / "other.txt").write_text("no")
    assert got(jobs.count(splits.read_splits(spark, str(tmp_path)), "bigram")) == model("bigram", RAWS)
    assert got(jobs.count(splits.read_splits(spark, str(tmp_path), 2), "wordcount")) == model("wordcount", RAWS[:2])
    remote = spark.createDataFrame([(8, "s3a://bucket/8")], "index long, path string")
    paths = {r["split_id"]: r["path"] for r in splits.acquire(spark, 9, str(tmp_path), remote).collect()}
    assert paths[8] == "s3a://bucket/8" and len(paths) == 9
    with pytest.raises(Exception, match="no source"):
        splits.acquire(spark, 10, str(tmp_path), remote).collect()


def test_gzip_members_and_path_list(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(x) for x in (b"one\n", b"two\n", b"three\n")))
    assert [r["text"] for r in splits.read_lines(spark, str(tmp_path / "a.gz")).collect()] == ["one", "two", "three"]
    (tmp_path / "paths.gz").write_bytes(gzip.compress(b"p0\n\np1\n"))
    assert splits.nth_path(splits.read_paths(spark, str(tmp_path / "paths.gz")), 1).first()["path"] == "p1"
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"Content-Type: x\r\nfo\xe9ur\nfive \xef\xbf\xbd\n"))
    both = spark.createDataFrame([(k, str(tmp_path / f"{x}.gz")) for k, x in ((0, "a"), (3, "b"))], "split_id int, path string")
    splits.ingest(spark, both.where("split_id = 0"), str(tmp_path / "out"))
    assert splits.add_missing(spark, both, str(tmp_path / "out")) == [3] and splits.add_missing(spark, both, str(tmp_path / "out")) == []
    got_ = {r["split_id"]: r["text"].encode("latin-1") for r in splits.read_splits(spark, str(tmp_path / "out")).collect()}
    assert got_ == {0: b"one\ntwo\nthree\n", 3: b"four" [:2] + b"ur\nfive \xef\xbf\xbd\n"}


def test_splits_beyond_four_digits_are_read_and_ingested_once(spark, tmp_path):
    """A crawl has more than 10,000 files; into a folder that isn't there yet, too."""
    import gzip

    for k in (1, 10_000):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(b"word%d\n" % k))
    wanted = spark.createDataFrame([(k, str(tmp_path / f"{k}.gz")) for k in (1, 10_000)], "split_id int, path string")
    out = str(tmp_path / "new" / "folder")
    assert splits.add_missing(spark, wanted, out) == [1, 10_000] and splits.add_missing(spark, wanted, out) == []
    assert {r["split_id"]: r["text"] for r in splits.read_splits(spark, out).collect()} == {1: "word1\n", 10_000: "word10000\n"}
    assert got(jobs.count(splits.read_splits(spark, out), "wordcount")) == {"word1": 1, "word10000": 1}
    assert [r["split_id"] for r in splits.split_sizes(spark, out, 9_999).collect()] == [1]


def test_sizes_of_splits_read_no_split_as_a_row(spark, tmp_path):
    raws = [b"one two\nthree", b"a\xe9b\r\nc d\n\n", b"\n", b"x" * 70_000 + b" y\n"]
    for k, raw in enumerate(raws):
        (tmp_path / f"commoncrawl-{k:04d}.txt").write_bytes(raw)
    (tmp_path / "other.txt").write_text("no")
    sizes = splits.split_sizes(spark, str(tmp_path))
    whole = splits.read_splits(spark, str(tmp_path)).collect()
    want = {(r["split_id"], len(r["text"]), len(re.findall("[A-Za-z0-9]+", r["text"]))) for r in whole}
    assert {tuple(r) for r in sizes.collect()} == want and len(want) == len(raws)
    assert {r["split_id"] for r in splits.split_sizes(spark, str(tmp_path), 2).collect()} == {0, 1}
    # the query takes its figures from lines too: a file of any size is no row
    query = ingestion.ingested_splits(spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in query._jdf.queryExecution().toString()


def test_few_labels_do_not_gather_in_a_task(spark):
    """Text of one language, or of one split, is dealt out over all cores."""
    rows = spark.range(0, 400, 1, 2).select(F.lit("en").alias("lang"), F.lit("a b").alias("text"))
    parts = jobs.spread(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) <= 150
    assert [tuple(r) for r in jobs.count(rows, "wordlen", ["lang"]).collect()] == [("en", "1", 800)]


def test_each_split_is_written_by_a_task_of_its_own(spark):
    """As a crawl and as taken in: split numbers aren't hashed, so no task has several while others have none."""
    paths = [r["path"] for r in ingestion._crawl(spark, "/root/testdata/sf0.001").collect()]
    assert len({re.search(r"part-(\d+)", p)[1] for p in paths}) == len(paths) == ingestion.SPLITS
    ids = [1, 2, 4, 5, 7, 9000]
    rows = spark.range(60).select(F.element_at(F.array(*map(F.lit, ids)), (F.col("id") % 6 + 1).cast("int")).alias("split_id"), "id")
    where = splits.dealt(rows, ids).withColumn("at", F.spark_partition_id()).groupBy("split_id").agg(F.collect_set("at").alias("at")).collect()
    assert sorted(r["split_id"] for r in where) == ids and sorted(x for r in where for x in r["at"]) == list(range(6))


def test_lines_of_sources_do_not_move_to_their_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    sources = spark.createDataFrame([(3, str(tmp_path / "a.txt"))], "split_id int, path string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # as where lines are many
        lines = splits.read_sources(spark, sources)
        assert "BroadcastHashJoin" in (plan := lines._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
    assert sorted((r["split_id"], r["text"]) for r in lines.collect()) == [(3, "x"), (3, "y")]


def test_text_that_is_dealt_out_is_not_moved(spark):
    rows = spark.range(9).selectExpr("id as split_id", "'a b' as text")
    plan = lambda **k: jobs.count(rows, "wordcount", **k)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan() and "Repartition" not in plan(dealt=True)
