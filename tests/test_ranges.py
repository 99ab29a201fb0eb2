"""Files of any length: byte ranges with the token before them, and gzip files by their members."""

import gzip
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscount.operators import compare, jobs
from corpuscount.sources import ranges, sinks, splits

TOKEN = re.compile(rb"[A-Za-z0-9]+")


def got(counts):
    return {r["key"]: r["n"] for r in counts.collect()}


def bigrams(raw):
    t, out = [x.decode().lower() for x in TOKEN.findall(raw)], {}
    for a, b in zip(t, t[1:], strict=False):
        out[f"{a} {b}"] = out.get(f"{a} {b}", 0) + 1
    return out


def test_ranges_hold_every_byte_and_token_once():
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab1 \n\xe9-" if rng.random() < 0.5 else b"abc1") for _ in range(rng.randrange(1, 300)))
        step, block = rng.randrange(1, 60), rng.choice([1, 3, 16, 1000])
        rows = sorted(r for s in range(0, len(raw), step) for r in ranges.token_rows(io.BytesIO(raw), s, min(len(raw), s + step), block))
        assert b"".join(r[2] for r in rows) == raw
        seen = []
        for at, prior, row in rows:
            assert at == sum(len(r[2]) for r in rows if r[0] < at) and prior == (seen[-1] if seen else b"")
            seen += TOKEN.findall(row)
        assert seen == TOKEN.findall(raw)


def test_one_file_in_many_ranges(spark, tmp_path, monkeypatch):
    """Every job; tokens of 200,000 bytes, bytes that are no UTF-8, no token at all, an empty file, numbers of five digits."""
    monkeypatch.setattr(ranges, "LEAST_RANGE", 1)
    rng = random.Random(2)
    words = [b"the", b"Cat", b"x1", b"caf\xe9", b"a" * 50, b"\n", b"le"]
    long = b" ".join(rng.choice(words) for _ in range(30_000)) + b"-" + b"z" * 200_000 + b" the end"
    files = {0: long, 1: b" \n-" * 5000, 2: b"", 3: b"one", 10_000: b"the le"}
    for k, raw in files.items():
        (tmp_path / f"commoncrawl-{k:04d}.txt").write_bytes(raw)
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "._staged").mkdir()
    (tmp_path / "._staged" / "commoncrawl-0007.txt").write_text("no")
    rows = splits.read_ranges(spark, str(tmp_path), range_bytes=10_000)
    of_long = rows.where("split_id = 0")
    assert of_long.select(F.spark_partition_id()).distinct().count() > 10 and rows.where("length(text) > 1500000").count() == 0
    whole = b"".join(r["text"].encode("latin-1") for r in of_long.orderBy("start").collect())
    assert whole == long
    want = {}
    for raw in files.values():
        for k, n in bigrams(raw).items():
            want[k] = want.get(k, 0) + n
    assert got(jobs.count_ranges(rows, "bigram")) == want
    texts = spark.createDataFrame([(k, raw.decode("latin-1")) for k, raw in files.items()], "split_id int, text string")
    for name in ("wordcount", "wordlen", "lang"):
        assert got(jobs.count_ranges(rows, name)) == got(jobs.count(texts, name))
    assert {r["split_id"] for r in splits.read_ranges(spark, str(tmp_path), 3).select("split_id").distinct().collect()} == {0, 1}
    with pytest.raises(Exception, match="nothere"):
        splits.read_ranges(spark, str(tmp_path / "nothere")).count()


def test_members_of_gzip_files(monkeypatch):
    """Lines over members, empty members, members inside stored ones, padding; every range alone."""
    monkeypatch.setattr(ranges, "READ", 64)
    monkeypatch.setattr(ranges, "UNPACKED", 50)
    rng = random.Random(1)
    for t in range(200):
        parts = [bytes(rng.choice(b"ab\n ") for _ in range(rng.randrange(0, 120))) for _ in range(rng.randrange(1, 12))]
        if t % 3 == 0:
            parts = [p + b"\n" for p in parts]
        raw = b"".join(gzip.compress(p, rng.choice([0, 6])) for p in parts) + (b"\0" * 20 if t % 7 == 0 else b"")
        f, at = io.BytesIO(raw), 0
        for p in parts:
            end, n, last = ranges.member(f, at)
            assert (n, last) == (len(p), p[-1:]) and ranges.first_member(f, at, len(raw)) == at
            at = end
        want = b"".join(parts).split(b"\n")
        assert list(ranges.member_lines(f, 0, len(raw), True)) == (want if want[-1] else want[:-1])
    with pytest.raises(ranges.Damaged):
        list(ranges.member_lines(io.BytesIO(gzip.compress(b"x" * 500)[:-9]), 0, 10**6, True))


def test_one_gzip_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_RANGE", 1)
    rng = random.Random(3)
    parts = [b"".join(b"word%d " % rng.randrange(10**6) + (b"\n" if rng.random() < 0.1 else b"") for _ in range(200)) for _ in range(60)]
    stored = [gzip.compress(b"inner\n" * 3) + b"\n"]
    for k, (ps, level) in enumerate(((parts, 6), (parts[:20] + stored * 30, 0), ([b"".join(parts)], 6), ([b""], 6))):
        (tmp_path / f"{k}.gz").write_bytes(b"".join(gzip.compress(p, level) for p in ps))
    files = [str(tmp_path / f"{k}.gz") for k in range(4)]
    index = ranges.member_index(spark, files, range_bytes=3000)
    per = {r["file"][-4:]: r["k"] for r in index.groupBy("file").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert per["0.gz"] > 5 and per["2.gz"] == 1
    assert {r["members"] for r in index.where("file like '%0.gz'").agg(F.sum("members").alias("members")).collect()} == {60}
    sources = spark.createDataFrame(list(enumerate(files)), "split_id int, path string")
    mine, plain = splits.read_packed(spark, sources, range_bytes=3000), splits.read_sources(spark, sources)
    for k in range(4):
        text = lambda df: [r["raw"] for r in df.where(f"split_id = {k}").orderBy("block", "line_no").select(F.col("text").cast("binary").alias("raw")).collect()]  # noqa: B023,E731
        assert text(mine) == text(plain)
    assert mine.where("split_id = 0").select(F.spark_partition_id()).distinct().count() > 3
    (tmp_path / "bad.gz").write_bytes(gzip.compress(b"x" * 5000)[:-5])
    with pytest.raises(Exception, match="cut off"):
        splits.read_packed(spark, spark.createDataFrame([(0, str(tmp_path / "bad.gz"))], "split_id int, path string")).count()


def test_written_members_are_a_crawl(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, b"doc %d\n" % k) for k in range(20)], "split_id int, value binary").repartition(3, "split_id").sortWithinPartitions("split_id")
    ranges.write_members(rows, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["0.gz", "1.gz", "2.gz"]
    assert sorted(x for k in range(3) for x in gzip.open(tmp_path / "c" / f"{k}.gz").read().splitlines()) == sorted(b"doc %d" % k for k in range(20))


@pytest.mark.parametrize("segment", [None, 1, 3, 1000])
def test_long_splits_in_stretches(spark, segment):
    """Pairs across lines, stretches without a token and splits; null splits are a split."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), k, rng.choice(["a b", "", "--", "c", "a", "d e f"])) for k in range(200)]
    lines = spark.createDataFrame(rows, "split_id int, turn int, text string").repartition(4)
    seg = None if segment is None else F.floor(F.col("turn") / segment)
    want = {}
    for s in (0, 1, None):
        for k, n in bigrams("\n".join(t for x, _, t in rows if x == s).encode()).items():
            want[k] = want.get(k, 0) + n
    assert got(jobs.long_split_bigrams(lines, ["turn"], segment=seg)) == want


def test_ranks_of_all_keys(spark):
    rng = random.Random(6)
    rows = [(f"k{k}", rng.choice([1, 1, 2, 50])) for k in range(500)]
    counts = spark.createDataFrame(rows, "key string, n long")
    total, order = sum(n for _, n in rows), sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(tuple(r) for r in jobs.ranked_all(counts).select("rank", "key", "n").collect()) == [(i + 1, k, n) for i, (k, n) in enumerate(order)]
    assert {r["key"]: r["share"] for r in jobs.ranked_all(counts).collect()} == {k: pytest.approx(n / total, abs=1e-6) for k, n in rows}
    assert jobs.ranked_all(counts.where("n < 0")).count() == 0


def test_comparison_by_buckets(spark, monkeypatch):
    a = spark.createDataFrame([(f"k{k}", k) for k in range(400)], "key string, n long")
    b = a.where("n <> 17").withColumn("n", F.when(F.col("n") == 30, 31).otherwise(F.col("n"))).unionAll(spark.createDataFrame([("new", 1)], "key string, n long"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(compare.diff_by_buckets(a, b)) == rows(compare.diff(a, b)) and compare.diff(a, b).count() == 3
    odd = compare.differing_buckets(compare.checksums(a), compare.checksums(b))
    assert 0 < len(odd) <= 3 and compare.differing_buckets(compare.checksums(a), compare.checksums(a.repartition(7))) == []
    swapped = spark.createDataFrame([("x", 2), ("y", 1)], "key string, n long"), spark.createDataFrame([("x", 1), ("y", 2)], "key string, n long")
    assert compare.diff_by_buckets(*swapped, buckets=1).count() == 2  # totals are the same
    seen = []
    monkeypatch.setattr(compare, "diff", lambda x, y: seen.append(x.count() + y.count()) or x)
    compare.diff_by_buckets(a, a.repartition(3))
    assert seen == [0]  # equal results: nothing is compared key by key


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    target = str(tmp_path / "p")
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "key string, n long")
    sinks.write_parts(counts, target, 2)
    fails = counts.withColumn("n", F.when(F.col("key") == "b", F.raise_error("no")).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="no"):
        sinks.write_parts(fails, target, 2)
    assert got(splits.read_parts(spark, target)) == {"a": 2, "b": 1}
    sinks.write_parts(counts.where("key = 'a'"), target, 2)
    assert got(splits.read_parts(spark, target)) == {"a": 2} and not [p for p in tmp_path.iterdir() if p.name.endswith("._old")]


def test_crawl_of_the_command_line_has_more_files_and_not_longer_ones(spark, monkeypatch):
    import duckdb

    from corpuscount.plans import ingestion
    from corpuscount.plans.catalogue import ORACLES

    d, made = "/root/testdata/sf0.001", []
    whole = ingestion._texts(spark, d).selectExpr("sum(octet_length(value))").first()[0]
    crawl, most = ingestion._crawl, whole // 40
    monkeypatch.setattr(ingestion, "FILE", most)
    monkeypatch.setattr(ingestion, "_crawl", lambda *a: made.append(out := crawl(*a)) or out)
    got = {(r["key"], r["n"]) for r in ingestion.command_line(spark, d).collect()}
    paths = [r["path"] for r in made[0].collect()]
    largest = spark.read.text(paths).selectExpr("_metadata.file_path AS f", "octet_length(value) + 1 AS n").groupBy("f").sum("n").selectExpr("max(`sum(n)`)").first()[0]
    assert len(paths) > 32 and largest < 2.5 * most
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        assert got == set(db.execute(ORACLES["command_line"]).fetchall())
