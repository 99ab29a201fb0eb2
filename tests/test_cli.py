from corpuscount.cli import main


def test_count_then_validate(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "commoncrawl-0000.txt").write_text("the cat\nContent-Type: x\nsat")
    (src / "commoncrawl-0001.txt").write_text("le chat et the dog")
    for job in ("wordcount", "lang", "wordlen", "bigram"):
        out = str(tmp_path / job)
        common = ["-i", str(src), "-o", out, "-j", job]
        assert main(["count", *common, "-r", "3"]) == 0
        assert main(["validate", *common]) == 0
    assert main(["validate", "-i", str(src), "-o", str(tmp_path / "bigram"), "-j", "wordcount"]) == 1
    assert main(["validate", "-i", str(src), "-o", str(tmp_path / "bigram"), "-j", "bigram", "-n", "1"]) == 1
    assert main(["count", "-i", str(src), "-o", str(tmp_path / "c"), "--clean", "direct"]) == 0
    assert main(["validate", "-i", str(src), "-o", str(tmp_path / "c"), "--clean", "direct"]) == 0


def test_ingest_direct_read_and_crawl(spark, tmp_path):
    import gzip

    for k, x in enumerate(("the cat\nContent-Type: x\nsat", "le chat et the dog")):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(x.encode()))
    (tmp_path / "paths.gz").write_bytes(gzip.compress(b"0.gz\n\n1.gz\n"))
    listed = ["-i", str(tmp_path / "paths.gz"), "--base", str(tmp_path)]
    assert main(["ingest", *listed, "-o", str(tmp_path / "s"), "-n", "1"]) == 0
    assert main(["ingest", *listed, "-o", str(tmp_path / "s"), "--missing-only"]) == 0
    assert main(["count", "-i", str(tmp_path / "s"), "-o", str(tmp_path / "a"), "-j", "bigram"]) == 0
    assert main(["validate", *listed, "--direct-read", "-o", str(tmp_path / "a"), "-j", "bigram"]) == 0
    assert main(["crawl", *listed, "-o", str(tmp_path / "topic"), "--index", "1", "--max-lines", "1"]) == 0
    assert [r["value"] for r in spark.read.text(str(tmp_path / "topic")).collect()] == ["le chat et the dog"]


def test_one_command_takes_in_counts_validates_and_times(spark, tmp_path):
    import gzip

    from corpuscount.sources import records

    for k, x in enumerate(("the cat\nContent-Type: x\nsat", "le chat et the dog")):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(x.encode()))
    (tmp_path / "paths.gz").write_bytes(gzip.compress(b"0.gz\n\n1.gz\n"))
    whole = ["run", "-i", str(tmp_path / "paths.gz"), "--base", str(tmp_path), "--splits-dir", str(tmp_path / "s"), "-o", str(tmp_path / "o"), "-j", "wordcount", "-r", "3"]
    assert main([*whole, "-n", "1", "--log", str(tmp_path / "log")]) == 0
    log = records.read_log(spark, str(tmp_path / "log"))
    assert records.timing_records(log).count() == 1
    workers = records.worker_records(log).collect()
    assert {r["phase"] for r in workers} == {"MAP", "REDUCE"} and sum(r["rows_in"] for r in workers if r["phase"] == "MAP") == 1
    assert main(whole) == 0  # the second split is added
    assert sorted(f.name for f in (tmp_path / "s").rglob("*.txt") if not f.name.startswith(".")) == ["commoncrawl-0000.txt", "commoncrawl-0001.txt"]
