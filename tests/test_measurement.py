import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from corpuscount.functions.forms import human_duration, load_triple, numeric_or, plain_host
from corpuscount.operators import fleet, scaling, stats, timing
from corpuscount.sources import records


#: Measured runs (workers, total, map, reduce seconds).
RUNS = ((1, 521.659, 490.546, 31.114), (2, 262.795, 245.258, 17.537), (4, 137.150, 126.892, 10.258), (8, 84.596, 77.686, 6.909), (16, 67.367, 60.986, 6.382))


def test_series(spark):
    rows = [(k, "a", "x", float(k + 1)) for k in range(4)] + [(9, "b", "y", 5.0), (10, "b", "z", 7.0)]
    s = spark.createDataFrame(rows, "seq long, label string, category string, sample double")
    a = {r["label"]: r for r in stats.series_stats(s).collect()}["a"]
    assert (a["mean"], a["median"]) == (2.5, 2.5)
    for k, v in (("p90", 3.7), ("p95", 3.85), ("stdev", 1.118034), ("cv", 0.447214)):
        assert a[k] == pytest.approx(v, abs=1e-6)
    one = stats.series_stats(s.where("seq = 0")).first()
    assert one["stdev"] == 0
    assert [(r["category"], r["total"]) for r in stats.category_rollup(s).collect()] == [("y", 12.0), ("x", 10.0)]
    assert {(r["kind"], r["name"]) for r in stats.bottleneck(s).collect()} == {("phase", "b"), ("category", "y")}


def test_recorder(spark, tmp_path):
    r = stats.Recorder()
    with r.phase("p", "io"):
        pass
    r.timed("t")(lambda: 1)()
    r.benchmark("b", lambda: None, min_time=0, warmup=1)
    assert {x["label"] for x in r.samples(spark).collect()} == {"p", "t", "b"}
    for k in range(6):
        r.record("q", 10**9 * 4**k, "io")
    assert "largest phase: q" in r.report(spark) and "noisy: q" in r.report(spark)
    r.save(str(tmp_path / "t.json"))
    saved = json.loads((tmp_path / "t.json").read_text())
    assert (saved["clock"], saved["unit"], saved["series"]["p"]["category"]) == ("perf_counter_ns", "ns", "io") and len(saved["series"]["q"]["samples"]) == 6
    r.save(str(tmp_path / "u.json"), spark)
    of_q = next(x for x in json.loads((tmp_path / "u.json").read_text())["stats"] if x["label"] == "q")
    assert (of_q["count"], of_q["minimum"], of_q["median"], of_q["category"]) == (6, 1e9, 40e9, "io")
    rows = stats.report(r.samples(spark)).collect()
    assert rows[0]["label"] == "q" and rows[0]["p95"] == 832e9 and sum(x["percent"] for x in rows) == pytest.approx(100)
    assert "1365.000 s" in r.report(spark) and "832.000 s" in r.report(spark) and stats.Recorder().report(spark).endswith("no samples")


def test_scaling(spark):
    runs = spark.createDataFrame([tuple(map(float, r)) for r in RUNS], "n_workers double, t_total double, t_map double, t_reduce double")
    assert scaling.fit_serial(runs) == pytest.approx(0.0651, abs=1e-3)
    solo = spark.createDataFrame([(1, 1.584), (2, 1.006), (4, 0.826)], "n_workers int, t_total double")
    assert scaling.fit_serial(solo) == pytest.approx(0.3493, abs=1e-3)
    assert {r["n_workers"]: round(r["speedup"], 2) for r in scaling.speedup(runs).collect()} == {1: 1.0, 2: 1.99, 4: 3.8, 8: 6.17, 16: 7.74}
    assert scaling.serial_fit(runs.where("n_workers > 99")).count() == 0
    assert {r["baseline"] for r in scaling.speedup(solo.where("n_workers > 1")).collect()} == {1.006}
    with pytest.raises(ValueError):
        scaling.valid_runs(solo.withColumn("t_total", F.lit(None).cast("double")))
    adj = spark.createDataFrame([(1, 10.0, 8.0, 2.0), (2, 6.0, 4.0, 1.0)], "n_workers int, t_total double, t_map_adj double, t_download_max double")
    assert {r["n_workers"]: r["speedup_adj"] for r in scaling.speedup(adj).collect()} == {1: 1.0, 2: 1.6}


def test_logs_and_results(spark, tmp_path):
    (tmp_path / "log").write_text('x TIMING: {"t_total": 3.0, "t_map": 2.0, "t_reduce": 1.0}\nWORKER_TIMING: {"phase": "map", "split_id": 1, "t_download": 2.5, "t_compute": 1.0}\nWORKER_TIMING: {"phase": "reduce", "t_compute": 2.0}\nTIMING: {broken\n')
    lines = records.read_log(spark, str(tmp_path / "log"))
    assert [r["t_total"] for r in records.timing_records(lines).collect()] == [3.0]
    sums = scaling.worker_sums(records.worker_records(lines)).first()
    assert (sums["t_compute"], sums["t_download_max"]) == (3.0, 2.5)
    (tmp_path / "new.json").write_text(json.dumps([{"n_workers": 1, "t_total": 2.0, "t_map": 1.5}, {"n_workers": 2, "t_total": None}]))
    (tmp_path / "old.json").write_text(json.dumps({"times": {"1": 2.0, "4": 1.0}}))
    assert [(r["n_workers"], r["t_map"], r["t_reduce"]) for r in scaling.valid_runs(records.read_runs(spark, str(tmp_path / "new.json"))).collect()] == [(1, 1.5, 0.0)]
    assert records.read_runs(spark, str(tmp_path / "old.json")).count() == 2


def test_fleet(spark, tmp_path):
    answers = spark.createDataFrame([("b", "0.5 0.25 1.0 1/2 3"), ("a", None), ("c", "1.5 0.75 3.0")], "host string, line string")
    loads = records.load_samples(answers)
    assert [r["host"] for r in fleet.by_host(loads).collect()] == ["b", "c", "a"]
    s = fleet.load_summary(loads).first()
    assert (s["hosts"], s["reachable"], s["mean_l1"]) == (3, 2, 1.0)
    (tmp_path / "m.json").write_text(json.dumps({"data": [["tp-1", True, 1, 2, 3], ["tp-2", True, 0, "x", 0], ["tp-3", False, 0, 0, 0], ["zz-1", True, 0, 0, 0], ["tp-4", True, 1]]}))
    m = records.read_machines(spark, str(tmp_path / "m.json"))
    assert [(r["host"], r["score"]) for r in fleet.least_occupied(m, ["tp-"], domain=".example.org").collect()] == [("tp-1.example.org", 6.0), ("tp-2.example.org", 999.0)]
    server = socketserver.TCPServer(("127.0.0.1", 0), type("Load", (socketserver.BaseRequestHandler,), {"handle": lambda self: self.request.sendall(b"0.5 0.25 1.0\n")}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = records.ask_hosts(spark.createDataFrame([("127.0.0.1",), ("host.invalid",)], "host string"), server.server_address[1], timeout=2)
    assert sorted(map(str, asked.collect())) == ["Row(host='127.0.0.1', l1=0.5, l5=0.25, l15=1.0)", "Row(host='host.invalid', l1=None, l5=None, l15=None)"]
    server.shutdown()
    (tmp_path / "hosts").write_text("a\n\n# b\nlocalhost\nc\n")
    assert [r["host"] for r in records.read_hosts(spark, str(tmp_path / "hosts")).collect()] == ["a", "c"]


def test_forms(spark):
    row = spark.sql("select '::ffff:1.2.3.4' as h, 'x' as bad, '1 2' as two").select(plain_host(F.col("h")), numeric_or(F.col("bad")), load_triple(F.col("two"))).first()
    assert tuple(row) == ("1.2.3.4", 999.0, None)
    took = spark.sql("select explode(array(5D, 1500D, 2500000D, 3000000000D)) as ns").select(human_duration(F.col("ns"))).collect()
    assert [r[0] for r in took] == ["5 ns", "1.500 µs", "2.500 ms", "3.000 s"]


def test_tasks_of_an_event_log(spark, tmp_path):
    """Failed, killed and repeated attempts count once; other jobs' tasks don't."""

    def end(stage, task, at, reason="Success", fetched=0, run=1000, rows=(5, 2)):
        metrics = {"Executor Run Time": run, "Input Metrics": {"Records Read": rows[0]}, "Output Metrics": {"Records Written": rows[1]}, "Shuffle Read Metrics": {"Fetch Wait Time": 100 * fetched, "Total Records Read": 0, "Remote Blocks Fetched": 0, "Local Blocks Fetched": fetched}, "Shuffle Write Metrics": {"Shuffle Write Time": 250_000_000, "Shuffle Records Written": 0}}
        info = {"Index": task, "Launch Time": at - run, "Finish Time": at, "Accumulables": [{"Name": "scan time", "Update": "300"}, {"Name": "x", "Update": [1]}]}
        return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0, "Task End Reason": {"Reason": reason}, "Task Info": info, "Task Metrics": metrics}

    job = {"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [1, 2], "Properties": {timing.MARK: "mine"}}
    events = [job, end(1, 0, 2000), end(1, 0, 2500), end(1, 1, 2200, "ExceptionFailure"), end(1, 1, 3000, run=400), end(2, 0, 4000, fetched=2), end(7, 0, 9000)]
    path = str(tmp_path / "log")
    (tmp_path / "log").write_text("\n".join([json.dumps(x, separators=(",", ":")) for x in events] + ["cut off {"]))
    tasks = timing.job_tasks(spark, path, "mine")
    assert sorted((r["phase"], r["stage_id"], r["task"], r["ended"]) for r in tasks.collect()) == [("MAP", 1, 0, 2500), ("MAP", 1, 1, 3000), ("REDUCE", 2, 0, 4000)]
    assert timing.job_tasks(spark, path).count() == 4
    assert tuple(timing.job_timing(tasks).first()) == (2.5, 1.5, 1.0)
    workers = {(r["phase"], r["split_id"], r["reducer_id"]): r for r in timing.worker_timings(tasks).collect()}
    one = workers["MAP", 0, None]
    assert (one["t_io_read"], one["t_io_write"], one["t_compute"], one["t_shuffle"], one["rows_in"], one["rows_out"]) == (0.3, 0.25, 0.45, 0.0, 5, 2)
    short = workers["MAP", 1, None]  # steps never exceed the task
    assert (short["t_io_read"], short["t_io_write"], short["t_compute"]) == (0.3, 0.1, 0.0)
    assert workers["REDUCE", None, 0]["t_shuffle"] == 0.2
    run = timing.run_record(tasks, 2, 2, 1).first()
    assert (run["n_workers"], run["t_total"], round(run["t_io_read"], 6), run["t_map_adj"]) == (2, 2.5, 0.9, 1.5)
    assert records.worker_records(timing.log_lines(tasks)).count() == 3 and records.timing_records(timing.log_lines(tasks)).first()["t_total"] == 2.5
    assert timing.job_timing(tasks.where("task < 0")).count() == 0


def test_timed_tasks_are_those_of_the_work(spark):
    tasks = timing.timed_tasks(spark, lambda: spark.range(0, 1000, 1, 5).groupBy((F.col("id") % 7).alias("k")).count().collect())
    got = tasks.groupBy("phase").agg(F.count("task").alias("n"), F.sum("rows_in").alias("rows")).collect()
    assert {r["phase"]: r["n"] for r in got}["MAP"] == 5 and {r["phase"]: r["rows"] for r in got}["REDUCE"] == 35
    with pytest.raises(ValueError), timing.event_log(spark):
        raise ValueError
    assert spark.sparkContext.getLocalProperty(timing.MARK) is None


@pytest.mark.parametrize(("sorted_", "few"), [(100_000, 10_000), (3, 10_000), (3, 2), (1, 0)])
def test_order_statistics_are_exact_without_a_buffer(spark, monkeypatch, sorted_, few):
    """By ranges cut once, or down to single values; with lists of the driver's or written tables."""
    import math
    import random

    monkeypatch.setattr(stats, "SORTED", sorted_)
    monkeypatch.setattr(stats, "FEW_ROWS", few)
    rng = random.Random(4)
    series = {"a": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(60)], "b": [1.5] * 30 + [0.0, -0.0, 5e-324, -5e-324, float("inf"), -float("inf")], "c": [rng.gauss(100, 0.001) for _ in range(41)], None: [2.0]}
    rows = [(k, v) for k, x in series.items() for v in x] + [("a", None), ("d", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "label string, sample double")
    ranks = [(k, r) for k, x in series.items() if k for r in (0, 1, len(x) // 2, len(x) - 1)]
    got = stats.order_statistics(df.where("label is not null"), spark.createDataFrame(ranks, "label string, rank long"))
    assert {(r["label"], r["rank"]): r["value"] for r in got.collect()} == {(k, r): sorted(series[k])[r] for k, r in ranks}

    def quantile(x, q):
        x, p = sorted(x), q * (len(x) - 1)
        low, high = x[math.floor(p)], x[math.ceil(p)]
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    found = stats.series_stats(df)
    for r in found.collect():
        assert [r[c] for c in ("median", "p90", "p95")] == [quantile(series[r["label"]], q) for q in (0.5, 0.9, 0.95)] and r["count"] == len(series[r["label"]])
    assert found.count() == 4 and "percentile" not in found._jdf.queryExecution().toString()
    assert stats.series_stats(df.where("sample > 1e308 and sample < 0")).count() == 0
