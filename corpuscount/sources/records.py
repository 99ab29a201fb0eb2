"""Readers of telemetry, scaling results, host lists, loads and machine lists."""

from __future__ import annotations

import socket
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.functions.forms import load_triple

TIMING = "t_total double, t_map double, t_reduce double"
WORKER_TIMING = "phase string, stage_id int, split_id int, reducer_id int, t_download double, t_clean double, t_io_read double, t_compute double, t_io_write double, t_shuffle double, rows_in long, rows_out long"
RUN = "n_workers int, n_splits int, n_reducers int, t_total double, t_map double, t_reduce double, crawl_id string, t_map_adj double, t_download double, t_download_max double, t_clean double, t_io_read double, t_compute double, t_shuffle double, t_io_write double"


def _records(lines: DataFrame, mark: str, schema: str) -> DataFrame:
    found = lines.select(F.regexp_extract("value", mark + r"\s*(\{.*\})", 1).alias("raw")).where("raw <> ''")
    return found.select(F.from_json("raw", schema).alias("r"), F.from_json("raw", "map<string,string>").alias("m")).where(F.col("m").isNotNull() & (F.size("m") > 0)).select("r.*")


def timing_records(lines: DataFrame) -> DataFrame:
    """Master records in log lines (``value``); malformed ones don't count."""
    return _records(lines, r"(?:^|[^_])TIMING:", TIMING)


def worker_records(lines: DataFrame) -> DataFrame:
    return _records(lines, "WORKER_TIMING:", WORKER_TIMING)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Scaling results: a list of records, or the older form {"times": {workers: seconds}}; phases that lack are 0."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    new = raw.where(F.col("v").startswith("[")).select(F.explode(F.from_json("v", f"array<struct<{_typed(RUN)}>>")).alias("r")).select("r.*")
    times = raw.where(F.col("v").startswith("{")).select(F.explode(F.map_entries(F.from_json("v", "struct<times: map<string,double>>")["times"])).alias("e"))
    old = times.select(F.col("e.key").cast("int").alias("n_workers"), F.col("e.value").alias("t_total"))
    runs = new.unionByName(old, allowMissingColumns=True)
    return runs.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("t_map", "t_reduce")})


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(x.split()) for x in ddl.split(","))


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(host): lines but for blank ones, comments and localhost."""
    return spark.read.text(path).select(F.trim("value").alias("host")).where("host <> '' and not startswith(host, '#') and host <> 'localhost'")


def load_samples(answers: DataFrame) -> DataFrame:
    """(host, l1, l5, l15) from rows (host, line): what a host's load file says; nulls where it gave no answer."""
    return answers.select("host", load_triple(F.col("line")).alias("x")).select("host", "x.l1", "x.l5", "x.l15")


def read_load(spark: SparkSession, path: str, host: Column) -> DataFrame:
    """Load files as Linux keeps them, one line each; ``host`` says from the file's path whose it is."""
    return load_samples(spark.read.text(path).select(host.alias("host"), F.col("value").alias("line")))


def ask_hosts(hosts: DataFrame, port: int, timeout: float = 3.0, at_once: int = 20) -> DataFrame:
    """(host, l1, l5, l15) from the load service of every host: a line of text on a TCP port; nulls where a host doesn't answer.

    Each task asks its own hosts, ``at_once`` at a time. A refused or late answer is data, not a failure.
    """

    def ask(host: str) -> str | None:
        try:
            with socket.create_connection((host, port), timeout=timeout) as s:
                s.settimeout(timeout)
                got = b""
                while chunk := s.recv(4096):
                    got += chunk
                return got.decode("utf-8", "ignore").strip() or None
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield pd.DataFrame({"host": b["host"], "line": list(pool.map(ask, b["host"]))})

    return load_samples(hosts.select("host").mapInPandas(run, "host string, line string"))


def with_missing(hosts: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for every host: its sample, or nulls where it has none."""
    return hosts.select("host").distinct().join(samples, "host", "left")


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    """(m): the rows under ``data`` of a machine list in JSON, each an array of strings."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.from_json(F.col("value"), "struct<data: array<string>>")["data"]
    return raw.select(F.explode(rows).alias("row")).select(F.from_json("row", "array<string>").alias("m"))
