"""Statistics of timing series: rows (label, category, sample)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpuscount.runtime import written

#: A series is noisy from so many samples, beyond this coefficient of variation.
NOISY_COUNT, NOISY_CV = 5, 0.5
#: Up to so many rows, a few for each label, are held by the driver and broadcast; more are written and joined.
FEW_ROWS = 10_000
#: Values of a range that are put in order; of more the range is cut further.
SORTED = 100_000
#: The quantiles of a series.
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def _key(value: str) -> Column:
    """A double as a long of the same order, read without a sign; NaN comes last, and both zeros are one."""
    bits = F.expr(f"cast(java_method('java.lang.Double', 'doubleToLongBits', cast({value} as double) + 0.0D) as long)")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))


def _value(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(-(1 << 63)))).otherwise(F.bitwise_not(key))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _kept(df: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """The rows of df, worked out once: up to FEW_ROWS as a list of the driver's (given too), more as a written table."""
    rows = df.limit(FEW_ROWS + 1).collect()
    if len(rows) > FEW_ROWS:
        return written(df), None
    local = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], to_arrow_schema(df.schema))
    return df.sparkSession.createDataFrame(local, df.schema), rows


def order_statistics(samples: DataFrame, ranks: DataFrame, most: int | None = None) -> DataFrame:
    """(label, rank, value): the value of each wanted rank (0: the least) of each label, exactly. Labels aren't null.

    Values are selected by repeated counts: of the 2**16 ranges of all doubles, those that hold a wanted rank are found from
    the ranges' counts, then the 2**16 ranges within each of these, and so on, until none of them holds more than SORTED
    values (four times give single values): only these are put in order. So no task holds a label's values, whatever their
    number, and from the first counts on only the rows of the ranges found are looked at. most: values of the largest label,
    where that is known: no ranges are needed if it is small.
    """
    prefix = lambda shift: F.shiftrightunsigned("key", shift) if shift < 64 else F.lit(0).cast("long")
    rows = samples.where("sample is not null").select("label", _key("sample").alias("key"))
    found = ranks.select("label", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").cast("long").alias("left"))
    shift, wanted = 64, None
    while shift and (most is None or most > SORTED):
        if wanted is not None:
            rows = rows.withColumn("prefix", prefix(shift)).join(wanted, ["label", "prefix"], "left_semi").drop("prefix")
        if shift == 32:
            rows = written(rows)  # what is left is a small share
        counts = rows.groupBy("label", prefix(shift).alias("prefix"), prefix(shift - 16).alias("longer")).agg(F.count(F.lit(1)).alias("n"))
        before = W.partitionBy("label", "prefix").orderBy(_signed("longer")).rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
        met = found.join(counts, ["label", "prefix"]).where("left >= before and left < before + n")
        ranges, known = _kept(met.select("label", "rank", F.col("longer").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "n"))
        most = max((r["n"] for r in known), default=0) if known is not None else ranges.agg(F.max("n")).first()[0]
        found = ranges.drop("n")
        wanted = found.select("label", "prefix").distinct() if known is None else F.broadcast(found.select("label", "prefix").distinct())
        shift -= 16
    if not shift:
        return found.select("label", "rank", _value(F.col("prefix")).alias("value"))
    few = rows.withColumn("prefix", prefix(shift))
    few = few if wanted is None else few.join(wanted, ["label", "prefix"], "left_semi")
    order = F.row_number().over(W.partitionBy("label", "prefix").orderBy(_signed("key")))
    return few.withColumn("left", (order - 1).cast("long")).join(found, ["label", "prefix", "left"]).select("label", "rank", _value(F.col("key")).alias("value"))


def _signed(key: str) -> Column:
    """What is to be read without a sign, in the order of signed numbers."""
    return F.col(key).bitwiseXOR(F.lit(-(1 << 63)))


def series_stats(samples: DataFrame) -> DataFrame:
    """Per label: count, total, mean, median, population deviation, its ratio to the mean, extremes, and 90th and 95th percentile.

    Null samples don't count; a null label is a label too. Quantiles are exact, with linear interpolation between neighbours,
    and need no memory for a label's samples (order_statistics).
    """
    # labels are joined below: null ones under a name of their own
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("name"))
    named = samples.where("sample is not null").select(label.alias("label"), "sample")
    sums, known = _kept(named.groupBy("label").agg(F.count("sample").alias("count"), F.sum("sample").cast("double").alias("total"), F.avg("sample").alias("mean"), F.stddev_pop("sample").alias("stdev"), F.min("sample").cast("double").alias("minimum"), F.max("sample").cast("double").alias("maximum")))
    place = {c: (F.col("count") - 1) * F.lit(q) for c, q in QUANTILES.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    values = order_statistics(named, sums.select("label", F.explode(ranks).alias("rank")), max((r["count"] for r in known), default=0) if known is not None else None)
    at = values.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a quantile at most

    def between(p: Column) -> Column:
        low, high = F.col("at")[F.floor(p).cast("long")], F.col("at")[F.ceil(p).cast("long")]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    both = sums.join(at, "label").withColumns({c: between(p) for c, p in place.items()})
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("stdev") / F.col("mean"))
    return both.select(F.when(~F.col("label.none"), F.col("label.name")).alias("label"), "count", "total", "mean", "median", "stdev", "minimum", "maximum", "p90", "p95", cv.alias("cv"))


def category_rollup(samples: DataFrame, seq: str = "seq") -> DataFrame:
    """(category, total, percent), largest first; a label belongs to the category that it came with first."""
    owner = samples.groupBy("label").agg(F.min_by("category", seq).alias("category"), F.sum("sample").cast("double").alias("total"))
    sums = owner.groupBy("category").agg(F.sum("total").alias("total"))
    return sums.withColumn("percent", 100.0 * F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0)))).orderBy(F.desc("total"), "category")


def phases(samples: DataFrame) -> DataFrame:
    """(label, total, percent), largest first."""
    sums = samples.groupBy("label").agg(F.sum("sample").cast("double").alias("total"))
    return sums.withColumn("percent", 100.0 * F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0)))).orderBy(F.desc("total"), "label")


def bottleneck(samples: DataFrame, seq: str = "seq") -> DataFrame:
    """Two rows (kind, name, total): the phase and the category with the largest total."""
    one = lambda df, kind, name: df.agg(F.max_by(F.struct(name, "total"), F.struct("total", name)).alias("x")).select(F.lit(kind).alias("kind"), F.col(f"x.{name}").alias("name"), F.col("x.total").alias("total"))
    return one(phases(samples), "phase", "label").unionByName(one(category_rollup(samples, seq), "category", "category"))


def noisy(samples: DataFrame) -> DataFrame:
    return series_stats(samples).where((F.col("count") >= NOISY_COUNT) & (F.col("cv") > NOISY_CV))


def report(samples: DataFrame, seq: str = "seq") -> DataFrame:
    """(label, category, count, total, mean, p95, percent) of each series, largest total first; its category is the one that it came with first."""
    owner = samples.where("sample is not null").groupBy("label").agg(F.min_by("category", seq).alias("category"))
    known = series_stats(samples)
    both = known.join(owner, known["label"].eqNullSafe(owner["label"])).select(known["label"], "category", "count", "total", "mean", "p95")
    return both.withColumn("percent", 100.0 * F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0)))).orderBy(F.desc("total"), "label")


def _shown(ns: float) -> str:
    """A duration as human_duration() writes it, for this process's own report."""
    for size, unit in ((1e9, "s"), (1e6, "ms"), (1e3, "µs")):
        if ns >= size:
            return f"{ns / size:.3f} {unit}"
    return f"{int(ns)} ns"


class Recorder:
    """Takes samples in this process: phase(), timed(), record() and benchmark(); samples() gives them as rows."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, str, int]] = []

    def record(self, label: str, ns: int, category: str = "other") -> None:
        self.rows.append((len(self.rows), label, category, int(ns)))

    @contextmanager
    def phase(self, label: str, category: str = "other") -> Iterator[None]:
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.record(label, time.perf_counter_ns() - began, category)

    def timed(self, label: str | None = None, category: str = "other") -> Callable:
        def wrap(f: Callable) -> Callable:
            @wraps(f)
            def call(*a, **b):
                with self.phase(label or f.__name__, category):
                    return f(*a, **b)

            return call

        return wrap

    def benchmark(self, label: str, f: Callable[[], object], min_time: float = 0.5, warmup: int = 3, max_iter: int = 1_000_000, category: str = "other") -> None:
        """Call f until min_time seconds have been measured, after some calls that don't count."""
        for _ in range(warmup):
            f()
        spent = 0
        for _ in range(max_iter):
            began = time.perf_counter_ns()
            f()
            took = time.perf_counter_ns() - began
            self.record(label, took, category)
            spent += took
            if spent >= min_time * 1e9:
                break

    def report(self, spark: SparkSession, title: str = "timing report") -> str:
        """Lines of text: phases by falling total with count, mean, 95th percentile and share; categories; the largest of both; noisy series."""
        if not self.rows:
            return f"{title}: no samples"
        samples = self.samples(spark)
        show = lambda ns: _shown(float(ns))
        lines = [title, f"{'phase':<26}{'n':>6}{'total':>13}{'mean':>13}{'p95':>13}{'%':>7}"]
        lines += [f"{r['label']:<26}{r['count']:>6}{show(r['total']):>13}{show(r['mean']):>13}{show(r['p95']):>13}{r['percent']:>7.1f}" for r in report(samples).collect()]
        lines += [f"[{r['category']}] {show(r['total'])} ({r['percent']:.1f} %)" for r in category_rollup(samples).collect()]
        lines += [f"largest {r['kind']}: {r['name']} ({show(r['total'])})" for r in bottleneck(samples).orderBy("kind").collect()]
        return "\n".join(lines + [f"noisy: {r['label']} (cv {r['cv']:.2f})" for r in noisy(samples).orderBy("label").collect()])

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """As JSON: clock, unit, series (label -> category and samples in nanoseconds) and, with a session, the statistics of each."""
        series: dict[str, dict] = {}
        for _, label, category, ns in self.rows:
            series.setdefault(label, {"category": category, "samples": []})["samples"].append(ns)
        out = {"clock": "perf_counter_ns", "unit": "ns", "series": series}
        if spark is not None:
            out["stats"] = [{"label": r["label"], "category": series[r["label"]]["category"]} | {c: r[c] for c in r.asDict() if c != "label"} for r in series_stats(self.samples(spark)).orderBy("label").collect()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=1)

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "seq long, label string, category string, sample long")
