"""The catalogue: each query over the test tables, and SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.functions.forms import amdahl, human_duration, karp_flatt
from corpuscount.functions.tokens import reducer
from corpuscount.operators import compare, fleet, jobs, langdict, layout, scaling, stats
from corpuscount.runtime import shared_dir, written
from corpuscount.sources import splits
from corpuscount.streaming import wordcount as stream

REDUCERS = 8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.corpus_of(_table(spark, d, "documents"), "doc_id")


_STOP = ", ".join(f"('{w}', '{lang}')" for lang, ws in langdict.STOP_WORDS.items() for w in ws.split())
_SW = f"raw AS (SELECT * FROM (VALUES {_STOP}) AS v(word, lang)), sw AS (SELECT word, min(lang) AS lang FROM raw GROUP BY word HAVING count(DISTINCT lang) = 1)"
_TOK = "tok AS (SELECT doc_id, lang AS doc_lang, source, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS t FROM documents)"
_WC = f"{_TOK}, wc AS (SELECT t AS key, count(*) AS n FROM tok GROUP BY t)"
_WL = f"{_TOK}, wl AS (SELECT CAST(length(t) AS VARCHAR) AS key, count(*) AS n FROM tok GROUP BY 1)"
_LG = f"{_TOK}, {_SW}, lg AS (SELECT sw.lang AS key, count(*) AS n FROM tok JOIN sw ON tok.t = sw.word GROUP BY 1)"
_BG = """arr AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS a FROM documents),
bt AS (SELECT unnest(list_transform(range(1, len(a)), lambda i: lower(a[i] || ' ' || a[i + 1]))) AS key FROM arr WHERE len(a) > 1),
bg AS (SELECT key, count(*) AS n FROM bt GROUP BY key)"""
_CRC = """ct AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
rid AS (SELECT key, n, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c // 256))) % 8 AS INTEGER) AS reducer_id FROM wc, ct)"""
_RANK = "SELECT row_number() OVER (ORDER BY n DESC, key) AS rank, key, n, round(n / sum(n) OVER (), 6) AS share FROM {}"


@query(f"WITH {_WC} SELECT key, n FROM wc")
def wordcount(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_docs(spark, d), "wordcount")


@query(f"WITH {_WL} SELECT key, n FROM wl")
def wordlen(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_docs(spark, d), "wordlen")


@query(f"WITH {_LG} SELECT key, n FROM lg")
def lang_hits(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_docs(spark, d), "lang")


@query(f"WITH {_BG} SELECT key, n FROM bg")
def bigram(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_docs(spark, d), "bigram")


@query(f"WITH {_WC} SELECT key, n FROM wc ORDER BY n DESC, key LIMIT 20")
def wordcount_topn(spark: SparkSession, d: str) -> DataFrame:
    return jobs.top(jobs.count(_docs(spark, d), "wordcount"), 20)


@query(f"WITH {_BG} SELECT key, n FROM bg ORDER BY n DESC, key LIMIT 20")
def bigram_topn(spark: SparkSession, d: str) -> DataFrame:
    return jobs.top(jobs.count(_docs(spark, d), "bigram"), 20)


@query(f"WITH {_LG} {_RANK.format('lg')}")
def lang_rank(spark: SparkSession, d: str) -> DataFrame:
    return jobs.ranked(jobs.count(_docs(spark, d), "lang"))


@query(f"WITH {_WL} {_RANK.format('wl')}")
def wordlen_share(spark: SparkSession, d: str) -> DataFrame:
    return jobs.ranked(jobs.count(_docs(spark, d), "wordlen"))


@query(f"WITH {_WC} {_RANK.format('wc')}")
def wordcount_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank and share of every word."""
    return jobs.ranked_all(jobs.count(_docs(spark, d), "wordcount"))


def _with_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, every third document with header lines before it: the tables have none of their own."""
    heads = F.lit("WARC/1.0\nWARC-Type: conversion\nContent-Type: text/plain\ncontent-length: 7\nMetadata-x: y\n")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(heads, F.col("text"))).otherwise(F.col("text"))
    lines = _table(spark, d, "documents").select("doc_id", F.explode(F.split(text, "\n")).alias("text"))
    return lines.withColumnRenamed("doc_id", "split_id")


_HEADED = r"""lines AS (SELECT unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN concat('WARC/1.0', chr(10), 'WARC-Type: conversion', chr(10), 'Content-Type: text/plain', chr(10), 'content-length: 7', chr(10), 'Metadata-x: y', chr(10), text) ELSE text END, chr(10))) AS line FROM documents)"""
_LINES = "t AS (SELECT lower(unnest(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS key FROM kept) SELECT key, count(*) AS n FROM t GROUP BY key"


@query(f"WITH {_HEADED}, kept AS (SELECT line FROM lines WHERE NOT regexp_matches(line, '^(WARC/|CONTENT-|Content-|Metadata-)')), {_LINES}")
def wordcount_strip_direct(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(splits.cleaned(_with_headers(spark, d), "direct"), "wordcount")


@query(f"WITH {_HEADED}, kept AS (SELECT line FROM lines WHERE NOT regexp_matches(lower(line), '^(warc/|warc-|content-|metadata-)')), {_LINES}")
def wordcount_strip_strict(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(splits.cleaned(_with_headers(spark, d), "strict"), "wordcount")


@query("""WITH c AS (SELECT conv_id, regexp_extract_all(string_agg(text, chr(10) ORDER BY turn), '[A-Za-z0-9]+') AS a FROM conversations GROUP BY conv_id),
t AS (SELECT unnest(list_transform(range(1, len(a)), lambda i: lower(a[i] || ' ' || a[i + 1]))) AS key FROM c WHERE len(a) > 1) SELECT key, count(*) AS n FROM t GROUP BY key""")
def bigram_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Turns are lines of a split that may be long: pairs go across turns, and no conversation is held in one row."""
    return jobs.long_split_bigrams(_table(spark, d, "conversations").select(F.col("conv_id").alias("split_id"), "turn", "text"), ["turn"], segment=F.floor(F.col("turn") / 1000))


@query("WITH t AS (SELECT lower(unnest(regexp_extract_all(html, '[A-Za-z0-9]+'))) AS key FROM pages) SELECT key, count(*) AS n FROM t GROUP BY key")
def wordcount_pages(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(jobs.corpus_of(_table(spark, d, "pages"), "page_id", "html"), "wordcount")


@query(f"WITH {_TOK}, {_SW} SELECT source, sw.lang AS key, count(*) AS n FROM tok JOIN sw ON tok.t = sw.word GROUP BY 1, 2")
def lang_by_source(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_table(spark, d, "documents").select("source", "text"), "lang", ["source"])


@query(f"WITH {_TOK} SELECT doc_lang, CAST(length(t) AS VARCHAR) AS key, count(*) AS n FROM tok GROUP BY 1, 2")
def wordlen_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(_table(spark, d, "documents").select(F.col("lang").alias("doc_lang"), "text"), "wordlen", ["doc_lang"])


@query(f"WITH {_WC}, {_CRC} SELECT key, n, reducer_id FROM rid")
def reducer_assignment(spark: SparkSession, d: str) -> DataFrame:
    return layout.assigned(wordcount(spark, d), REDUCERS)


@query(f"WITH {_WC}, {_CRC} SELECT reducer_id, count(*) AS keys, CAST(sum(n) AS BIGINT) AS total FROM rid GROUP BY 1")
def reducer_load(spark: SparkSession, d: str) -> DataFrame:
    return layout.load(wordcount(spark, d), REDUCERS)


def _misplaced(spark: SparkSession, d: str) -> DataFrame:
    """Written parts, read again, with every key of 12 letters in a second reducer's part as well."""
    from corpuscount.sources.sinks import write_parts

    path = shared_dir(spark)
    write_parts(wordcount(spark, d), path, REDUCERS)
    parts = splits.read_parts(spark, path).select("key", "n", "reducer_id")
    return parts.unionByName(parts.where(F.length("key") == 12).withColumn("reducer_id", ((F.col("reducer_id") + 1) % REDUCERS).cast("int")))


@query(f"WITH {_WC} SELECT key, CAST(2 AS BIGINT) AS reducers FROM wc WHERE length(key) = 12")
def reducer_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Keys that lie in more than one part: those that were put there, and no others."""
    return layout.split_keys(_misplaced(spark, d))


@query(f"WITH {_WC} SELECT key, n, CAST(row_number() OVER (PARTITION BY reducer_id ORDER BY n DESC, key) AS BIGINT) AS place FROM (WITH {_CRC} SELECT * FROM rid) AS r")
def parts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts as they were written: each key with its place in its part."""
    from corpuscount.sources.sinks import write_parts

    path = shared_dir(spark)
    write_parts(wordcount(spark, d), path, REDUCERS)
    return splits.read_parts(spark, path).select("key", "n", "place")


@query(f"""WITH {_TOK}, {_SW}, {_BG}, k AS (SELECT 'wordcount' AS job, t AS key FROM tok UNION ALL SELECT 'wordlen', CAST(length(t) AS VARCHAR) FROM tok UNION ALL SELECT 'lang', sw.lang FROM tok JOIN sw ON tok.t = sw.word UNION ALL SELECT 'bigram', key FROM bt)
SELECT job, count(DISTINCT key) AS distinct_keys, count(*) AS total FROM k GROUP BY job""")
def job_totals(spark: SparkSession, d: str) -> DataFrame:
    # lengths and languages are those of the counted words: two passes over the text, not four
    words = jobs.count(_docs(spark, d), "wordcount")
    lengths = words.groupBy(F.length("key").alias("key")).agg(F.sum("n").alias("n"))
    langs = words.join(F.broadcast(langdict.language_words(spark)), words["key"] == F.col("word")).groupBy(F.col("lang").alias("key")).agg(F.sum("n").alias("n"))
    out = None
    for name, counts in (("wordcount", words), ("lang", langs), ("wordlen", lengths), ("bigram", jobs.count(_docs(spark, d), "bigram"))):
        one = jobs.totals(counts).select(F.lit(name).alias("job"), "distinct_keys", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents),
s AS (SELECT CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(greatest(t - 1, 0)) AS BIGINT) AS pairs FROM a)
SELECT tokens, pairs, tokens AS words, tokens AS lengths, pairs AS bigrams, true AS conserved FROM s""")
def conservation(spark: SparkSession, d: str) -> DataFrame:
    return jobs.conservation(_docs(spark, d))


def _changed(counts: DataFrame) -> DataFrame:
    """A copy with some keys dropped, some counts raised and one key added."""
    c = F.col("n") + 7 * F.length("key")
    changed = counts.where(c % 97 != 0).select("key", F.when(c % 89 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return changed.unionByName(counts.sparkSession.sql("select '#extra' as key, 5L as n"))


_PERTURBED = f"""{_WC}, b AS (SELECT key, CASE WHEN (n + 7 * length(key)) % 89 = 0 THEN n + 1 ELSE n END AS n FROM wc WHERE (n + 7 * length(key)) % 97 <> 0 UNION ALL SELECT '#extra', 5),
u AS (SELECT key, n AS expected, CAST(NULL AS BIGINT) AS actual FROM wc UNION ALL SELECT key, NULL, n FROM b),
g AS (SELECT key, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual FROM u GROUP BY key),
f AS (SELECT key, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'differs' END AS status FROM g WHERE expected IS NULL OR actual IS NULL OR expected <> actual)"""


@query(f"WITH {_PERTURBED} SELECT key, expected, actual, status FROM f")
def compare_diff(spark: SparkSession, d: str) -> DataFrame:
    a = wordcount(spark, d)
    return compare.diff(a, _changed(a))


@query(f"WITH {_PERTURBED} SELECT key, expected, actual, status FROM f")
def compare_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same by checksums: only the buckets of keys that differ are compared key by key."""
    a = written(wordcount(spark, d))
    return compare.diff_by_buckets(a, _changed(a))


@query(f"WITH {_PERTURBED} SELECT key, expected, actual, status FROM f WHERE status <> 'extra'")
def compare_mismatches(spark: SparkSession, d: str) -> DataFrame:
    a = wordcount(spark, d)
    return compare.mismatches(a, _changed(a))


@query(f"WITH {_PERTURBED} SELECT key, actual AS n FROM f WHERE status = 'extra'")
def compare_extra(spark: SparkSession, d: str) -> DataFrame:
    a = wordcount(spark, d)
    return compare.extras(a, _changed(a))


@query(f"""WITH {_PERTURBED} SELECT count(expected) AS expected_keys, count(actual) AS actual_keys, CAST(sum(expected) AS BIGINT) AS expected_total, CAST(sum(actual) AS BIGINT) AS actual_total,
count(*) FILTER (WHERE expected <> actual) AS differing, count(*) FILTER (WHERE actual IS NULL) AS missing, count(*) FILTER (WHERE expected IS NULL) AS extra, false AS equal FROM g""")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    a = wordcount(spark, d)
    return compare.summary(a, _changed(a))


@query("SELECT CAST(r.i AS BIGINT) AS split_id FROM (SELECT unnest(range((SELECT max(doc_id) + 11 FROM documents))) AS i) AS r WHERE r.i NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def splits_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("split_id"))
    wanted = docs.agg((F.max("split_id") + 10).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("split_id"))
    return splits.missing(wanted, docs.where("split_id % 10 <> 0"))


@query("WITH t AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS key FROM documents WHERE doc_id < 16) SELECT key, count(*) AS n FROM t GROUP BY key")
def split_subset(spark: SparkSession, d: str) -> DataFrame:
    """Only the first splits, as a validation of the first N does: the limit is the feature."""
    return jobs.count(splits.below(_docs(spark, d), 16), "wordcount")


@query(f"WITH {_TOK}, {_SW} SELECT word, lang, count(tok.t) AS n FROM sw LEFT JOIN tok ON tok.t = sw.word GROUP BY 1, 2")
def lang_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Each word that tells a language, and how often it occurs, if at all."""
    hits = jobs.count(_docs(spark, d), "wordcount")
    found = langdict.language_words(spark).join(hits, F.col("word") == F.col("key"), "left")
    return found.select("word", "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT event_type AS key, CAST(arg_max(event_id * 7919 % 1000 - event_id, event_id) AS BIGINT) AS n FROM events GROUP BY 1")
def changelog_last(spark: SparkSession, d: str) -> DataFrame:
    """Values that rise and fall: the last one counts, not the largest."""
    k = F.col("event_id")
    return stream.latest(_table(spark, d, "events").select(F.col("event_type").alias("key"), (k * 7919 % 1000 - k).alias("n"), k.alias("seq")), "seq")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("event_id") % 2 == 0, "io").otherwise("cpu")
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("label"), category.alias("category"), F.col("value").alias("sample"))


_SAMPLES = "s AS (SELECT event_id AS seq, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'io' ELSE 'cpu' END AS category, value AS sample FROM events)"
_STATS = """st AS (SELECT label, count(sample) AS count, sum(sample) AS total, avg(sample) AS mean, quantile_cont(sample, 0.5) AS median, stddev_pop(sample) AS stdev, min(sample) AS minimum, max(sample) AS maximum, quantile_cont(sample, 0.9) AS p90, quantile_cont(sample, 0.95) AS p95,
CASE WHEN avg(sample) = 0 THEN 0.0 ELSE stddev_pop(sample) / avg(sample) END AS cv FROM s WHERE sample IS NOT NULL GROUP BY label)"""
_STAT_COLS = ("total", "mean", "median", "stdev", "minimum", "maximum", "p90", "p95", "cv")
_STAT_SQL = "label, count, " + ", ".join(f"round({c}, 4) AS {c}" for c in _STAT_COLS)


def _r(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"WITH {_SAMPLES}, {_STATS} SELECT {_STAT_SQL} FROM st")
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.series_stats(_samples(spark, d)), *_STAT_COLS)


@query(f"WITH {_SAMPLES}, {_STATS} SELECT {_STAT_SQL} FROM st WHERE count >= 5 AND cv > 0.5")
def noisy_series(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.noisy(_samples(spark, d)), *_STAT_COLS)


@query(f"""WITH {_SAMPLES}, {_STATS}, w AS (SELECT label, arg_min(category, seq) AS category FROM s WHERE sample IS NOT NULL GROUP BY label)
SELECT st.label, category, count, round(total, 4) AS total, round(mean, 4) AS mean, round(p95, 4) AS p95, round(100 * total / sum(total) OVER (), 4) AS percent FROM st JOIN w ON st.label = w.label""")
def timing_report(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.report(_samples(spark, d)), "total", "mean", "p95", "percent")


_ROLL = "o AS (SELECT label, arg_min(category, seq) AS category, sum(sample) AS total FROM s GROUP BY label), c AS (SELECT category, sum(total) AS total FROM o GROUP BY category)"


@query(f"WITH {_SAMPLES}, {_ROLL} SELECT category, round(total, 4) AS total, round(100 * total / sum(total) OVER (), 4) AS percent FROM c")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.category_rollup(_samples(spark, d)), "total", "percent")


@query(f"WITH {_SAMPLES}, p AS (SELECT label, sum(sample) AS total FROM s GROUP BY label) SELECT label, round(total, 4) AS total, round(100 * total / sum(total) OVER (), 4) AS percent FROM p")
def phase_shares(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.phases(_samples(spark, d)), "total", "percent")


@query(f"""WITH {_SAMPLES}, {_ROLL} SELECT 'phase' AS kind, label AS name, round(total, 4) AS total FROM (SELECT * FROM o ORDER BY total DESC, label DESC LIMIT 1)
UNION ALL SELECT 'category', category, round(total, 4) FROM (SELECT * FROM c ORDER BY total DESC, category DESC LIMIT 1)""")
def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.bottleneck(_samples(spark, d)), "total")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 1, 3, … 15 workers, made of events: their number gives the work, their largest value a serial part."""
    e = _table(spark, d, "events").groupBy((F.col("event_id") % 8 * 2 + 1).cast("int").alias("n_workers")).agg(F.count(F.lit(1)).alias("c"), F.max("value").alias("m"))
    return e.select("n_workers", (20.0 + F.col("c") / F.col("n_workers") + F.col("m") / 64.0).alias("t_total"), (F.col("c") / F.col("n_workers")).alias("t_map"), (F.col("m") / 64.0).alias("t_reduce"))


_RUNS = """ev AS (SELECT CAST(event_id % 8 * 2 + 1 AS INTEGER) AS n_workers, count(*) AS c, max(value) AS m FROM events GROUP BY 1),
r AS (SELECT n_workers, 20::DOUBLE + c::DOUBLE / n_workers + m::DOUBLE / 64 AS t_total, c::DOUBLE / n_workers AS t_map, m::DOUBLE / 64 AS t_reduce FROM ev), sp AS (SELECT *, (SELECT t_total FROM r WHERE n_workers = 1) / t_total AS speedup FROM r)"""


@query(f"WITH {_RUNS} SELECT n_workers, t_total, round(speedup, 6) AS speedup FROM sp")
def speedup(spark: SparkSession, d: str) -> DataFrame:
    return _r(scaling.speedup(_runs(spark, d)).select("n_workers", "t_total", "speedup"), "speedup", digits=6)


@query(f"WITH {_RUNS} SELECT n_workers, round(1 / (0.065::DOUBLE + (1 - 0.065::DOUBLE) / n_workers), 6) AS amdahl FROM sp")
def amdahl_curve(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("n_workers", F.round(amdahl(F.col("n_workers"), 0.065), 6).alias("amdahl"))


@query(f"WITH {_RUNS} SELECT n_workers, CASE WHEN n_workers > 1 THEN round((1 / speedup - 1::DOUBLE / n_workers) / (1 - 1::DOUBLE / n_workers), 6) END AS serial FROM sp")
def karp_flatt_serial(spark: SparkSession, d: str) -> DataFrame:
    return scaling.speedup(_runs(spark, d)).select("n_workers", F.round(karp_flatt(F.col("speedup"), F.col("n_workers")), 6).alias("serial"))


#: The least squared distance over ever finer grids, each around the best of the one before.
_FIT = _RUNS + "".join(
    f", g{k} AS (SELECT f FROM (SELECT f, sum((1 / (f + (1 - f) / n_workers) - speedup) * (1 / (f + (1 - f) / n_workers) - speedup)) AS e FROM sp, (SELECT {at} AS f FROM (SELECT unnest(range(0, 1001)) AS i)) AS grid WHERE f BETWEEN 1e-12 AND 1 GROUP BY f) ORDER BY e, f LIMIT 1)"
    for k, at in ((1, "i / 1000.0::DOUBLE"), (2, "(SELECT f FROM g1) + (i - 500) / 400000.0::DOUBLE"), (3, "(SELECT f FROM g2) + (i - 500) / 160000000.0::DOUBLE"))
)


@query(f"WITH {_FIT} SELECT round(f, 6) AS serial_fraction, round(1 / f, 4) AS max_speedup FROM g3")
def amdahl_fit(spark: SparkSession, d: str) -> DataFrame:
    return scaling.amdahl_fit(_runs(spark, d))


@query(f"WITH {_RUNS} SELECT n_workers, t_total FROM sp ORDER BY t_total, n_workers LIMIT 1")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    return scaling.best_run(_runs(spark, d)).select("n_workers", "t_total")


@query("SELECT event_id, CASE WHEN ns >= 1e9 THEN printf('%.3f s', ns / 1e9) WHEN ns >= 1e6 THEN printf('%.3f ms', ns / 1e6) WHEN ns >= 1e3 THEN printf('%.3f µs', ns / 1e3) ELSE printf('%d ns', ns) END AS took FROM (SELECT event_id, (event_id % 10 + 1) * CAST(power(10, event_id % 10) AS BIGINT) AS ns FROM events)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    ns = (F.col("event_id") % 10 + 1) * F.pow(F.lit(10), F.col("event_id") % 10).cast("long")
    return _table(spark, d, "events").select("event_id", human_duration(ns).alias("took"))


def _loads(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select((F.col("user_id") % 40).alias("u"), "event_id", "value")
    host = e.groupBy("u").agg(F.max_by("value", "event_id").alias("a"), F.max("value").alias("b"), F.min("value").alias("c"))
    up = F.col("u") % 7 != 0
    return host.select(F.concat(F.lit("h"), F.col("u").cast("string")).alias("host"), *[F.when(up, F.col(x)).alias(y) for x, y in (("a", "l1"), ("b", "l5"), ("c", "l15"))])


_LOADS = "ld AS (SELECT 'h' || CAST(u AS VARCHAR) AS host, CASE WHEN u % 7 <> 0 THEN a END AS l1, CASE WHEN u % 7 <> 0 THEN b END AS l5, CASE WHEN u % 7 <> 0 THEN c END AS l15 FROM (SELECT user_id % 40 AS u, arg_max(value, event_id) AS a, max(value) AS b, min(value) AS c FROM events GROUP BY 1))"


@query(f"WITH {_LOADS} SELECT count(*) AS hosts, count(l1) AS reachable, round(avg(l1), 6) AS mean_l1, round(avg(l5), 6) AS mean_l5, round(avg(l15), 6) AS mean_l15 FROM ld")
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(fleet.load_summary(_loads(spark, d)), "mean_l1", "mean_l5", "mean_l15", digits=6)


@query(f"WITH {_LOADS} SELECT host, l1, l5, l15 FROM ld")
def hosts_by_load(spark: SparkSession, d: str) -> DataFrame:
    return fleet.by_host(_loads(spark, d))


@query("""WITH m AS (SELECT (CASE WHEN c_custkey % 3 = 0 THEN 'tp-' ELSE 'xx-' END) || CAST(c_custkey AS VARCHAR) AS name, c_custkey % 5 <> 0 AS alive, c_custkey % 11 AS a, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 7 END AS b, c_nationkey AS c FROM customer)
SELECT name || '.example.org' AS host, CAST(a + coalesce(b, 999) + c AS DOUBLE) AS score FROM m WHERE alive AND starts_with(name, 'tp-') ORDER BY score, host LIMIT 10""")
def host_rank(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    name = F.concat(F.when(k % 3 == 0, "tp-").otherwise("xx-"), text(k))
    m = F.array(name, text(k % 5 != 0), text(k % 11), F.when(k % 13 == 0, "n/a").otherwise(text(k % 7)), text(F.col("c_nationkey")))
    return fleet.least_occupied(_table(spark, d, "customer").select(m.alias("m")), ["tp-"], 10, domain=".example.org")


def _staged(spark: SparkSession, d: str) -> str:
    """A folder of text files, as many as the table has parts or there are cores: the longest doesn't grow with the table."""
    path = shared_dir(spark)
    jobs.spread(_docs(spark, d).select("text")).write.text(path)
    return path


@query(f"WITH {_WC} SELECT key, n FROM wc")
def stream_wordcount(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, of half of the files each."""
    path = _staged(spark, d)
    files = len(spark.read.text(path).inputFiles())
    return stream.count_folder(spark, path, files_per_batch=max(1, -(-files // 2)))


@query(f"WITH {_WC} SELECT key, n FROM wc ORDER BY n DESC, key LIMIT 20")
def stream_topn(spark: SparkSession, d: str) -> DataFrame:
    return jobs.top(stream_wordcount(spark, d), 20)


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents) GROUP BY doc_id")
def tokens_by_split(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return jobs.job("wordcount").keys(docs, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_WC} SELECT key, n FROM wc WHERE length(key) = 12")
def keys_of_wrong_reducer(spark: SparkSession, d: str) -> DataFrame:
    """Read parts whose key's checksum names another reducer: those that were put there, and no others."""
    return _misplaced(spark, d).where(F.col("reducer_id") != reducer("key", REDUCERS)).select("key", "n")
