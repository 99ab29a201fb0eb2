"""The queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.language import fold
    from corpuscount.llm.scoring import score

    return score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.jaccard import join_components

    return join_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.fingerprint import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch date of their own: page_id stands in for it, a day of 2024 each. The lists are made of pages too."""
    from corpuscount.llm.urls import example_lists, judge, lists_of

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched"))
    entries = example_lists(spark).unionByName(lists_of(pages))
    return judge(pages, entries).drop("url").withColumn("fetched", F.col("fetched").cast("string"))


def _op7_sql() -> str:
    from corpuscount.llm.urls import EXAMPLE_LISTS

    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in EXAMPLE_LISTS)
    return f"""
    WITH p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host FROM pages),
    e AS (SELECT list, host, CAST(dated AS DATE) AS dated, action FROM (VALUES {rows}) AS v(list, host, dated, action)
          UNION ALL SELECT 'list' || CAST(page_id % 4 AS VARCHAR), CASE WHEN page_id % 5 = 0 THEN 'm.' || host WHEN page_id % 7 = 0 AND length(host) - length(replace(host, '.', '')) >= 2 THEN substr(host, instr(host, '.') + 1) ELSE host END,
          CAST(DATE '2023-06-01' + CAST(page_id * 37 % 500 AS INTEGER) AS DATE), CASE WHEN page_id % 3 = 0 THEN 'allow' WHEN page_id % 11 = 0 THEN 'clear' ELSE 'block' END FROM p WHERE host <> ''),
    one AS (SELECT list, host, dated, max(action) AS action FROM e GROUP BY ALL),
    iv AS (SELECT *, lead(dated) OVER (PARTITION BY list, host ORDER BY dated) AS until FROM one),
    s AS (SELECT page_id, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[-k:], '.'))) AS suffix FROM p),
    a AS (SELECT s.page_id, length(iv.host) AS n, iv.host AS matched, min(iv.action) AS verdict, string_agg(DISTINCT iv.list, ',' ORDER BY iv.list) AS lists
          FROM s JOIN iv ON s.suffix = iv.host AND s.fetched >= iv.dated AND (iv.until IS NULL OR s.fetched < iv.until)
          WHERE iv.action IN ('allow', 'block') GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS k FROM a)
    SELECT p.page_id, CAST(p.fetched AS VARCHAR) AS fetched, p.host, coalesce(b.verdict, 'none') AS verdict, b.matched, b.lists
    FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.k = 1"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.packing import harmonic_pack

    return harmonic_pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2, keep_ids=False)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.periods import longest_run, periodic_runs, with_repeated_tails

    found = periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")), least=24, ratio=3)
    best = longest_run("runs")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.counts import prefix_counts

    counted = prefix_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096, keep_counts=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscount.llm.variants import spelling_variants, word_counts

    counts = word_counts(table(spark, sf_dir, "documents"), slip=199)
    return spelling_variants(counts.where((F.char_length("word") >= 6) & (F.col("n") >= 5)), times=5)


def _op13_sql() -> str:
    """Words one edit apart share the word itself or a string with one character left out: those strings are compared."""
    crc = """list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(t))), lambda i: CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c // 256))"""
    return f"""
    WITH RECURSIVE ct AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
    r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY 1, 2),
    h AS (SELECT run, k, xor(4294967295, {crc}) AS h FROM (SELECT run, k, doc_id || ':' || run AS t FROM r), ct),
    w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n
          FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
          WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
    d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    p AS (SELECT a.word AS a, b.word AS b FROM d AS a JOIN w AS b ON a.short = b.word
          UNION SELECT b.word, a.word FROM d AS a JOIN w AS b ON a.short = b.word
          UNION SELECT a.word, b.word FROM d AS a JOIN d AS b ON a.short = b.short AND a.i = b.i AND a.word <> b.word),
    f AS MATERIALIZED (SELECT w.word, w.n, count(b.word) AS n_near, first(b.word ORDER BY b.n DESC, b.word) AS best, max(b.n) AS best_n
          FROM w LEFT JOIN p ON p.a = w.word LEFT JOIN w AS b ON b.word = p.b GROUP BY 1, 2),
    g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
    walk AS (SELECT word, word AS at FROM g UNION ALL SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.at WHERE g.form IS NOT NULL)
    SELECT g.word, g.form, walk.at AS root, g.n, g.n_near, g.form_n FROM g JOIN walk ON walk.word = g.word JOIN g AS top ON top.word = walk.at AND top.form IS NULL"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_scoring": op2_scoring,
    "op3_neighbours": op3_neighbours,
    "op4_jaccard": op4_jaccard,
    "op5_suffixes": op5_suffixes,
    "op6_fingerprint": op6_fingerprint,
    "op7_urls": op7_urls,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_bpe": op10_bpe,
    "op11_periods": op11_periods,
    "op12_counts": op12_counts,
    "op13_variants": op13_variants,
}
ORACLES: dict[str, str] = {"op7_urls": _op7_sql(), "op13_variants": _op13_sql()}
