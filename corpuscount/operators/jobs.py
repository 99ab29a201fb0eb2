"""The counting jobs. A corpus is a DataFrame (split_id, text); every job turns it into rows of (key, n)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscount.functions.tokens import bigrams, tokens
from corpuscount.operators.langdict import language_words
from corpuscount.runtime import parallelism, written


@dataclass(frozen=True)
class JobSpec:
    """A named analysis: ``keys`` turns (…, text) into (…, key), a row for each occurrence.

    keys(corpus, kept): kept are the columns that go along, by which a grouped count is made. pairs: each key is of a token
    and the one before it.
    """

    name: str
    keys: Callable[[DataFrame, list[str]], DataFrame]
    pairs: bool = False


def _wordcount(corpus: DataFrame, kept: list[str]) -> DataFrame:
    return corpus.select(*kept, F.explode(tokens("text")).alias("token")).select(*kept, F.lower("token").alias("key"))


def _wordlen(corpus: DataFrame, kept: list[str]) -> DataFrame:
    return corpus.select(*kept, F.explode(tokens("text")).alias("token")).select(*kept, F.length("token").cast("string").alias("key"))


def _bigram(corpus: DataFrame, kept: list[str]) -> DataFrame:
    return corpus.select(*kept, F.explode(bigrams("text")).alias("key"))


def _lang(corpus: DataFrame, kept: list[str]) -> DataFrame:
    words = _wordcount(corpus, kept)
    return words.join(F.broadcast(language_words(corpus.sparkSession)), words["key"] == F.col("word")).select(*kept, F.col("lang").alias("key"))


JOBS: dict[str, JobSpec] = {}


def register(spec: JobSpec) -> JobSpec:
    """Add a job under its name; a name is given once."""
    if spec.name in JOBS:
        raise ValueError(f"there is a job {spec.name!r} already")
    JOBS[spec.name] = spec
    return spec


for _name, _keys in (("wordcount", _wordcount), ("lang", _lang), ("wordlen", _wordlen), ("bigram", _bigram)):
    register(JobSpec(_name, _keys, _name == "bigram"))


def job(name: str) -> JobSpec:
    if name not in JOBS:
        raise ValueError(f"unknown job {name!r}: one of {', '.join(JOBS)}")
    return JOBS[name]


def corpus_of(df: DataFrame, split_id: str, text: str = "text") -> DataFrame:
    """A table as a corpus."""
    return df.select(F.col(split_id).alias("split_id"), F.col(text).alias("text"))


def spread(corpus: DataFrame) -> DataFrame:
    """The corpus over all cores, where its files have fewer parts than there are cores.

    A large input has more, and is left as it is: no exchange of text. The plan's own estimate of bytes decides; no job is run.
    Rows are dealt out in turn, whatever they hold: by a column of few values (a language, a split) some task would get a share
    of the corpus that more cores don't make smaller.
    """
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * part:
        return corpus
    return corpus.repartition(max(cores, size // (part // 8)))


def count(corpus: DataFrame, name: str, by: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """(…by, key, n) of a job. Counts are summed within tasks before the one exchange.

    dealt: the corpus is made by as many tasks as suits it, and no text is moved.
    """
    by = by or []
    return job(name).keys(corpus if dealt else spread(corpus), by).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))


def count_ranges(ranges: DataFrame, name: str) -> DataFrame:
    """(key, n) of a job over splits of any length, given as rows (prior, text) of parts of them: prior is the token before a row.

    Rows need no order and no exchange: behind the token before it, a row has all pairs that end in it.
    """
    spec = job(name)
    text = F.concat_ws(" ", "prior", "text") if spec.pairs else F.col("text")
    return spec.keys(ranges.select(text.alias("text")), []).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def long_split_bigrams(lines: DataFrame, order: list[str], split: str = "split_id", segment: Column | str | None = None) -> DataFrame:
    """Bigrams (key, n) of splits that are too long for a row: one row for a line, in the order of ``order``.

    segment rises with the order and cuts a split into stretches of bounded length (a file's block, a thousand turns): each is
    ordered by itself, and only its first and last token go on, one row a stretch, to meet those of its neighbours. Without
    one, the first column of several in the order is it. Pairs within a line never leave it.
    """
    seg = segment if segment is not None else order[0] if len(order) > 1 else F.lit(0)
    ends = F.element_at(F.transform(F.array(tokens("text")), lambda t: F.struct(F.get(t, F.lit(0)).alias("a"), F.when(F.size(t) > 0, F.element_at(t, -1)).alias("b"))), 1)
    rows = lines.select(F.col(split).alias("split"), (F.col(seg) if isinstance(seg, str) else seg).alias("seg"), F.struct(*order).alias("at"), ends.alias("ends"))
    within = W.partitionBy("split", "seg").orderBy("at")
    rows = rows.where("ends.a is not null").select("split", "seg", "at", "ends.a", "ends.b").withColumns({"p": F.lag("b").over(within), "next": F.lead("a").over(within)})
    # the first token of a stretch and the last one of the stretch before it that has any
    edge = rows.where("p is null or next is null").groupBy("split", "seg").agg(F.max(F.when(F.col("p").isNull(), F.col("a"))).alias("a"), F.max(F.when(F.col("next").isNull(), F.col("b"))).alias("b"))
    across = edge.withColumn("p", F.lag("b").over(W.partitionBy("split").orderBy("seg")))
    pairs = rows.select("p", "a").unionAll(across.select("p", "a")).where("p is not null")
    keys = pairs.select(F.lower(F.concat_ws(" ", "p", "a")).alias("key"))
    return keys.unionByName(_bigram(lines, [])).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n largest counts, ties by key."""
    return counts.orderBy(F.desc("n"), "key").limit(n)


def ranked(counts: DataFrame) -> DataFrame:
    """(rank, key, n, share): for results of few keys; the whole result is ordered by one task. ranked_all() is for any size."""
    whole = W.partitionBy(F.lit(0))
    return counts.select(F.row_number().over(whole.orderBy(F.desc("n"), "key")).cast("long").alias("rank"), "key", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"))


def ranked_all(counts: DataFrame) -> DataFrame:
    """(rank, key, n, share) of results of any size.

    Keys are dealt out by ranges of (count, key), and numbered within a range as they are written; a range's first rank is the
    number of keys in the ranges before it: one row a range, which is broadcast (there are as many as shuffle partitions).
    """
    parts = parallelism(counts.sparkSession)
    order = [F.desc("n"), F.col("key")]
    # an id is the partition's number and, in the lower 33 bits, the row's place in it
    rows = written(counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "n", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("sum"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("keys").over(before), F.lit(0)).alias("first"), F.sum("sum").over(W.partitionBy(F.lit(0))).alias("total"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return found.select((F.col("first") + place + 1).cast("long").alias("rank"), "key", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def totals(counts: DataFrame) -> DataFrame:
    """(distinct_keys, total)."""
    return counts.agg(F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def conservation(corpus: DataFrame) -> DataFrame:
    """One row: tokens, and the sums of three jobs; words and lengths must equal the tokens, bigrams the tokens after the first of each split."""
    corpus = spread(corpus)
    per = corpus.select(F.transform(F.array(tokens("text")), F.size)[0].cast("long").alias("t"))
    direct = per.agg(F.sum("t").alias("tokens"), F.sum(F.greatest(F.col("t") - 1, F.lit(0))).alias("pairs"))
    out = direct
    for name, col in (("wordcount", "words"), ("wordlen", "lengths"), ("bigram", "bigrams")):
        out = out.join(count(corpus, name).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(col)))  # one row each
    ok: Column = (F.col("words") == F.col("tokens")) & (F.col("lengths") == F.col("tokens")) & (F.col("bigrams") == F.col("pairs"))
    return out.withColumn("conserved", ok)
