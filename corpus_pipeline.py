"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes each one's rows to the shared folder and reads
them again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.llm import jaccard, language, packing, pii, suffixes
from corpuscount.llm.queries import tokenizer_path
from corpuscount.runtime import give_back, written

#: Deviations below the mean of labelled texts of a size from which on a text is unlike them, and such texts at least.
DEVIATIONS, LABELLED = 3, 10
#: No passage of over 50 words is shorter: so many words of a letter, and the blanks between them, are 101 bytes.
REPEATED = 100


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those like no language; of the others ``lang`` becomes the language found.

    The prototypes are learned from the labels of all documents; without any, only documents without a letter go. A text is
    like no language if its letters follow one another as in none of them. The bound for its cosine is one that random letters
    reach, whatever their number, and for short texts less: DEVIATIONS below the mean of all labelled texts of its size
    (distinct trigrams, by powers of 2), or where these are fewer than LABELLED, the bound of the next smaller size. The fewer
    trigrams a text has, the lower its bound: the shortest texts, whose cosines are as widely spread as those of random
    letters, are below none and stay.
    Where a text's cosine is above what random letters reach, lang becomes the language that it is nearest to; elsewhere it stays
    as it was, and a text with letters and without a lang gets the nearest.
    """
    give_back(spark)
    known = language.learn(docs, vectors=language.structures)
    chance = language.chance(known)
    size = F.floor(F.log2("__distinct")).cast("int")
    # judged once: the rows are written, so that sizes are counted over all of them before any is rejected
    judged = written(language.likeness(docs, known).where("__letters"))
    labelled = judged.where(F.col("lang").isNotNull() & (F.col("__distinct") > 0))
    sizes = labelled.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("__like").alias("mean"), F.stddev_pop("__like").alias("spread")).where(F.col("n") >= LABELLED).collect()
    least = {r["size"]: min(chance, r["mean"] - DEVIATIONS * r["spread"]) for r in sizes}
    # a row for each power of 2
    bound = F.greatest(F.lit(-1.0), *[F.when(size >= k, F.lit(x)) for k, x in least.items()]) if least else F.lit(-1.0)
    found = F.when(F.col("__like") >= chance, F.col("__best")).otherwise(F.coalesce("lang", "__best"))
    return judged.where(F.col("__like") >= bound).withColumn("lang", found).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group under links of five-word n-grams and a similarity of 0.8: that with the smallest id.

    A row is known by its id and its text's hash: of those with one id, or none, unlike texts all stay and like ones are a
    group. A row without an id stays only where its group has no other. Documents without words all stay, but of rows alike
    in id and text one.
    """
    give_back(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id"), F.lit(0)), "__h": F.xxhash64(text)}
    keyed = docs.withColumns(key)
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = keyed.where(worded).select(F.struct(*key).alias("__row"), "text")
    stays = jaccard.join_components(rows, id_col="__row", words=5, percent=80).select("component_id.*").distinct()
    kept = keyed.where(worded).join(stays, list(key), "left_semi").dropDuplicates(list(key))
    # without words: linked with nothing
    bare = keyed.where(~worded)
    once = bare.where("not __none").dropDuplicates(list(key))
    return kept.unionByName(once).unionByName(bare.where("__none")).select(docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated byte strings of REPEATED bytes and more; every document stays, with what is left of it."""
    give_back(spark)
    return suffixes.without_repeats(docs, length=REPEATED)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in its place; every document stays."""
    give_back(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences: a row for each piece, with its ids."""
    give_back(spark)
    return packing.harmonic_pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("personal_data", redact),
    ("packing", pack),
]
#: The stages are beyond SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return written(STAGES[-1][1](spark, docs, sf_dir))
