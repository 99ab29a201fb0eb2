"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie with one character in error.

Two words that differ by one edit part at one node of the trie of all words, that of their longest common prefix. At each
node the child with most words is its heavy one; a word runs through at most log2(words) others, its light edges. Only
words on light edges are moved, smaller subtrees into larger ones, with the error made at that node:

- replaced: the light character becomes the heavy one. The moved word falls on the heavy word that differs there alone, and
  light words that differ there alone fall on one another.
- skipped: the light character is left out. The moved word falls on the word without it.
- inserted (the heavy child's words with their character skipped, taken from the smaller side): the heavy character is put
  before the light word, which then falls on the heavy word that has one more.

So each pair is found once: at its one node, from its light side. A terminal is the string from the root, and terminals
coincide where a shuffle brings equal strings together.

The words are dealt in order to blocks of bounded length, each a part of the trie. A subtree within a block is weighed there.
Only nodes on the paths to a block's first and last word can have words elsewhere; their children's sizes are summed over all
blocks, and the heavy ones go back to the blocks that asked.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.exchange import trim
from corpuscount.runtime import SMALL_BATCH, prepare, written

#: Different words that a worker counts before it hands them on.
KEPT_WORDS = 200_000
#: Letters of a block's words, about.
BLOCK_LETTERS = 200_000
#: How a word came to a string: it stands there, one character was skipped, one inserted; else the place of a replaced one.
STANDS, SKIPPED, INSERTED = -3, -1, -2
_RUN = re.compile(r"[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often each word occurs: word, n long. Words are longest stretches of A-Z, a-z and U+00C0 to U+00FF; A-Z is lowered.

    slip: where it divides h, the unsigned crc32 of the UTF-8 of ``<id>:<word>``, the word's code point h % length is left
    out, in all that text (a simulated slip of the pen); None: words are taken as they stand. Texts of null ids have no slips.
    Null and empty texts have no words.
    """
    prepare(docs.sparkSession, SMALL_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        crc32 = zlib.crc32

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return made

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                words = _RUN.findall(text.lower().decode())  # of bytes, only A-Z is lowered
                if slip is None or i is None:
                    counts.update(words)
                    continue
                own, start = Counter(words), crc32(f"{i}:".encode())
                for w in own:
                    h = crc32(w.encode(), start)
                    if not h % slip:
                        at = h % len(w)
                        counts[w[:at] + w[at + 1 :]] += own[w]
                        own[w] = 0
                counts.update(own)
                if len(counts) >= KEPT_WORDS:
                    yield out()
        yield out()
        trim()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "word string, n long")
    return found.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def digest(word: str) -> bytes:
    return blake2b(word.encode(), digest_size=16).digest()


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def border_edges(words: list[str]) -> list[tuple[int, bool, bytes, str, int]]:
    """The edges at nodes that other blocks may share: (depth, on the last word's path, node, character, words below it).

    words are a block's, in order. Nodes are those on the paths to the first and last word; of what both paths share, the first
    word's path speaks. The character of a word that ends at a node is the empty string.
    """
    common = shared(words[0], words[-1])
    out = []
    for late, end in ((False, words[0]), (True, words[-1])):
        if late and len(words) == 1:
            break
        sizes: Counter[tuple[int, str]] = Counter()
        through = Counter()
        for w in words:
            k = shared(w, end)
            through[k] += 1
            if w != end:
                sizes[k, w[k : k + 1]] += 1
        below = 0
        sizes[len(end), ""] += 1
        for k in range(len(end) - 1, -1, -1):
            below += through[k + 1]
            sizes[k, end[k]] = below
        node, path = [], blake2b(digest_size=16)
        for c in (*end, ""):
            node.append(path.digest())
            path.update(c.encode())
        out += [(k, late, node[k], c, n) for (k, c), n in sizes.items() if not late or k > common]
    return out


def moved(words: list[str], heavy: dict[tuple[int, bool], str]) -> Iterator[tuple[int, int, str]]:
    """What words of light edges become: (which word, where and how, the string that it falls on).

    heavy names the heavy character of the nodes on the first and last word's path (depth, last word's path) that have more
    than one child; of other nodes the block's own words tell. Where and how is the depth if the character there was replaced,
    SKIPPED or INSERTED.
    """
    last = len(words)
    forks = sorted({k for k, _ in heavy})

    def light(lo: int, hi: int, d: int, h: str) -> Iterator[tuple[int, int, str]]:
        for j in range(lo, hi):
            head, rest = words[j][:d], words[j][d:]
            yield j, INSERTED, head + h + rest
            if rest:
                yield j, d, head + h + rest[1:]
                if rest[1:2] != rest[0]:  # else leaving out the next one gives the same
                    yield j, SKIPPED, head + rest[1:]

    stack = [(0, last, 0)] if words else []
    while stack:
        lo, hi, d = stack.pop()
        deep = shared(words[lo], words[hi - 1])
        h = None
        if lo == 0 or hi == last:
            # nodes above the block's own fork, whose other children lie in other blocks
            for k in forks[bisect_left(forks, d) : bisect_left(forks, deep)]:
                h = heavy.get((k, lo != 0))
                if h is not None and words[lo][k] != h:
                    yield from light(lo, hi, k, h)
            h = heavy.get((deep, lo != 0))
        if hi - lo == 1 and h is None:
            continue
        children, at = [], lo
        while at < hi:
            c, to = words[at][deep : deep + 1], at + 1
            while to < hi and words[to][deep : deep + 1] == c:
                to += 1
            children.append((c, at, to))
            at = to
        if h is None:
            h = max((c != "", to - at, c) for c, at, to in children)[2]
        for c, at, to in children:
            if c != h:
                yield from light(at, to, deep, h)
            if c:
                stack.append((at, to, deep + 1))


def near_words(words: DataFrame) -> DataFrame:
    """For each word of words (word, n; distinct) that has any word one edit apart: word, n_near long, best struct<neg, word>.

    best is the near word of largest n (neg is -n), of equal ones the smallest in code-point order.
    """
    spark = words.sparkSession
    letters = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    blocks = max(1, math.ceil(letters / BLOCK_LETTERS))
    dealt = written(words.repartitionByRange(blocks, "word").withColumn("block", F.spark_partition_id()))

    def borders(part: pd.DataFrame) -> pd.DataFrame:
        rows = border_edges(sorted(part["word"]))
        return pd.DataFrame(rows, columns=["depth", "late", "node", "c", "n"]).assign(block=part["block"].iloc[0])

    def fallen(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("word", ignore_index=True)
        own = part["word"].tolist()
        rows = list(moved(own, {(k, late): h for k, late, h in zip(asked["depth"], asked["late"], asked["heavy"], strict=True)}))
        # the word itself is where others may fall
        rows += [(j, STANDS, w) for j, w in enumerate(own)]
        which = [r[0] for r in rows]
        out = pd.DataFrame({"key": [digest(r[2]) for r in rows], "how": [r[1] for r in rows], "n": part["n"].to_numpy()[which], "word": [own[j] for j in which]})
        del rows
        trim()
        return out

    prepare(spark, SMALL_BATCH)
    edges = written(dealt.groupBy("block").applyInPandas(borders, "depth int, late boolean, node binary, c string, n long, block int"))
    sizes = edges.groupBy("node", "c").agg(F.sum("n").alias("n"))
    heaviest = F.max(F.struct(F.col("c") != "", "n", "c"))
    heavy = sizes.groupBy("node").agg(heaviest["c"].alias("heavy"), F.count(F.lit(1)).alias("children")).where("children > 1").drop("children")
    asked = edges.select("block", "depth", "late", "node").distinct().join(heavy, "node").drop("node")
    fell = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(fallen, "key binary, how int, n long, word string")
    # on one string fall words one edit apart from it: as many as letters and places allow, whatever the number of words
    met = fell.groupBy("key").agg(F.collect_list(F.struct("how", "n", "word")).alias("all")).where(F.size("all") > 1)
    stands = F.try_element_at(F.filter("all", lambda x: x["how"] == STANDS), F.lit(1))
    met = written(met.select("key", stands.alias("own"), F.explode(F.filter("all", lambda x: x["how"] != STANDS)).alias("x")).select("key", "own", "x.*"))

    def ranked(n: str, word: str) -> Column:
        return F.struct((-F.col(n)).alias("neg"), F.col(word).alias("word"))

    # one skipped or inserted: the word and the one it fell on
    edited = met.where((F.col("how") < 0) & F.col("own").isNotNull())
    pairs = edited.select(F.explode(F.array(F.struct(F.col("word"), ranked("own.n", "own.word").alias("best")), F.struct(F.col("own.word").alias("word"), ranked("n", "word").alias("best")))).alias("p"))
    pairs = pairs.select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best")
    # one replaced: all that agree but for that place, the heavy word among them
    groups = met.where("how >= 0").groupBy("key", "how").agg(F.collect_list(ranked("n", "word")).alias("all"), F.first(F.when(F.col("own").isNotNull(), ranked("own.n", "own.word"))).alias("own"))
    members = F.array_sort(F.when(F.col("own").isNotNull(), F.array_append("all", F.col("own"))).otherwise(F.col("all")))
    groups = groups.select(members.alias("all")).where(F.size("all") > 1).select("all", F.posexplode("all").alias("k", "one"))
    alike = groups.select("one.word", (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("k") == 0, F.element_at("all", 2)).otherwise(F.element_at("all", 1)).alias("best"))
    return pairs.unionByName(alike).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(counts: DataFrame, times: int = 5) -> DataFrame:
    """Groups words with the words that they are misspelled forms of.

    counts has word string and n long, a row for each word. Two words are near if they differ by exactly one inserted,
    deleted or replaced code point. A word's form is its near word of largest n, of equal ones the smallest in code-point
    order, if that n is at least times its own; its root is where forms lead to in the end, itself if it has none.

    Returns word, form, root string, n, n_near (its near words), form_n long; form and form_n are null where there is none.

    Null words and rows without n are left out; a word given twice is an error of the caller (its rows are taken for two
    words). Other columns are left out, whatever their names; an empty table gives none. Strings meet by hashes of 128 bits.
    A worker holds a block of words in order, some BLOCK_LETTERS letters (or the longest word) and what they become; chains
    of forms end after log_times(largest n) steps, and are followed by doubling.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, or forms could lead in circles")
    words = written(counts.select("word", F.col("n").cast("long").alias("n")).where("word is not null and n is not null"))
    near = near_words(words)
    is_form = -F.col("best.neg") >= times * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.neg")).alias("form_n")
        )
    )
    leads = found.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.log(max(most, 1), times) + 1
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        leads = written(leads)
        onward = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        leads = leads.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
