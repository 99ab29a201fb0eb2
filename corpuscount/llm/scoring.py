"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after the two before it (trigrams), after the one before it
(bigrams), of the word alone, and a smoothed unigram that knows unseen words too. The weights depend on how often the
context was seen: contexts are bucketed by the binary logarithm of the count of both words before, or where
these never met, of the last of them. Expectation-maximisation learns each bucket's weights on held-out counts: a
tenth of the training texts is scored by the counts of the others, its own deleted from them.

Counts are of all training texts and grow with them, so no task ever holds them all. Texts are dealt into blocks of
some megabytes. A block sends the distinct hashes of its n-grams with its own counts through the tree of exchange, and
gets the totals back in the same order: that is its own dictionary, by which it scores its texts. The texts for
the weights have blocks of their own, so learning reads only those again.

Hashes have 56 bits for words: at 10**7 words any two share one with probability 10**-3. Those of longer n-grams have 40
and more, as the corpus grows: one n-gram in a thousand at most shares its hash with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.llm import exchange, grams
from corpuscount.llm.exchange import Counts, Tree, lean
from corpuscount.llm.grams import U
from corpuscount.runtime import parallelism, prepare

#: Bits of the hashes of words; least and most bits of those of longer n-grams.
WORD_BITS, GRAM_BITS = 56, (40, 60)
ORDERS = 3
#: Held-out texts for the weights: one in so many training texts.
DELETED = 9
ROUNDS = 60
#: Estimates are told apart, for the weights only, to a half of a binary logarithm.
GRID = 2
NONE = -(1 << 20)
#: Buckets of contexts: none known; the last word's count by powers of 2; that of the last two words.
LOGS = 64
NAMES = ["q3", "q2", "q1", "q0"]


@dataclass(frozen=True)
class Weights:
    """A row for each bucket: weights of (trigram, bigram, unigram, smoothed unigram)."""

    table: np.ndarray

    def of(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.table[bucket_of(two, one)]


def bucket_of(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bucket of contexts: the last two words were seen ``two`` times, the last ``one`` times."""
    log = lambda n: np.log2(np.maximum(n, 1)).astype(np.int64)
    return np.where(two > 0, 1 + LOGS + log(two), np.where(one > 0, 1 + log(one), 0))


def gram_bits(total: int) -> int:
    """Bits of the hashes of bigrams and trigrams of so many bytes of text."""
    return min(GRAM_BITS[1], max(GRAM_BITS[0], total.bit_length() + 8))


class Block:
    """The words, bigrams and trigrams of some texts, and their distinct hashes."""

    def __init__(self, texts: list[str | None], bits: int):
        words, self.off = grams.text_words(texts)
        first = self.off[:-1]  # a text begins after ends
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[first] = grams.END_HASH
        pair = grams.mixed(words * U(3) + grams.mixed(before))
        second = np.empty_like(words)
        second[1:] = before[:-1]
        second[first] = grams.END_HASH
        triple = grams.mixed(pair * U(5) + grams.mixed(second ^ U(grams.MIX[0])))
        del before, second
        hashes = [words >> U(64 - WORD_BITS), pair >> U(64 - bits), triple >> U(64 - bits)]
        del words, pair, triple
        self.distinct, self.place = [], []
        for k in range(ORDERS):
            u, p = np.unique(hashes[k], return_inverse=True)
            hashes[k] = None
            self.distinct.append(u)
            self.place.append(p.astype(np.int32))
        begin = np.searchsorted(self.distinct[0], grams.END_HASH >> U(64 - WORD_BITS))
        self.context = self._shifted(self.place[0], begin)  # places of the word before
        self.first = first

    def _shifted(self, place: np.ndarray, start: int) -> np.ndarray:
        out = np.empty_like(place)
        out[1:] = place[:-1]
        out[self.off[:-1]] = start
        return out

    def entries(self, counted: np.ndarray, deleted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the distinct hashes, how often each occurs in the texts that are counted, and in deleted ones."""
        weights = np.repeat(counted, np.diff(self.off))
        own = [np.bincount(p, weights=weights, minlength=len(u)).astype(np.int64) for u, p in zip(self.distinct, self.place, strict=True)]
        return [(u, np.stack([c, c if deleted else np.zeros_like(c)])) for u, c in zip(self.distinct, own, strict=True)]

    def estimates(self, counts: list[np.ndarray], tokens: int, distinct: int) -> tuple[np.ndarray, ...]:
        """For each token: its count, the counts of its contexts of two words and of one, and the four estimates.

        counts: for each order those of the distinct hashes.
        """
        if any(len(c) != len(u) for c, u in zip(counts, self.distinct, strict=True)):
            raise ValueError("a block's texts are not those that were counted")
        c, one, both, all_ = counts[0][self.place[0]], counts[0][self.context], counts[1][self.place[1]], counts[2][self.place[2]]
        two = counts[1][self._shifted(self.place[1], 0)]
        two[self.first] = one[self.first]  # both words before a text are ends
        part = lambda a, b: np.minimum(np.divide(a, b, out=np.zeros(len(c)), where=b > 0), 1)
        return c, two, one, np.stack([part(all_, two), part(both, one), c / max(tokens, 1), (c + 0.1) / (tokens + 0.1 * (distinct + 1))], axis=1)


def _totals(own: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Answers of a range: the counts themselves; sums: tokens and distinct words, of all training texts and without the deleted."""
    n, deleted = own[0][1]
    return [c for _, c in own], np.array([n.sum(), (n > 0).sum(), (n - deleted).sum(), (n > deleted).sum()])


def _sizes(back: DataFrame) -> np.ndarray:
    """Tokens and distinct words of all training texts, and without the deleted ones: a row for each range, FAN at most a level."""
    rows = [grams.unpacked_counts(r[0]) for r in back.where("g < 0").select("a0").toLocalIterator()]
    return np.sum(rows, axis=0) if rows else np.zeros(4, np.int64)


def bucket_weights(own: pd.DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of one bucket from its cells (q3, q2, q1, q0, n), by expectation-maximisation."""
    p = np.stack([np.where(own[q] == NONE, 0.0, np.exp2(own[q].to_numpy() / GRID)) for q in NAMES], axis=1)
    n = own["n"].to_numpy(np.float64)
    w = np.full(len(NAMES), 1 / len(NAMES))
    for _ in range(rounds):
        part = p * w
        part /= part.sum(axis=1, keepdims=True)
        w = (part * n[:, None]).sum(axis=0) / n.sum()
    w = np.maximum(w, 1e-4 * np.array([p[:, 0].any(), p[:, 1].any(), 1, 1]))  # an unseen word is never impossible
    return w / w.sum()


def weights_of(found: dict[int, np.ndarray]) -> Weights:
    """The weights of all buckets from those of the buckets that have held-out tokens; others do as the one below."""
    table = np.tile([0.0, 0.0, 0.0, 1.0], (1 + 2 * LOGS, 1))
    for k in range(len(table)):
        if k in found:
            table[k] = found[k]
        elif k:
            table[k] = table[k - 1]
    return Weights(table)


def expectation_maximisation(cells: pd.DataFrame, rounds: int = ROUNDS) -> Weights:
    """learned_weights() of cells in memory."""
    return weights_of({int(k): bucket_weights(own, rounds) for k, own in cells.groupby("bucket")})


def learned_weights(cells: DataFrame) -> Weights:
    """Weights by bucket from cells (bucket, q3, q2, q1, q0: estimates in grid steps of their binary logarithm, NONE for 0; n).

    Each bucket is learned by a task, from its cells of the grid; only one row for each bucket comes to the driver.
    """

    def learned(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        w = bucket_weights(own.sort_values(list(NAMES), ignore_index=True))
        return pd.DataFrame({"bucket": [key[0]], "w": [w.tolist()]})

    cells = cells.groupBy("bucket", *NAMES).agg(F.sum("n").alias("n"))
    rows = cells.groupBy("bucket").applyInPandas(learned, "bucket long, w array<double>").collect()
    return weights_of({int(r["bucket"]): np.array(r["w"]) for r in rows})


def _learn(texts: DataFrame, back: DataFrame, bits: int, tree: Tree, tokens: int, distinct: int) -> Weights:
    def cells(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *NAMES]
        if not len(own):
            return pd.DataFrame({x: pd.Series(dtype="int64") for x in [*names, "n"]})

        def work() -> pd.DataFrame:
            b = Block(exchange.plain(own["text"]), bits)
            _, two, one, p = b.estimates([a[0] - a[1] for a in tree.answered(got)], tokens, distinct)
            with np.errstate(divide="ignore"):
                q = np.where(p > 0, np.rint(GRID * np.log2(p)), NONE).astype(np.int64)
            out, n = np.unique(np.concatenate([bucket_of(two, one)[:, None], q], axis=1), axis=0, return_counts=True)
            return pd.DataFrame(out, columns=names).assign(n=n)

        return lean(work)

    got = texts.groupBy("block").cogroup(back.groupBy("g")).applyInPandas(cells, "bucket long, " + ", ".join(f"{q} long" for q in NAMES) + ", n long")
    return learned_weights(got)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", fan: int = exchange.FAN) -> DataFrame:
    """Score every whole text by a model of the texts for which ``train`` is true.

    Tokens are the words of a text (A-Z in lower case) and one end. Returns id, held_out (not train), n_tokens,
    n_known (tokens that training has), train_tokens, base_score (the add-0.1 unigram's log10 probability of the text),
    score (the model's). Null text counts as empty: its end alone. Equal rows each give their row and count each
    time. Without any training text, every word has the same probability. Other columns are left out; an empty
    table gives none.
    """
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    bits, blocks = gram_bits(total), max(parallelism(spark), -(-total // exchange.BLOCK_BYTES))
    fold_blocks = max(1, blocks // (DELETED + 1))
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), h.alias("h"))
    deleted = F.col("train") & (F.pmod(F.xxhash64("h"), F.lit(DELETED)) == 0)
    block = F.when(deleted, F.pmod("h", F.lit(fold_blocks))).otherwise(fold_blocks + F.pmod("h", F.lit(blocks)))
    texts = rows.select("id", "train", block.cast("long").alias("block"), "text")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], exchange.squeezed(b.column(3))], ["id", "train", "block", "text"])

    texts = texts.mapInArrow(squeeze, f"id {rows.schema[0].dataType.simpleString()}, train boolean, block long, text binary")
    tree = Tree(blocks + fold_blocks, [Counts(WORD_BITS, 2), Counts(bits, 2), Counts(bits, 2)], fan)

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        return lean(lambda: tree.sent(Block(exchange.plain(pdf["text"]), bits).entries(pdf["train"].to_numpy(bool), g < fold_blocks), g))

    dealt = exchange.by_block(texts, blocks)
    back = tree.run(dealt.select("block", "train", "text").groupBy("block").applyInPandas(emit, tree.up_schema), _totals)
    tokens, distinct, rest, rest_distinct = (int(x) for x in _sizes(back))
    weights = _learn(texts.where(F.col("block") < fold_blocks).select("block", "text"), back.where((F.col("g") >= 0) & (F.col("g") < fold_blocks)), bits, tree, rest, rest_distinct)
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({id_col: own["id"], "held_out": own["train"], **{x: pd.Series(dtype="int64") for x in ("n_tokens", "n_known", "train_tokens")}, "base_score": pd.Series(dtype="float64"), "score": pd.Series(dtype="float64")})

        def work() -> pd.DataFrame:
            b = Block(exchange.plain(own["text"]), bits)
            c, two, one, p = b.estimates([a[0] for a in tree.answered(got)], tokens, distinct)
            at = b.off[:-1]
            if tokens:
                mix = np.log10((p * weights.of(two, one)).sum(axis=1))
                base = np.log10(p[:, -1])
            else:
                mix = base = np.zeros(len(c))
            return pd.DataFrame({
                id_col: own["id"], "held_out": ~own["train"].to_numpy(bool), "n_tokens": np.diff(b.off), "n_known": np.add.reduceat((c > 0).astype(np.int64), at),
                "train_tokens": tokens, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(mix, at),
            })

        return lean(work)

    return dealt.select("block", "id", "train", "text").groupBy("block").cogroup(back.where("g >= 0").groupBy("g")).applyInPandas(scored, schema)
