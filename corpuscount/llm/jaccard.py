"""Grouped prefix join of documents by the Jaccard similarity of their word n-grams.

A document's set: its distinct n-grams of words, as hashes. Documents with equal sets are one class. N-grams
are ordered by how many classes of a block's texts have them, rarest first, then by hash. Two sets that are similar
enough share an n-gram within their prefixes, the first n - ceil(t n) + 1 in that order; and one that only
its own set holds can't be shared. So only classes matter whose prefix has an n-gram that occurs elsewhere.

Of these, all with equal prefixes and sizes form a group. Groups that share a prefix n-gram are joined, and
filtered by size, by the n-grams that each shares with anything at all, by where the n-gram stands (two sets of
known sizes must meet within the shorter prefixes that these sizes leave), and by bitmaps: the bits in which the
parities of two sets' hashes differ are no more than the n-grams in which the sets do. Then members are verified by their sets. Components are wanted, not pairs. So in DRAWS rounds each group meets, for each of its n-grams, one group
drawn for that n-gram, and each member its group's first: as many pairs at most as there are entries. At last
only members that are still in different components meet. No link between different texts is missed, and a group of
thousands of copies that link never makes all its pairs.

The counts come from a tree of exchange (see exchange.py): each block of texts sends the sorted list of its hashes,
and gets their counts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.llm import exchange, grams
from corpuscount.llm.components import components
from corpuscount.llm.exchange import Counts, Tree, lean
from corpuscount.llm.grams import U
from corpuscount.llm.skew import joined
from corpuscount.runtime import SMALL_BATCH, prepare, written

#: Bits of an n-gram's hash in the exchange.
BITS = 56
#: Longs of a bitmap, and their columns.
LONGS = 8
MAP = [f"b{k}" for k in range(LONGS)]
#: Rounds of partners drawn by n-gram, before all that are still apart meet.
DRAWS = 2
#: Texts hashed together.
CHARS = 2_000_000


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(the sets' hashes, ascending within each text; where each text's begin, and the length)."""
    w, off = grams.text_words(texts)
    n = len(w)
    h = np.zeros(n, U)
    for k in range(min(words, n)):
        h[: n - k] += grams.mixed(w[k:] ^ U(0x9E37 * (k + 1))) * U(2 * k + 1)
    size = np.diff(off) - 1
    owner = np.repeat(np.arange(len(texts)), size + 1)
    last = np.repeat(off[1:] - 1, size + 1)  # where the text's end stands
    whole = np.arange(n) + words <= last
    for t in np.flatnonzero((size > 0) & (size < words)):  # a short text as one
        at = off[t]
        acc = size[t : t + 1].astype(U)
        for x in range(at, at + size[t]):
            acc = grams.mixed(acc * U(31) + w[x : x + 1])
        h[at], whole[at] = acc[0], True
    h = grams.mixed(h[whole]) >> U(64 - BITS)
    owner = owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def in_chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def sets_of(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    got = [shingles(part, words) for part in in_chunks(texts)]
    if not got:
        return np.zeros(0, U), np.zeros(1, int)
    shift = np.cumsum([0, *[len(h) for h, _ in got]])
    return np.concatenate([h for h, _ in got]), np.concatenate([[0], *[off[1:] + s for (_, off), s in zip(got, shift, strict=False)]])


def set_names(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set's hashes, mixed in two ways: equal for equal sets, whatever their order."""
    out = np.zeros((len(off) - 1, 2), U)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        sums = np.concatenate([[U(0)], np.cumsum(grams.mixed(h ^ U(salt)))])
        out[:, k] = sums[off[1:]] - sums[off[:-1]]
    return out.view(np.int64)


def named_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, f1, f2) for every row: its set's size and name. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = sets_of(b.column(1).to_pylist(), words)
            names = set_names(h, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1])], ["id", "n", "f1", "f2"])

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, n long, f1 long, f2 long")


def blocks_of(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """(block, text): equal texts go to one block, and each task sends a text once, compressed."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("h"), F.length(text_col).alias("n"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in batches:
            keep = []
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key not in sent:
                    sent.add(key)
                    keep.append(k)
            part = b.take(pa.array(keep, pa.int32()))
            block = np.array(part.column(0)).astype(np.int64) % blocks
            yield pa.RecordBatch.from_arrays([pa.array(block), exchange.squeezed(part.column(2))], ["block", "text"])

    return exchange.by_block(rows.mapInArrow(run, "block long, text binary"), blocks)


def _block_sets(texts: pd.Series, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets, offsets, names) of a block's distinct sets, in the order of their names."""
    h, off = sets_of(exchange.plain(texts), words)
    names = set_names(h, off)
    _, first = np.unique(names, axis=0, return_index=True)
    first = first[np.diff(off)[first] > 0]
    if not len(first):
        return np.zeros(0, U), np.zeros(1, int), names[:0]
    return np.concatenate([h[off[k] : off[k + 1]] for k in first]), np.concatenate([[0], np.cumsum(np.diff(off)[first])]), names[first]


def candidates(docs: DataFrame, text_col: str, words: int, percent: int, fan: int = exchange.FAN) -> DataFrame:
    """(f1, f2, n, shared, prefix, bitmap) of the classes whose prefix has an n-gram that another class has too.

    shared: hashes of all its n-grams that others have; prefix: those of its prefix.
    """
    blocks = exchange.blocks_for(docs, text_col)
    tree = Tree(blocks, [Counts(BITS)], fan)

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def work() -> pd.DataFrame:
            u, c = np.unique(_block_sets(pdf["text"], words)[0], return_counts=True)
            return tree.sent([(u, c[None])], int(key[0]))

        return lean(work)

    back = tree.run(blocks_of(docs, text_col, blocks).groupBy("block").applyInPandas(emit, tree.up_schema), lambda own: ([own[0][1]], None))

    def choose(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return lean(_chosen, own, got)

    def _chosen(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        h, off, names = _block_sets(own["text"], words)
        rows = []
        if len(h):
            u, place = np.unique(h, return_inverse=True)
            df = tree.answered(got)[0][0]
            if len(df) != len(u):
                raise ValueError("a block's texts are not those that were counted")
            df = df[place]
            n = np.diff(off)
            alone = np.add.reduceat(df == 1, off[:-1])
            size = n - -(-percent * n // 100) + 1
            for k in np.flatnonzero(alone < size):
                s, d = h[off[k] : off[k + 1]].astype(np.int64), df[off[k] : off[k + 1]]
                order = np.lexsort((s, d))
                bits = np.packbits(np.bincount(s % (64 * LONGS), minlength=64 * LONGS) & 1).view(np.int64)
                rows.append((names[k, 0], names[k, 1], n[k], s[d > 1], s[order[alone[k] : size[k]]], *bits))
        return pd.DataFrame(rows, columns=["f1", "f2", "n", "shared", "prefix", *MAP])

    again = blocks_of(docs, text_col, blocks)
    found = again.groupBy("block").cogroup(back.groupBy("g")).applyInPandas(choose, "f1 long, f2 long, n long, shared array<long>, prefix array<long>, " + ", ".join(f"{c} long" for c in MAP))
    # texts of several blocks may have one set
    return found.groupBy("f1", "f2").agg(F.any_value("n").alias("n"), F.any_value("shared").alias("shared"), F.any_value("prefix").alias("prefix"), *[F.any_value(c).alias(c) for c in MAP])


def linked(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a = cand.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = cand.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _possible(na: str, sa: str, nb: str, sb: str, percent: int) -> Column:
    """Whether sets of these sizes, with so many n-grams that others have, can be similar enough."""
    need = F.ceil(percent * (F.col(na) + F.col(nb)) / F.lit(100.0 + percent) - 1e-9)
    return (F.least(sa, sb) >= need) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _early(na: str, pa: str, nb: str, pb: str, percent: int) -> Column:
    """Whether an n-gram at these places lies in the prefixes in which sets of these sizes must meet."""
    need = F.ceil(percent * (F.col(na) + F.col(nb)) / F.lit(100.0 + percent) - 1e-9)
    return (F.col(pa) <= F.col(na) - need) & (F.col(pb) <= F.col(nb) - need)


def _alike(na: str, nb: str, percent: int) -> Column:
    """Whether the bitmaps (MAP, and MAP with an x) leave sets of these sizes similar enough; null where one is null."""
    need = F.ceil(percent * (F.col(na) + F.col(nb)) / F.lit(100.0 + percent) - 1e-9)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}x"))) for c in MAP[1:]), F.bit_count(F.col(MAP[0]).bitwiseXOR(F.col(f"{MAP[0]}x"))))
    return apart <= F.col(na) + F.col(nb) - 2 * need


def links(cand: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes, enough of them to join all that belong to one component.

    cand: (k, n, shared, prefix, bitmap), k naming the class.
    """
    cand = written(cand)
    exchange.freed(cand.sparkSession)
    groups = cand.groupBy("prefix", "n").agg(F.min("k").alias("g"))
    members = exchange.compact(cand.join(groups, ["prefix", "n"]).select("g", "k", "n", F.size("shared").alias("s"), *MAP, F.when(F.col("g") == F.col("k"), F.col("prefix")).alias("prefix")))
    # places count from 0 and include those that no other set has
    alone = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100.0) - 1e-9) + 1 - F.size("prefix")
    placed = members.where("prefix is not null").select("g", "n", alone.alias("alone"), F.posexplode("prefix").alias("pos", "gram")).withColumn("pos", F.col("pos") + F.col("alone")).drop("alone")
    members = members.drop("prefix").withColumn("root", F.col("k"))

    def reach() -> DataFrame:
        return placed.join(members.groupBy("g").agg(F.max("s").alias("s"), F.min("root").alias("r0"), F.max("root").alias("r1"), *[F.when(F.count(F.lit(1)) == 1, F.min(c)).alias(c) for c in MAP]), "g")

    apart = F.expr("not (r0 = r1 and q0 = q1 and r0 = q0)")
    found = tried = None
    for step in range(DRAWS):  # one partner for each entry: the one with most in common with others, then any
        entries = reach()
        order = F.struct(*[F.col("s")] * (step == 0), F.xxhash64("g", "gram", F.lit(step)))
        drawn = entries.groupBy("gram").agg(F.max_by(F.struct("g", "n", "s", "r0", "r1", *MAP), order).alias("p"), F.count("*").alias("c")).where("c > 1")
        drawn = drawn.select("gram", F.col("p.g").alias("g2"), F.col("p.n").alias("n2"), F.col("p.s").alias("s2"), F.col("p.r0").alias("q0"), F.col("p.r1").alias("q1"), *[F.col(f"p.{c}").alias(f"{c}x") for c in MAP])
        star = entries.join(drawn, "gram").where(F.col("g") != F.col("g2")).where(apart & _possible("n", "s", "n2", "s2", percent) & F.coalesce(_alike("n", "n2", percent), F.lit(True)))
        star = star.select(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b"))
        if step == 0:
            star = star.union(members.where("g <> k").select(F.col("g").alias("a"), F.col("k").alias("b")))
        star = star.distinct()
        star = exchange.compact(star if tried is None else star.join(tried, ["a", "b"], "left_anti"))
        tried = star if tried is None else tried.union(star)
        new = exchange.compact(linked(star, cand, percent))
        found = new if found is None else found.union(new)
        roots = components(found).withColumnRenamed("node", "k").withColumnRenamed("root", "to")
        members = exchange.compact(members.join(roots, "k", "left").select("g", "k", "n", "s", *MAP, F.coalesce("to", "k").alias("root")))
    # what is still apart
    entries = reach()
    mixed = entries.groupBy("gram").agg(F.min("r0").alias("m0"), F.max("r1").alias("m1"), F.count("*").alias("c")).where("c > 1 and m0 <> m1").select("gram")
    left = exchange.compact(entries.join(mixed, "gram"))
    right = left.select("gram", F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("pos").alias("pos2"), F.col("r0").alias("q0"), F.col("r1").alias("q1"), *[F.col(c).alias(f"{c}x") for c in MAP])
    pairs = left.join(right, (left["gram"] == right["gram"]) & (left["g"] < right["g2"]) & apart & _possible("n", "s", "n2", "s2", percent) & _early("n", "pos", "n2", "pos2", percent) & F.coalesce(_alike("n", "n2", percent), F.lit(True)))
    pairs = pairs.select("g", "g2").distinct()
    one = members.select(F.col("g"), F.col("k").alias("a"), F.col("n").alias("na"), F.col("s").alias("xa"), F.col("root").alias("ra"), *MAP)
    two = members.select(F.col("g").alias("g2"), F.col("k").alias("b"), F.col("n").alias("nb"), F.col("s").alias("xb"), F.col("root").alias("rb"), *[F.col(c).alias(f"{c}x") for c in MAP])
    fit = _possible("na", "xa", "nb", "xb", percent) & _alike("na", "nb", percent)
    wide = pairs.join(one, "g").join(two, "g2").where("ra <> rb").where(fit).select("a", "b")
    inner = one.join(two, (one["g"] == two["g2"]) & (one["a"] < two["b"]) & (one["ra"] != two["rb"]) & fit).select("a", "b")
    rest = wide.union(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return found.union(linked(exchange.compact(rest), cand, percent))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """The component of every document under links of a Jaccard similarity of ``percent`` per cent or more.

    Returns id, n_shingles, component_id: the smallest id that links lead to, itself included. A text with fewer
    than ``words`` words is one n-gram as a whole; without words, or null, it is empty and linked with nothing, and so
    its own component. Rows with equal texts are one component; each row stays. Rows that share an id aren't linked by it.
    A null id is never the smallest, but links run through its row as through others; other columns are left out; an empty table gives none.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    rows = written(named_sets(docs, id_col, text_col, words))
    # a class has a key of its own: ids may be null, or shared by unlike texts
    classes = exchange.compact(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id")).withColumn("k", F.monotonically_increasing_id()))
    cand = candidates(docs, text_col, words, percent).join(classes, ["f1", "f2"]).select("k", "n", "shared", "prefix", *MAP)
    roots = components(links(cand, percent))
    of_class = exchange.compact(classes.join(roots.withColumnRenamed("node", "k"), "k", "left").select("f1", "f2", "id", F.coalesce("root", "k").alias("root")))
    # a component of many classes, then a class of many rows
    named = joined(of_class, of_class.groupBy("root").agg(F.min("id").alias("component")), ["root"]).select("f1", "f2", "component")
    full = joined(rows.where("n > 0"), named, ["f1", "f2"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
