"""Totals of sorted hash lists over all blocks of a corpus, by a tree of merges.

A block sends its list, cut into WIDTH ranges of hashes, to nodes that each merge one range of WIDTH blocks; these
cut and send on what they merged, until a node holds its range of all blocks. Answers go back the same way.
With FAN as the most for WIDTH there are log(blocks) levels, a block has FAN rows at most on each, and what a node
merges is about as long as one block's own list, whatever the number of blocks: hashes fall evenly into ranges, and
a hash that all blocks have is one entry. So rows a GB and the memory of a task don't grow with the corpus.

Up to FAN blocks there is one level: an exchange of rows (block, range), there and back.
"""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscount.llm import grams
from corpuscount.llm.grams import U
from corpuscount.runtime import parallelism, setting, shared_dir, written

#: Most blocks that a node merges; bytes of text in a block (more only where one text has more); most shuffle partitions asked for.
FAN, BLOCK_BYTES, MOST_PARTS = 256, 8 << 20, 32_768
#: What a list's entries carry: (keys in ascending order, a row of counts for each array).
Entries = tuple[np.ndarray, np.ndarray]


def trim() -> None:
    """Give memory that is free back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable, *args: object) -> object:
    out = f(*args)
    trim()
    return out


def squeezed(texts: pa.Array) -> pa.Array:
    """Texts as compressed bytes, for an exchange."""
    to = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else to.compress(x) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def plain(raw: Iterable[bytes | None]) -> list[bytes | None]:
    """The UTF-8 of texts that were squeezed()."""
    back = zstandard.ZstdDecompressor()
    return [None if x is None else back.decompress(x) for x in raw]


def freed(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables of the shared folder that nothing reads any more, and have Spark drop the shuffles that were cut off.

    Spark drops a shuffle's files once the driver collects its last reference; a small heap may not do so for long.
    """
    for path in paths or ():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def compact(df: DataFrame) -> DataFrame:
    """written() for tables of narrow rows: as many files as Spark's advised size asks for, not one for each core.

    On file systems without Hadoop's native library each new file costs its writer several processes, and each task its share
    of the driver's time; tables of links are many, and mostly small. Large ones have the same parts as with written().
    """
    with setting(df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        return written(df)


def blocks_for(docs: DataFrame, text_col: str) -> int:
    """How many blocks the texts need: one for each BLOCK_BYTES, and one for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(parallelism(docs.sparkSession), -(-total // BLOCK_BYTES))


def by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (block, …) over enough shuffle partitions, where the session's number is too small for so many blocks."""
    return rows.repartition(min(blocks, MOST_PARTS), "block") if blocks > parallelism(rows.sparkSession) else rows


def shape(blocks: int, fan: int = FAN) -> tuple[int, int]:
    """(levels, width): the least levels, then the least width, of a tree over so many blocks."""
    levels = 1
    while fan**levels < blocks:
        levels += 1
    width = max(1, math.floor(blocks ** (1 / levels)))
    while width**levels < blocks:
        width += 1
    return levels, width


def _joined(parts: list[bytes]) -> bytes:
    return b"".join([len(p).to_bytes(4, "little") + p for p in parts])


def _parted(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class Counts:
    """Entries of hashes with counts that add up (to ``most`` at most). Answers: rows of counts."""

    def __init__(self, bits: int, arrays: int = 1, most: int | None = None):
        self.bits, self.arrays, self.most = bits, arrays, most

    def none(self) -> Entries:
        return np.zeros(0, U), np.zeros((self.arrays, 0), np.int64)

    def pack(self, own: Entries, i: int, j: int, low: int) -> bytes:
        return _joined([grams.packed(own[0][i:j], low), *[grams.packed_counts(c[i:j]) for c in own[1]]])

    def unpack(self, raw: bytes, low: int) -> Entries:
        keys, *counts = _parted(raw)
        return grams.unpacked(keys, low), np.stack([grams.unpacked_counts(c) for c in counts])

    def merge(self, lists: list[Entries]) -> tuple[Entries, list[np.ndarray]]:
        """What all lists hold, and for each list where its entries are in it."""
        keys, place = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
        counts = np.concatenate([c for _, c in lists], axis=1)
        sums = np.stack([np.bincount(place, weights=c, minlength=len(keys)) for c in counts]).astype(np.int64)
        return (keys, sums if self.most is None else np.minimum(sums, self.most)), np.split(place, np.cumsum([len(k) for k, _ in lists])[:-1])

    def pack_answer(self, answer: np.ndarray) -> bytes:
        return _joined([grams.packed_counts(a) for a in answer])

    def unpack_answer(self, raw: bytes) -> np.ndarray:
        return np.stack([grams.unpacked_counts(x) for x in _parted(raw)])


class Tree:
    """The exchange of lists of one or several kinds (codecs) among so many blocks."""

    def __init__(self, blocks: int, codecs: list, fan: int = FAN):
        self.codecs = codecs
        self.levels, self.width = shape(blocks, fan)
        k = range(len(codecs))
        self.up_schema = "g long, r long, child long, " + ", ".join(f"d{x} binary" for x in k)
        self.down_schema = "g long, r long, s long, " + ", ".join(f"a{x} binary" for x in k)
        self.up_names, self.down_names = ([x.split()[0] for x in s.split(", ")] for s in (self.up_schema, self.down_schema))

    def _low(self, bits: int, level: int, r: int) -> int:
        return (r << bits) // self.width**level

    def sent(self, lists: list[Entries], g: int, r: int = 0, level: int = 0) -> pd.DataFrame:
        """What node (g, r) of a level, or block g, sends to the nodes above: a row for each range of its own."""
        rows: dict[int, list] = {}
        for k, (codec, own) in enumerate(zip(self.codecs, lists, strict=True)):
            edges = [self._low(codec.bits, level + 1, r * self.width + s) for s in range(self.width)]
            at = [0, *np.searchsorted(own[0], np.array(edges[1:], U)).tolist(), len(own[0])]
            for s in range(self.width):
                if at[s] < at[s + 1]:
                    row = rows.setdefault(s, [g // self.width, r * self.width + s, g, *[None] * len(self.codecs)])
                    row[3 + k] = codec.pack(own, at[s], at[s + 1], edges[s])
        return pd.DataFrame(list(rows.values()), columns=self.up_names)

    def _merged(self, pdf: pd.DataFrame, r: int, level: int) -> list[tuple[Entries, dict[int, np.ndarray]]]:
        out = []
        for k, codec in enumerate(self.codecs):
            own = pdf[pdf[f"d{k}"].notna()]
            if not len(own):
                out.append((codec.none(), {}))
                continue
            low = self._low(codec.bits, level, r)
            whole, places = codec.merge([codec.unpack(x, low) for x in own[f"d{k}"]])
            out.append((whole, dict(zip(own["child"].tolist(), places, strict=True))))
        return out

    def _returned(self, merged: list, answers: list[np.ndarray], r: int) -> pd.DataFrame:
        children = sorted({c for _, places in merged for c in places})
        rows = []
        for c in children:
            packed = [codec.pack_answer(a[:, places[c]]) if c in places else None for codec, (_, places), a in zip(self.codecs, merged, answers, strict=True)]
            rows.append([c, r // self.width, r % self.width, *packed])
        return pd.DataFrame(rows, columns=self.down_names)

    def answered(self, pdf: pd.DataFrame) -> list[np.ndarray]:
        """A block's answers in the order of its lists, from its rows (s, a0, …); a list without entries has none."""
        out = []
        for k, codec in enumerate(self.codecs):
            own = pdf[pdf[f"a{k}"].notna()].sort_values("s")[f"a{k}"]
            out.append(np.concatenate([codec.unpack_answer(x) for x in own], axis=1) if len(own) else np.zeros((getattr(codec, "arrays", 1), 0), np.int64))
        return out

    def run(self, rows: DataFrame, top: Callable[[list[Entries]], tuple[list[np.ndarray], np.ndarray | None]]) -> DataFrame:
        """(g, r, s, a0, …): the answers to block g; rows of g = -1 hold, in a0, the sums that top gives beside them.

        rows: what all blocks sent(). top: the answers to the entries of a range of all blocks, and counts to be summed.
        """

        def climb(level: int) -> Callable:
            def at_node(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                return lean(lambda: self.sent([own for own, _ in self._merged(pdf, int(key[1]), level)], int(key[0]), int(key[1]), level))

            return at_node

        def at_top(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            def node() -> pd.DataFrame:
                r = int(key[1])
                merged = self._merged(pdf, r, self.levels)
                answers, sums = top([own for own, _ in merged])
                out = self._returned(merged, answers, r)
                if sums is not None:
                    out.loc[len(out)] = [-1, r, 0, grams.packed_counts(sums), *[None] * (len(self.codecs) - 1)]
                return out

            return lean(node)

        def descend(level: int) -> Callable:
            def at_node(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
                return lean(lambda: self._returned(self._merged(pdf, int(key[1]), level), self.answered(got), int(key[1])))

            return at_node

        spark, ups, paths = rows.sparkSession, [rows], []
        for level in range(1, self.levels):
            paths.append(shared_dir(spark))
            ups[-1] = written(ups[-1], paths[-1])
            freed(spark)
            ups.append(ups[-1].groupBy("g", "r").applyInPandas(climb(level), self.up_schema))
        down = written(ups[-1].groupBy("g", "r").applyInPandas(at_top, self.down_schema))
        sums = down.where("g < 0")
        for level in range(self.levels - 1, 0, -1):
            down = ups[level - 1].groupBy("g", "r").cogroup(down.where("g >= 0").groupBy("g", "r")).applyInPandas(descend(level), self.down_schema)
        if self.levels > 1:
            down = written(down.unionByName(sums))
        freed(spark, paths)
        return down
