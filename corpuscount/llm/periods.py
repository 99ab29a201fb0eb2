"""Periodic runs of words: stretches in which words a fixed lag apart are identical.

How often words q apart are identical is counted for every lag q at once. A frequent word's share of the counts is the
autocorrelation of its places, by a fast Fourier transform; a rare word's share comes from the differences of its places.
A word is frequent where its pairs would cost more than a transform. A run of lag q holds a known number of such matches in
a row, so only lags with as many matches, apart from those that runs of a divisor of q explain, are scanned for islands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.exchange import trim
from corpuscount.runtime import SMALL_BATCH, prepare

#: Cost of a pair of places against that of a step of a transform (n log2 n of them), as measured.
PAIR_COST, STEP_COST = 12.0, 3.0
#: Differences of places are summed up once there are so many.
PENDING = 1 << 20
#: Numbers that a block of transforms holds.
TRANSFORMED = 1 << 21
#: Words of an island that are compared before it is followed to its ends.
PROBE = 64


def lag_counts(ids: np.ndarray, starts: np.ndarray, ratio: int) -> np.ndarray:
    """At starts[d] + q: in how many places of text d the words q apart are identical, for all lags q of at most n // ratio.

    ids are the texts' words one after the other, as numbers; text d is ids[starts[d] : starts[d + 1]].
    """
    total = len(ids)
    sizes = np.diff(starts)
    most = sizes // ratio
    counts = np.zeros(total + 1, np.int64)
    if not most.any():
        return counts
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # by word, then by place: places are in the order of texts
    if int(ids.max()) < (1 << 62) // total:
        order = np.sort(ids * total + np.arange(total))
        word, place = np.divmod(order, total)
    else:
        place = np.argsort(ids, kind="stable")
        word = ids[place]
    doc = doc[place]
    new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))))
    length = np.diff(np.append(new, total))
    padded = 2.0 ** np.ceil(np.log2(np.maximum(2, sizes + most)))
    # pairs beyond the largest lag aren't looked at: at most a share of 2 / ratio of them is
    frequent = (length.astype(float) ** 2 / 2 * min(1.0, 2 / ratio) * PAIR_COST > STEP_COST * (padded * np.log2(padded))[doc[new]]) & (most[doc[new]] > 0)
    stop = np.repeat(np.where(frequent, 0, new + length), length)
    left = np.flatnonzero((stop > np.arange(total) + 1) & (most[doc] > 0))
    pending, n = [], 0
    for s in count(1):
        left = left[left + s < stop[left]]
        if not len(left):
            break
        apart = place[left + s] - place[left]
        near = apart <= most[doc[left]]
        left = left[near]  # a word's later places are further away still
        pending.append(starts[doc[left]] + apart[near])
        n += len(left)
        if n >= PENDING:
            counts += np.bincount(np.concatenate(pending), minlength=total + 1)
            pending, n = [], 0
    if n:
        counts += np.bincount(np.concatenate(pending), minlength=total + 1)
    by_doc = defaultdict(list)
    for k in np.flatnonzero(frequent):
        by_doc[int(doc[new[k]])].append(place[new[k] : new[k] + length[k]])
    for d, places in by_doc.items():
        size, first = int(padded[d]), int(starts[d])
        power = np.zeros(size // 2 + 1)
        block = max(1, TRANSFORMED // size)
        for k in range(0, len(places), block):
            marks = np.zeros((len(places[k : k + block]), size))
            for row, p in zip(marks, places[k : k + block], strict=True):
                row[p - first] = 1
            found = np.fft.rfft(marks, axis=1)
            power += (found.real**2 + found.imag**2).sum(0)
        lags = np.arange(1, int(most[d]) + 1)
        counts[first + lags] += np.rint(np.fft.irfft(power, size)[lags]).astype(np.int64)
    return counts


def islands(x: np.ndarray, q: int, need: int) -> Iterator[tuple[int, int]]:
    """The stretches [s, e) of at least need places i with x[i] == x[i + q], none of which can be extended.

    Such a stretch holds one of the places that are need // 2 apart, and as many matches from there on: only those places are
    looked at, and only from those with a row of matches is the stretch followed to its ends.
    """
    a, b = x[: len(x) - q], x[q:]
    m = len(a)
    step = max(1, need // 2)
    at = np.arange(0, m - step + 1, step)
    at = at[a[at] == b[at]]
    at = at[a[at + step - 1] == b[at + step - 1]]
    if len(at):
        probe = at[:, None] + np.arange(min(step, PROBE))
        at = at[(a[probe] == b[probe]).all(1)]
    seen = 0
    for g in at.tolist():
        if g < seen:
            continue
        e, size = g, PROBE
        while e < m:
            bad = np.flatnonzero(a[e : e + size] != b[e : e + size])
            if len(bad):
                e += int(bad[0])
                break
            e, size = min(m, e + size), 2 * size
        s, size = g, PROBE
        while s > 0:
            low = max(0, s - size)
            bad = np.flatnonzero(a[low:s] != b[low:s])
            if len(bad):
                s = low + int(bad[-1]) + 1
                break
            s, size = low, 2 * size
        seen = e
        if e - s >= need:
            yield s, e


def runs_of(x: np.ndarray, counts: np.ndarray, least: int, ratio: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one text, by start and then period; counts[q] are its matches at lag q.

    counts is used up: what a run of period p adds to the counts of p's multiples is taken away once it is found, and so
    no lag is scanned for runs that are known. A stretch that a smaller lag has is that lag's run.
    """
    lags = np.arange(len(counts))
    need = np.maximum(least, ratio * lags) - lags
    out, known = [], set()
    for q in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[q] < need[q]:
            continue
        for s, e in islands(x, q, int(need[q])):
            length = e - s + q
            if (s, length) in known:
                continue
            known.add((s, length))
            out.append((s, length, q))
            more = np.arange(2 * q, min(len(counts), length), q)
            counts[more] -= length - more
    return sorted(out, key=lambda r: (r[0], r[2]))


def batch_runs(texts: list[list[bytes]], least: int, ratio: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number = defaultdict(count().__next__)
    long = [d for d, words in enumerate(texts) if len(words) >= least]
    if not long:
        return out
    starts = np.cumsum([0, *(len(texts[d]) for d in long)])
    ids = np.fromiter((number[w] for d in long for w in texts[d]), np.int64, int(starts[-1]))
    counts = lag_counts(ids, starts, ratio)
    sizes = np.diff(starts)
    lag = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    may = (counts[:-1] >= np.maximum(least, ratio * lag) - lag) & (lag > 0) & (lag <= np.repeat(sizes // ratio, sizes))
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(may), "right") - 1).tolist():
        lo, hi = int(starts[k]), int(starts[k + 1])
        out[long[k]] = runs_of(ids[lo:hi], counts[lo : lo + (hi - lo) // ratio + 1].copy(), least, ratio)
    return out


def without(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, ratio: int = 3) -> DataFrame:
    """Finds the periodic runs of words of every text, and what is left of it when each run is cut to one period.

    A word is a longest stretch of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. A run
    is a stretch of words with smallest period q (words q apart are identical) and a length of at least max(least, ratio * q)
    that no neighbouring word extends with that period. Runs may overlap.

    Returns id, n_words long, runs array<struct<start, length, period>> (word numbers from 0; by start, then period) and
    collapsed string: the words that no run contains after its first period, joined by one blank.

    Null and empty texts and those of white space have no words: no runs, an empty string. Texts are judged one by one:
    repeated rows and ids, and null ids, all stay and each has its result. Other columns are left out, whatever their
    names; an empty table gives none. One pass without a shuffle; memory grows with the longest text, not with the table.
    """
    if least < 2 or ratio < 2:
        raise ValueError("least and ratio must be 2 or more")
    prepare(docs.sparkSession, SMALL_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            texts = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            runs = batch_runs(texts, least, ratio)
            kept = [b" ".join(without(w, r)) for w, r in zip(texts, runs, strict=True)]
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            cols = [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "runs", "collapsed"])
        trim()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents in which every tenth text, by its id's checksum, ends in a repetition of some of its words.

    With h = crc32 of the decimal id, g = h div 10 and n words: where h % 10 = 0 and n > 0, each word i >= a = g % n becomes
    the original word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8); the words are then joined by one blank. Other texts,
    and those of null ids, stay as they are. Returns the columns of docs.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = (g % n).cast("int")
        left = (n - a).cast("int")
        p = F.lit(1) + F.floor(left / (F.lit(3) + g % 8)).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(left / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), left)), " ")

    # the lambda's variable holds the words: they are taken out of the text once
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.col(text_col))), 1)
    return docs.withColumn(text_col, F.when(h % 10 == 0, changed).otherwise(F.col(text_col)))


def longest_run(runs: str = "runs") -> Column:
    """Of an array of runs, that with the greatest length / period; of equal ones the first by start, then period. Null if empty."""
    def later(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.try_element_at(F.col(runs), F.lit(1)), later)
