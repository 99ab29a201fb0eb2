"""Exact removal of repeated byte strings by suffix arrays built with linear grouping.

Every byte goes that a string of LENGTH bytes covers which also starts anywhere else in the corpus. Where strings start
that occur once only is found in three steps, all exact but for hashes:

1. Tiles. A string's *anchor* is the position of the least hash of its K-grams (the last of several): equal strings have
   it at equal offsets. The strings with one anchor and like offsets (TILE of them) start in one tile and share a *core*,
   the bytes that all of them hold. Hashes of cores are counted over the corpus, by a tree of exchange. In
   tiles whose core occurs once, no string repeats.
2. Suffix arrays. The tiles with one core meet, each distinct one twice if it stands in several places. They are one text
   for the construction: a tile is written as the bytes left of the core, one letter for the core, the bytes right of it, and
   an end of its own; its strings are those of TILE letters. What no other tile of the core goes on with is cut
   off. The text's suffix array shows which strings stand elsewhere: those with a neighbour that agrees in TILE letters.
   No repeat is found in any other way.
3. Cover. Each text gets its tiles' repeated starts back as bit masks.

The suffix array comes from linear grouping: suffixes are grouped by their Lyndon prefixes, from the highest group to
the lowest, each group extending the prefixes of the suffixes that it points to as their next smaller; a second pass
emits the order of each group without naming anything anew. grouping() does that for one text, grouping_many() for
thousands of short ones at once, as array operations: in each step the highest open group of every text.

Equal texts go once, as texts that stand in several places. Equal tiles of a block go out once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.llm import exchange, grams
from corpuscount.llm.exchange import Counts, Tree, lean
from corpuscount.llm.grams import U
from corpuscount.llm.skew import joined
from corpuscount.runtime import SMALL_BATCH, prepare, written

K, TILE = 32, 32
BITS = 56
#: Starts looked at together; letters of the texts whose arrays are built at once (more only where one core has more).
SPAN, LETTERS = 1 << 17, 1 << 17
#: Texts are built one by one where fewer than so many of the longest one's length come together.
TOGETHER = 32


def grouping(text: list[int]) -> list[int]:
    """The suffix array of a text whose last letter is less than all others and occurs once."""
    n = len(text)
    # groups by first letter, in order; a group is named by its first place
    sa = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    g = 0
    for r, i in enumerate(sa):
        if text[i] != text[sa[g]]:
            g = r
        place[i], group[i] = r, g
        size[g] += 1
    smaller = [-1] * n  # the last suffix before it in a lower group
    end = n
    while end:
        g = group[sa[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(sa[g:end]) if end - g > 1 else sa[g:end]:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        end = g
        if not times:
            continue
        # those that a group follows more often come after those that it follows less often
        classes: dict[int, list[int]] = {}
        for j, m in times.items():
            classes.setdefault(m, []).append(j)
        for m in sorted(classes, reverse=True) if len(classes) > 1 else classes:
            moved: dict[int, int] = {}
            for j in classes[m]:
                q = group[j]
                last = q + size[q] - 1
                other, at = sa[last], place[j]
                sa[last], sa[at] = j, other
                place[j], place[other] = last, at
                size[q] -= 1
                moved[q] = moved.get(q, 0) + 1
            for q, k in moved.items():
                new = q + size[q]
                if new != q:
                    for r in range(new, new + k):
                        group[sa[r]] = new
                size[new] = k
    out, free = [-1] * n, list(range(n))
    out[0] = n - 1
    put = [False] * n
    put[n - 1] = True
    free[0] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = smaller[j]
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, … for each k, count[k] of them."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def grouping_many(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts text[off[k]:off[k + 1]], longest first, in places of the whole. Each text's last letter is
    less than all others of it and occurs once."""
    n = len(text)
    begin, stop = off[:-1], off[1:]
    owner = np.repeat(np.arange(len(begin)), stop - begin)
    floor = begin[owner]  # where the text of each place begins
    sa = np.lexsort((text, owner))
    letters = text[sa]
    new = np.ones(n, bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    place, group, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[sa] = np.arange(n)
    size[head] = np.diff(np.append(head, n))
    group[sa] = np.repeat(head, size[head])
    smaller, marked = np.full(n, -1), np.zeros(n, bool)
    end = stop.copy()
    active = np.flatnonzero(end > begin)
    while len(active):
        top = end[active]
        g = group[sa[top - 1]]
        members = sa[_ranges(g, top - g)]
        own = group[members]
        j = members - 1
        j[j < floor[members]] = -1
        far = np.flatnonzero((j >= 0) & (group[j] > own))  # beyond higher groups, whose pointers are known
        while len(far):
            to = smaller[j[far]]
            j[far] = to
            far = far[(to >= 0) & (group[to] > own[far])]
        smaller[members] = j
        far = np.flatnonzero((j >= 0) & (group[j] == own))  # then within the group, by doubling
        while len(far):
            to = smaller[j[far]]
            j[far] = to
            smaller[members[far]] = to
            far = far[(to >= 0) & (group[to] == own[far])]
        end[active] = g
        active = active[g > begin[active]]
        pointed, times = np.unique(j[j >= 0], return_counts=True)
        if not len(pointed):
            continue
        most = np.flatnonzero(np.bincount(times))[::-1].tolist()
        # those that a group follows more often come after those that it follows less often
        for m in most:
            js = pointed[times == m] if len(most) > 1 else pointed
            q = group[js]
            order = np.argsort(q, kind="stable")
            js, q = js[order], q[order]
            edge = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            which, count = q[edge], np.diff(np.append(edge, len(q)))
            left = size[which] - count
            fresh = which + left  # the new group's first place
            tail = _ranges(fresh, count)
            marked[js] = True
            there = sa[tail]
            other = ~marked[there]
            marked[js] = False
            out = js[place[js] < np.repeat(fresh, count)]  # as many as the others in the tails, group by group
            to, moved = tail[other], there[other]
            back = place[out]
            sa[to], sa[back] = out, moved
            place[out], place[moved] = to, back
            group[js] = np.repeat(fresh, count)
            size[which] = left
            size[fresh] = count
    # the order within groups
    result, free, put = np.full(n, -1), np.arange(n), np.zeros(n, bool)
    result[begin] = stop - 1
    put[stop - 1] = True
    free[begin] += 1
    length = stop - begin
    open_ = len(begin)
    for r in range(int(length[0]) if len(length) else 0):
        while length[open_ - 1] <= r:
            open_ -= 1
        at = result[begin[:open_] + r]
        j = at - 1
        j = j[j >= floor[at]]
        j = j[~put[j]]
        while len(j):
            g = group[j]
            to = free[g]
            result[to] = j
            free[g] = to + 1
            put[j] = True
            j = smaller[j]
            j = j[j >= 0]
            j = j[~put[j]]
    return result


# --- tiles of a text ---------------------------------------------------------------------------------------------


def _kgrams(b: np.ndarray) -> np.ndarray:
    h, step = (b.astype(U) + U(1)) * U(grams.MIX[0]), 1
    while step < K:
        x = h[step:]
        h = h[:-step] * U(grams.BASE) + (x ^ (x >> U(29)))
        h ^= h >> U(31)
        step *= 2
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` values in a row; the last of equal ones."""
    n = len(h)
    key = (h & ~U(0xFFFFFF)) | (U(0xFFFFFF) - np.arange(n, dtype=U))
    full = np.full(-(-n // width) * width, ~U(0))
    full[:n] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (U(0xFFFFFF) - (low & U(0xFFFFFF))).astype(np.int64)


def tiles(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start of each tile, which may lie before the text; hash of its core), in ascending order."""
    n = len(b) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, U)
    width, core = length - K + 1, length - TILE + 1
    starts, cores = [], []
    for at in range(0, n, SPAN):
        own = b[at : at + SPAN + length - 1]
        p, inverse = grams.powers(len(own) + 1)
        anchor = _least(_kgrams(own), width)
        offset = anchor - np.arange(len(anchor))
        here = np.zeros(len(own), bool)
        here[anchor - (offset // TILE) * TILE] = True
        first = np.flatnonzero(here) - (TILE - 1)  # one tile for each place of a core
        sums = np.concatenate([[U(0)], np.cumsum((own.astype(U) + U(1)) * p[: len(own)])])
        s = first + TILE - 1
        starts.append(first + at)
        cores.append(grams.mixed((sums[s + core] - sums[s]) * inverse[s]) >> U(64 - BITS))
    first, core_hash = np.concatenate(starts), np.concatenate(cores)
    if len(starts) > 1:
        first, k = np.unique(first, return_index=True)
        core_hash = core_hash[k]
    return first, core_hash


def sides(b: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of each tile's core: rows of TILE bytes, the first of them how many of the others count.

    Left is reversed: nearest to the core first.
    """
    side = TILE - 1
    pad = np.concatenate([np.zeros(TILE, np.uint8), b, np.zeros(TILE, np.uint8)])
    left = np.zeros((len(first), TILE), np.uint8)
    right = np.zeros((len(first), TILE), np.uint8)
    left[:, 0] = np.minimum(side, first + side)
    right[:, 0] = np.clip(len(b) - (first + length), 0, side)
    k = np.arange(side)
    left[:, 1:] = pad[TILE + first[:, None] + side - 1 - k]
    right[:, 1:] = pad[np.minimum(TILE + first[:, None] + length + k, len(pad) - 1)]
    for x in (left, right):
        x[:, 1:][k >= x[:, :1]] = 0
    return left, right


# --- blocks of texts ---------------------------------------------------------------------------------------------


class Block:
    """The distinct texts of a block in the order of their names, their tiles, and the distinct cores."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        pdf = pdf.sort_values(["h1", "h2"], kind="stable")
        same = pdf.groupby(["h1", "h2"], sort=True)
        self.names = np.array(list(same.groups), np.int64).reshape(-1, 2)
        self.several = same.size().to_numpy() > 1
        self.texts = exchange.plain(same["text"].first())
        self.bytes = [np.frombuffer(x, np.uint8) for x in self.texts]
        got = [tiles(b, length) for b in self.bytes]
        self.count = np.array([len(f) for f, _ in got])
        self.first = np.concatenate([f for f, _ in got]) if got else np.zeros(0, np.int64)
        core = np.concatenate([c for _, c in got]) if got else np.zeros(0, U)
        self.cores, self.place = np.unique(core, return_inverse=True)
        self.times = np.repeat(1 + self.several, self.count)  # in how many places each tile stands: 1, or more
        self.core_times = np.bincount(self.place, weights=self.times, minlength=len(self.cores)).astype(np.int64)

    def repeated(self, total: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(tiles whose core occurs again; their left and right sides in one row), in the order of tiles."""
        if len(total) != len(self.cores):
            raise ValueError("a block's texts are not those that were counted")
        again = total[self.place] > 1
        off = np.concatenate([[0], np.cumsum(self.count)])
        rows = []
        for k, b in enumerate(self.bytes):
            own = again[off[k] : off[k + 1]]
            if own.any():
                rows.append(np.concatenate(sides(b, self.first[off[k] : off[k + 1]][own], length), axis=1))
        return np.flatnonzero(again), np.concatenate(rows) if rows else np.zeros((0, 2 * TILE), np.uint8)

    def sent(self, total: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (core, sides) of the repeated tiles, by core: cores, sides, in how many places; and for each
        repeated tile its place among them."""
        at, rows = self.repeated(total, length)
        return distinct_tiles(self.cores[self.place[at]], rows, self.times[at])


def distinct_tiles(core: np.ndarray, rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (core, sides) in the order of cores, how often each occurs, and for each tile its place among them."""
    if not len(core):
        return core, rows, times, np.zeros(0, np.int64)
    words = np.ascontiguousarray(rows).view("<u8").astype(U)
    h = np.zeros(len(core), U)
    for k in range(words.shape[1]):
        h = grams.mixed(h * U(grams.BASE) + words[:, k])
    order = np.lexsort((h, core))
    c, h = core[order], h[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
    ids = np.cumsum(new) - 1
    place = np.empty(len(c), np.int64)
    place[order] = ids
    head = order[new]
    return core[head], rows[head], np.bincount(place, weights=times, minlength=len(head)).astype(np.int64), place


class Tiles:
    """Entries of tiles: (cores in ascending order, (sides, in how many places, 2 at most)). Answers: masks."""

    bits = BITS

    def none(self) -> tuple:
        return np.zeros(0, U), (np.zeros((0, 2 * TILE), np.uint8), np.zeros(0, np.int64))

    def pack(self, own: tuple, i: int, j: int, low: int) -> bytes:
        return exchange._joined([grams.packed(own[0][i:j], low), own[1][0][i:j].tobytes(), np.packbits(own[1][1][i:j] > 1).tobytes()])

    def unpack(self, raw: bytes, low: int) -> tuple:
        core, rows, several = exchange._parted(raw)
        core = grams.unpacked(core, low)
        return core, (np.frombuffer(rows, np.uint8).reshape(-1, 2 * TILE), 1 + np.unpackbits(np.frombuffer(several, np.uint8), count=len(core)).astype(np.int64))

    def merge(self, lists: list[tuple]) -> tuple[tuple, list[np.ndarray]]:
        core = np.concatenate([x[0] for x in lists])
        c, rows, times, place = distinct_tiles(core, np.concatenate([x[1][0] for x in lists]), np.concatenate([x[1][1] for x in lists]))
        return (c, (rows, np.minimum(times, 2))), np.split(place, np.cumsum([len(x[0]) for x in lists])[:-1])

    def pack_answer(self, answer: np.ndarray) -> bytes:
        return answer[0].astype("<u4").tobytes()

    def unpack_answer(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u4").astype(np.int64)[None]


def blocks_of(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """(block, h1, h2, text): each task sends a text once, compressed, and once again without the text if it has it more than once."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for b in batches:
            keep, bare = [], []
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                times = sent.get(key, 0)
                if times < 2:
                    sent[key] = times + 1
                    (bare if times else keep).append(k)
            for some, with_text in ((keep, True), (bare, False)):
                part = b.take(pa.array(some, pa.int32()))
                block = pa.array(np.array(part.column(0)).astype(np.int64) % blocks)
                yield pa.RecordBatch.from_arrays([block, part.column(0), part.column(1), exchange.squeezed(part.column(2)) if with_text else pa.nulls(len(some), pa.binary())], ["block", "h1", "h2", "text"])

    return exchange.by_block(rows.mapInArrow(run, "block long, h1 long, h2 long, text binary"), blocks)


# --- strings of one core -----------------------------------------------------------------------------------------


def _agree(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes of two rows agree before the first that doesn't, at most ``limit``."""
    off = a != b
    return np.minimum(np.where(off.any(axis=1), off.argmax(axis=1), a.shape[1]), limit)


def _reach(core: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How far each row goes along with any other of its core."""
    flat = np.zeros((len(core), 32), np.uint8)
    flat[:, 1:] = rows[:, 1:]
    words = flat.view(">u8").astype(U)
    # padded with zeros; of rows that differ only in how many real zeros end them the shorter comes first
    order = np.lexsort([rows[:, 0], *words.T[::-1], core])
    c, r = core[order], rows[order]
    near = np.where(c[1:] == c[:-1], _agree(r[1:, 1:], r[:-1, 1:], np.minimum(r[1:, 0], r[:-1, 0])), 0)
    best = np.zeros(len(core), np.int64)
    best[:-1] = near
    best[1:] = np.maximum(best[1:], near)
    out = np.empty(len(core), np.int64)
    out[order] = best
    return out


def repeated_starts(core: np.ndarray, rows: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For distinct tiles (ascending cores, sides, whether each stands in several places): masks of the starts that repeat.

    Bit x of a mask stands for the string with x bytes right of the core.
    """
    left, right = rows[:, 0].astype(np.int64), rows[:, TILE].astype(np.int64)
    _, place, n = np.unique(core, return_inverse=True, return_counts=True)
    # of a tile that stands once, only what another goes along with
    some = np.flatnonzero(n[place] > 1)
    reach = [_reach(core[some], rows[some, side]) for side in (slice(0, TILE), slice(TILE, 2 * TILE))]
    once = ~several[some]
    left[some[once]], right[some[once]] = reach[0][once], reach[1][once]
    left[~several & (n[place] == 1)] = -1
    tile = np.concatenate([np.arange(len(core)), np.flatnonzero(several)])
    tile = tile[(left + right >= TILE - 1)[tile]]
    found = np.zeros((len(core), TILE), bool)
    if not len(tile):
        return np.zeros(len(core), np.int64)
    tile = tile[np.argsort(core[tile], kind="stable")]
    # a text for each core; longest first
    length = (left + right + 2)[tile]
    edge = np.flatnonzero(np.append(True, core[tile[1:]] != core[tile[:-1]]))
    total = np.add.reduceat(length, edge)
    count = np.diff(np.append(edge, len(tile)))
    order = np.argsort(-total, kind="stable")
    edge, total, count = edge[order], total[order], count[order]
    ends = np.cumsum(total)
    k = 0
    while k < len(edge):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LETTERS, "right")))
        own = tile[_ranges(edge[k:stop], count[k:stop])]
        hit = _by_suffixes(rows[own], left[own], right[own], count[k:stop])
        found[own[hit // TILE], hit % TILE] = True
        k = stop
    return found @ (1 << np.arange(TILE))


def _by_suffixes(rows: np.ndarray, left: np.ndarray, right: np.ndarray, count: np.ndarray) -> np.ndarray:
    """TILE * tile + x of the strings that the suffix arrays of texts of so many tiles each show in several places."""
    m = len(rows)
    size = left + right + 2
    at = np.cumsum(size) - size
    home = np.repeat(np.arange(m), size)
    j = np.arange(len(home)) - at[home]
    a, b = left[home], right[home]
    # bytes are above the ends, and the core's letter is above all; ends fall, so that the last is the least
    text_of = np.repeat(np.arange(len(count)), count)
    number = np.arange(m) - (np.cumsum(count) - count)[text_of]
    column = np.where(j < a, a - j, np.clip(TILE + j - a, 0, 2 * TILE - 1))
    text = rows[home, column].astype(np.int64) + m
    text[j == a] = m + 256
    last = j == a + b + 1
    text[last] = (count[text_of] - 1 - number)
    x = np.where((j <= a) & (TILE - 1 - a + j <= b), TILE - 1 - a + j, -1)
    letters = np.add.reduceat(size, np.cumsum(count) - count)
    off = np.concatenate([[0], np.cumsum(letters)])
    if off[-1] < TOGETHER * letters[0]:
        sa = np.concatenate([np.array(grouping(text[p:q].tolist())) + p for p, q in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
    else:
        sa = grouping_many(text, off)
    one, two = sa[:-1], sa[1:]
    asked = (x[one] >= 0) & (x[one] == x[two]) & (text_of[home[one]] == text_of[home[two]])
    one, two = one[asked], two[asked]
    # neighbours agree in TILE letters if their tiles do on both sides of the core, as far as the strings go
    pair, place = np.unique(np.minimum(home[one], home[two]) * m + np.maximum(home[one], home[two]), return_inverse=True)
    p, q = pair // m, pair % m
    on_left = _agree(rows[p, 1:TILE], rows[q, 1:TILE], np.minimum(left[p], left[q]))
    on_right = _agree(rows[p, TILE + 1 :], rows[q, TILE + 1 :], np.minimum(right[p], right[q]))
    same = (on_left[place] >= TILE - 1 - x[one]) & (on_right[place] >= x[one])
    one, two = one[same], two[same]
    hit = np.zeros(m * TILE, bool)
    for k in (one, two):
        hit[home[k] * TILE + x[k]] = True
    return np.flatnonzero(hit)


# --- the operator ------------------------------------------------------------------------------------------------


def covered(first: np.ndarray, masks: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs that the strings at the marked starts cover."""
    t, x = np.nonzero((masks[:, None] >> np.arange(TILE, dtype=U)) & U(1))
    starts = np.unique(first[t] + x)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + length


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, fan: int = exchange.FAN) -> DataFrame:
    """(h1, h2, n_bytes, n_removed, n_spans, kept_sha256, kept) for every distinct text: ``kept`` is what stays
    of one that loses something, without code points that lose only some bytes."""
    if length < K + TILE:
        raise ValueError(f"length must be {K + TILE} or more")
    blocks = exchange.blocks_for(docs, text_col)
    counted, tiled = Tree(blocks, [Counts(BITS, 1, 2)], fan), Tree(blocks, [Tiles()], fan)

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def work() -> pd.DataFrame:
            own = Block(pdf, length)
            return counted.sent([(own.cores, np.minimum(own.core_times, 2)[None])], int(key[0]))

        return lean(work)

    back = counted.run(blocks_of(docs, text_col, blocks).groupBy("block").applyInPandas(emit, counted.up_schema), lambda own: ([own[0][1]], None))

    def send(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        def work() -> pd.DataFrame:
            core, rows, times, _ = Block(pdf, length).sent(counted.answered(got)[0][0], length)
            return tiled.sent([(core, (rows, times))], int(key[0]))

        return lean(work) if len(pdf) else pd.DataFrame(columns=tiled.up_names)

    def sort(own: list) -> tuple[list[np.ndarray], None]:
        core, (rows, times) = own[0]
        return [repeated_starts(core, rows, times > 1)[None]], None

    sent = blocks_of(docs, text_col, blocks).groupBy("block").cogroup(back.groupBy("g")).applyInPandas(send, tiled.up_schema)
    masks = tiled.run(sent, sort)
    both = back.select("g", "s", "a0", F.lit(None).cast("binary").alias("m0")).unionByName(masks.select("g", "s", F.lit(None).cast("binary").alias("a0"), F.col("a0").alias("m0")))

    def cover(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return lean(_covered, pdf, got) if len(pdf) else pd.DataFrame(columns=names)

    def _covered(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = Block(pdf, length)
        total = counted.answered(got[got["a0"].notna()])[0][0]
        _, _, _, place = own.sent(total, length)
        mask = tiled.answered(got[got["m0"].notna()].drop(columns="a0").rename(columns={"m0": "a0"}))[0][0][place].astype(U)
        at = np.flatnonzero(total[own.place] > 1)
        off = np.concatenate([[0], np.cumsum(own.count)])
        for k, raw in enumerate(own.texts):
            i, j = np.searchsorted(at, off[k : k + 2])
            a, b = covered(own.first[at[i:j]], mask[i:j], len(raw), length)
            ends = [0, *b.tolist()]
            kept = b"".join([raw[p:q] for p, q in zip(ends, [*a.tolist(), len(raw)], strict=True)])
            out.append((own.names[k, 0], own.names[k, 1], len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if len(a) else None))
        return pd.DataFrame(out, columns=names)

    names = ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    again = blocks_of(docs, text_col, blocks)
    return again.groupBy("block").cogroup(both.groupBy("g")).applyInPandas(cover, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay, joined).

    Matches lie within texts, and count within one text too, overlapping ones as well. Null text counts as empty: nothing
    to remove. Rows with equal texts repeat each other. Every row stays; other columns are left out; an empty table
    gives none.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    found = repeated_spans(docs, text_col, length).drop("kept")
    rows = written(docs.select(F.col(id_col).alias(id_col), F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"), F.col(text_col).isNull().alias("none")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    full = joined(rows.where(~F.col("none")), found, ["h1", "h2"]).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    zero = F.lit(0).cast("long")
    return full.unionByName(rows.where("none").select(id_col, zero.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), none.alias("kept_sha256")))


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, size_col: str = "n_chars") -> DataFrame:
    """docs with the repeated strings taken out of their texts, and size_col, if there is one, counted anew.

    A code point of which only some bytes go goes whole. Null texts stay null; rows and other columns stay as they are.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    found = repeated_spans(docs, text_col, length)
    # of texts that lose something, what is left; all others stay out of the exchange
    new = written(found.where("n_removed > 0").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("kept").alias("__kept")))
    exchange.freed(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})
    both = joined(keyed, new, ["__h1", "__h2"])
    put = F.when(text.isNull(), text).otherwise(F.coalesce("__kept", text))
    out = both.select(*[put.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn(size_col, F.char_length(text).cast("long")) if size_col in docs.columns else out
