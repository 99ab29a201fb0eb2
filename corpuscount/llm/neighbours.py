"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Distinct vectors are dealt into shards by a hash, and each shard gets a graph. Points enter it in batches: a
greedy search from the entry point proposes neighbours among those that are in it; relaxed distance pruning keeps
the nearest and drops every candidate that a kept one is nearer to by the factor RELAX; the kept ones link back and
are pruned alike. A query's beam search runs on each shard, and its best finds are merged. Searches and prunings run
for many points at once, as array operations.

Inner products become distances by one more component, sqrt(M**2 - |x|**2), 0 for queries. So that it stays small,
and the graphs fit the queries, shards hold vectors of like length only: a band of BAND in ratio. Scores are
computed in double precision from the vectors as they were.

Equal vectors are one point. Ties go to smaller ids, so no list ever needs more of them than its own length and
one: those ids are kept, by a limit within each task before the exchange. A vector that a third of all rows share is
thus no larger than others, as a candidate or as a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuscount.runtime import parallelism, prepare, written

DEGREE, BUILD_BEAM, RELAX = 48, 96, 1.2
#: A query's beam on a shard of n points: BEAM_ROOT * sqrt(n), and BEAM at least. Measured so that recall at 20 is over 0.9 for
#: independent directions in 64 dimensions, the hardest case, at 8,000, 40,000 and 100,000 points (README).
BEAM, BEAM_ROOT = 96, 1.25
#: Points of a shard and bytes of their vectors at most, and shards at least.
SHARD, SHARD_BYTES, SHARDS = 100_000, 128 << 20, 6
#: Queries that meet a copy of a graph: tasks end within minutes, and graphs are seldom copied.
QUERIES = 262_144
BAND = 1.25
#: Points handled together, and nodes that a search expands at a time.
TOGETHER, WIDTH = 256, 4


def lifted(x: np.ndarray) -> np.ndarray:
    """The points with the component that makes the nearest the one with the largest inner product."""
    sq = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], axis=1).astype(np.float32)


class Graph:
    """Directed graph over the rows of x. Missing edges are -1."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = x, edges, entry
        self.sq = np.einsum("ij,ij->i", x, x)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams of the queries, nearest first: nodes (or -1) and squared distances without |q|**2."""
        b, n = len(q), len(self.x)
        seen = np.zeros((b, n), bool)
        row = np.arange(b)
        node = np.full((b, beam), -1)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        node[:, 0], open_[:, 0] = self.entry, True
        dist[:, 0] = self.sq[self.entry] - 2 * q @ self.x[self.entry]
        seen[:, self.entry] = True
        active = row
        while len(active):
            o = open_[active]
            pick = np.argsort(~o, axis=1, kind="stable")[:, :WIDTH]  # the nearest open ones
            has = np.take_along_axis(o, pick, 1)
            at = np.take_along_axis(node[active], pick, 1)
            o[np.arange(len(active))[:, None], pick] = False
            new = np.where(has[:, :, None], self.edges[at], -1).reshape(len(active), -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[active[:, None], new]
            r, c = np.nonzero(fresh)
            to = new[r, c]
            seen[active[r], to] = True
            d = np.full(new.shape, np.inf, np.float32)
            d[r, c] = self.sq[to] - 2 * np.einsum("ij,ij->i", q[active[r]], self.x[to])
            new[~fresh] = -1
            all_d = np.concatenate([dist[active], d], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), axis=1, kind="stable"), 1)
            dist[active] = np.take_along_axis(all_d, keep, 1)
            node[active] = np.take_along_axis(np.concatenate([node[active], new], axis=1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate([o, fresh], axis=1), keep, 1)
            active = active[open_[active].any(axis=1)]
        return node, dist


def pruned(x: np.ndarray, sq: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1: none): the nearest left, without those it makes needless."""
    own = np.where(cand >= 0, cand, 0)
    d = sq[own] + sq[points][:, None] - 2 * np.einsum("bcd,bd->bc", x[own], x[points], optimize=True)
    d[(cand < 0) | (cand == points[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    own, d = np.take_along_axis(own, order, 1), np.take_along_axis(d, order, 1)
    again = np.zeros(d.shape, bool)  # a candidate named twice
    by = np.argsort(own, axis=1, kind="stable")
    s = np.take_along_axis(own, by, 1)
    np.put_along_axis(again[:, :], by[:, 1:], (s[:, 1:] == s[:, :-1]), 1)
    v = x[own]
    between = sq[own][:, :, None] + sq[own][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d) & ~again
    out = np.full((len(points), degree), -1)
    row = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        ok = alive[row, first]
        if not ok.any():
            break
        out[ok, k] = own[ok, first[ok]]
        alive &= RELAX * RELAX * between[row, first] > d
        alive[row, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1) -> Graph:
    """The graph of all rows of x (points as lifted() gives them)."""
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    x_in = x[order]  # points enter in this order; edges are turned back at the end
    sq = np.einsum("ij,ij->i", x_in, x_in)
    edges = np.full((n, degree), -1)
    first = min(n, 2 * degree)
    edges[:first] = pruned(x_in, sq, np.arange(first), np.tile(np.arange(first), (first, 1)), degree)
    entry = int(np.argmin(((x_in[: min(n, 10_000)] - x_in.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
    entry = entry if entry < first else 0
    at = first
    while at < n:
        points = np.arange(at, min(n, at + min(TOGETHER, at)))
        g = Graph.__new__(Graph)
        g.x, g.edges, g.entry, g.sq = x_in[:at], edges[:at], entry, sq[:at]
        found, _ = g.search(x_in[points], beam)
        edges[points] = pruned(x_in, sq, points, found, degree)
        # link back
        r, c = np.nonzero(edges[points] >= 0)
        to, new = edges[points[r], c], points[r]
        s = np.argsort(to, kind="stable")
        to, new = to[s], new[s]
        hit, begin, count = np.unique(to, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        more = np.full((len(hit), wide), -1)
        slot = np.arange(len(to)) - np.repeat(begin, count)
        more[np.repeat(np.arange(len(hit)), count), slot] = new
        both = np.concatenate([edges[hit], more], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        room = np.argsort(both[~full] < 0, axis=1, kind="stable")[:, :degree]
        edges[hit[~full]] = np.take_along_axis(both[~full], room, 1)
        over = np.nonzero(full)[0]
        for k in range(0, len(over), TOGETHER):
            o = over[k : k + TOGETHER]
            edges[hit[o]] = pruned(x_in, sq, hit[o], both[o], degree)
        at = int(points[-1]) + 1
    g = Graph(x_in, edges, entry)
    connect(g)
    back = np.empty_like(order)
    back[order] = np.arange(n)
    turned = np.where(g.edges >= 0, order[g.edges], -1)
    return Graph(x, turned[back], int(order[entry]) if n else 0)


def connect(g: Graph) -> None:
    """Give every node that can't be reached from the entry an edge from one near it that can."""
    n = len(g.x)
    reached = np.zeros(n, bool)
    front = np.array([g.entry][:n])
    while True:
        while len(front):
            reached[front] = True
            nxt = np.unique(g.edges[front])
            front = nxt[(nxt >= 0) & ~reached[np.maximum(nxt, 0)]]
        lost = np.nonzero(~reached)[0]
        if not len(lost):
            return
        one = lost[:1]
        near = int(g.search(g.x[one], BUILD_BEAM)[0][0, 0])
        free = np.nonzero(g.edges[near] < 0)[0]
        if not len(free):
            g.edges = np.concatenate([g.edges, np.full((n, 1), -1)], axis=1)
            free = [g.edges.shape[1] - 1]
        g.edges[near, free[0]] = one[0]
        front = one


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v) for v in series]) if len(series) else np.zeros((0, 0))


def _usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def beam_of(n: int) -> int:
    return max(BEAM, math.ceil(BEAM_ROOT * math.sqrt(n)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int | None = None) -> DataFrame:
    """Each query's k nearest found among all other rows: query_id, rank (from 1), vec_id, score, nearest first.

    Nearness is the inner product in double precision; ties go to the smaller id. Fewer than k only where there are no
    more candidates. beam: that of all shards, if not as beam_of() says. Rows without an id, and vectors that are null, empty,
    zero or hold null or non-finite components take no part; vectors of different lengths never meet. Rows with the same id and
    vector count once; rows with one id and different vectors are candidates each, and as queries their lists stand beside one
    another, so such an id should name one row. Other columns are left out; an empty table gives none.

    A graph is a row, and bounded by SHARD and SHARD_BYTES. Queries come to the graphs: a task has its graphs in order, each
    before its queries, which pass in Arrow batches; it holds one graph and one batch.
    """
    spark = prepare(vectors.sparkSession)
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(f"`{vector_col}`"))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
    rows = rows.dropDuplicates(["id", "v"])
    single = rows.schema["v"].dataType.elementType.simpleString() == "float"
    kind, width = (np.float32, 4) if single else (np.float64, 8)
    # of each distinct vector the k + 1 smallest ids
    w = W.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    members = written(members.groupBy("v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = written(rows.where("q").groupBy("v").agg(F.min("id").alias("query")))
    n_points, dims = members.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards, blocks = max(SHARDS, -(-n_points // max(1, min(SHARD, SHARD_BYTES // (width * dims))))), max(1, -(-asked.count() // QUERIES))

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    band = F.round(F.log(length) / F.log(F.lit(BAND))).cast("int")
    dealt = members.select("point", "v", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), band.alias("band"))
    schema = "shard int, dim int, band int, points binary, vectors binary, edges binary, degree int, entry int"

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf["v"]).astype(kind)
        g = build(lifted(x.astype(np.float64)))
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "band": [key[2]], "points": [pdf["point"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "edges": [g.edges.astype(np.int32).tobytes()], "degree": [g.edges.shape[1]], "entry": [g.entry]})

    graphs = written(dealt.groupBy("shard", "dim", "band").applyInPandas(index, schema))
    place = ["shard", "dim", "band", "block"]
    here = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"query": F.lit(None).cast("long"), "v": F.lit(None).cast(rows.schema["v"].dataType)})
    queries = asked.select("query", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    queries = queries.join(graphs.select("shard", "dim", "band"), "dim")  # with every graph of their dimension
    both = here.unionByName(queries, allowMissingColumns=True)
    n_parts = max(parallelism(spark), min(10_000, graphs.count() * blocks))
    both = both.repartition(n_parts, *place).sortWithinPartitions(*place, F.col("query").asc_nulls_first())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = x = g = None
        for b in batches:
            heads = set(np.flatnonzero(np.asarray(b.column("query").is_null())).tolist())
            for at, to in pairwise(sorted({0, *heads, len(b)})):
                if at in heads:  # a graph; its queries follow, in this batch and the next ones
                    r = {c: b.column(c)[at].as_py() for c in ("points", "vectors", "edges", "entry")}
                    points = np.frombuffer(r["points"], np.int64)
                    x = np.frombuffer(r["vectors"], kind).reshape(len(points), -1).astype(np.float64)
                    g = Graph(lifted(x), np.frombuffer(r["edges"], np.int32).reshape(len(points), -1), r["entry"])
                    at += 1
                if at == to:
                    continue
                part = b.slice(at, to - at)
                ids = part.column("query").to_numpy(zero_copy_only=False).astype(np.int64)
                q = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                step = max(16, min(TOGETHER, 64_000_000 // len(points)))
                for n in range(0, len(ids), step):
                    yield _found(points, x, g, ids[n : n + step], q[n : n + step], k, max(beam or beam_of(len(points)), 2 * k))

    found = both.mapInArrow(find, "query long, point long, score double")
    top = W.partitionBy("query").orderBy(F.desc("score"), "point")
    found = found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    # points to their ids; the best k + 1 of each distinct query vector
    ids = found.join(members.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    best = ids.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("list"))
    lists = lists.join(asked, "query").select("v", "list")
    each = rows.where("q").select(F.col("id").alias("query_id"), "v").join(lists, "v").select("query_id", F.slice(F.filter("list", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return each.select("query_id", F.posexplode("list").alias("pos", "s")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), (-F.col("s.far")).alias("score"))


def _found(points: np.ndarray, x: np.ndarray, g: Graph, ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """The k + 1 nearest points found for each of some queries, with exact scores."""
    node, _ = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), beam)
    exact = np.where(node >= 0, np.einsum("bkd,bd->bk", x[np.maximum(node, 0)], q), -np.inf)
    best = np.lexsort((points[np.maximum(node, 0)], -exact), axis=1)[:, : k + 1]
    node, exact = np.take_along_axis(node, best, 1), np.take_along_axis(exact, best, 1)
    a, b = np.nonzero(node >= 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(points[node[a, b]]), pa.array(exact[a, b])], ["query", "point", "score"])


def recall(found: Iterator[tuple[int, int]], exact: Iterator[tuple[int, int]]) -> float:
    """The share of exact (query, neighbour) pairs that were found."""
    want = set(exact)
    return len(want & set(found)) / max(1, len(want))
