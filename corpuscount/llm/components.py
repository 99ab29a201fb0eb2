"""Connected components by contraction, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.exchange import compact
from corpuscount.runtime import few


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): two nodes have one root exactly where a path joins them.

    In each round every node goes to that one, of itself and its neighbours, which comes first in an order drawn anew;
    edges are then drawn between those. Their number falls by a factor a round, whatever the shape of the graph. Each
    round's edges and mapping are written to the shared folder; only their count comes to the driver. A round has as many
    tasks as its edges need: there are many rounds, and most are short.
    """
    edges = compact(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = edges.count()
    most, step = 2 * n, 0  # of nodes, at the beginning
    roots = edges.selectExpr("explode(array(a, b)) as node").distinct().withColumn("root", F.col("node"))
    while n:
        step += 1
        first = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), first("b").alias("x")).union(edges.select(F.col("b").alias("node"), first("a").alias("x")))
        to = both.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("x", first("node"))["to"].alias("to"))
        to = compact(few(to, 2 * n))
        roots = compact(few(roots.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), most))
        new = few(edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a"), n)
        new = few(new.join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b"), n)
        new = new.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = compact(few(new, n))
        n = edges.count()
    return roots
