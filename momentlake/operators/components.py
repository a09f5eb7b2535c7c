"""Connected components of an undirected graph, by local contraction.

Each round every node points to the node with the smallest hash for that round within
two steps, and the edges are relabelled by those pointers. Two steps let a star fall
together at once, whatever its centre's hash; hashes change with the round, so chains
shrink by a constant factor in expectation and the number of rounds is logarithmic. A
round is two partially aggregated minima and three equi-joins, which adaptive execution
can split when a hub is hot; nothing is collected to the driver. (After Lacki, Mirrokni
and Wlodarczyk, "Connected components at scale via local contractions", 2018.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.plans.lineage import Scratch, cut, join_groups


def _undirected(edges: DataFrame) -> DataFrame:
    pair = edges.where(F.col("a") != F.col("b"))
    return pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moved(left: DataFrame, to: DataFrame) -> DataFrame:
    """Edges between what the ends point to; an end without a pointer stays."""
    end = lambda x: to.select(F.col("u").alias(x), F.col("to").alias(f"t{x}"))
    both = left.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return _undirected(both.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", share: int = 1) -> DataFrame:
    """``(node, component)`` of every node of ``edges``; component is the smallest node.

    Loops count as nodes; rows with a null end are no edges. Repeated and reversed
    edges change nothing. An empty input gives an empty result.

    Where nodes have many edges each, one edge in ``share`` is contracted first: it mostly
    joins what all of them join, so nearly all others are loops by then. The result is the same.
    """
    scratch = Scratch(edges.sparkSession)
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    raw = scratch.table(raw)
    way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    left = scratch.table(_undirected(raw))
    pointers: list[DataFrame] = []
    if share > 1:
        some = connected_components(left.where(F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0))
        pointers.append(scratch.table(some.select(F.col("node").alias("u"), F.col("component").alias("to"))))
        left = scratch.table(_moved(left, pointers[0]))
    while not left.isEmpty():
        rank = lambda c, r=len(pointers): F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("n"))
        both = left.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")
        near = both.groupBy("u").agg(F.min(rank("v")).alias("best")).select(F.col("u").alias("v"), F.least(F.col("best"), rank("u")).alias("best"))
        to = both.join(near, "v").groupBy("u").agg(F.min("best")["n"].alias("to"))
        to = scratch.table(to)
        pointers.append(to)
        left = scratch.table(_moved(left, to))
    found = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for to in pointers:
        found = found.join(to.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = cut(found)
    scratch.drop()
    least = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return join_groups(found, least, "root", "size").select("node", "component")
