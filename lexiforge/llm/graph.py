"""Connected components by alternating star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, joined_by_weight, written

#: Edges (of two numbers) that a single task can take, were they all of one node.
FEW = 1_000_000


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _round_of_few(now: DataFrame) -> DataFrame:
    """One round by windows over a node's edges: few exchanges, for as many edges as one task can take."""
    both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("u", F.min("v").over(W.partitionBy("u")))
    large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    below = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
    small = F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).otherwise(F.struct("u", F.col("m").alias("v")))
    return below.select(small.alias("e")).select("e.u", "e.v").distinct()


def _round_of_many(now: DataFrame, edges: int) -> DataFrame:
    """The same by joins, in which a node with more than a thousandth of all edges is salted."""
    both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "m").alias("m"), "many")
    large = joined_by_weight(both, least, ["u"], "many", 2 * edges, F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    below = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
    apart = joined_by_weight(large, below, ["u"], "many", edges, F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return apart.unionAll(below.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round hangs every neighbour above a node on the node's smallest
    neighbour, then every neighbour below likewise, and writes the edges anew;
    it ends when a round changes nothing. Nodes without an edge to another node
    don't appear; they may be of any type with an order.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(pairs, "edges")
    stamp = _stamp(now)
    for _ in range(rounds):
        if not stamp[0]:
            break
        after = written(_round_of_few(now) if stamp[0] <= FEW else _round_of_many(now, stamp[0]), "edges")
        new_stamp = _stamp(after)
        drop_written(now)
        now = after
        if new_stamp == stamp:
            break
        stamp = new_stamp
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
