"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends the tree: at each level every child draws ln(u) / weight, with u
from a hash of the row's id and the child's name, and the largest draw wins, so
children win in proportion to their weight. When weights below one child change,
rows move into or out of that child's subtree only; all draws elsewhere stay.
A shard that is added as a region of its own takes rows only into itself, and
that is how a tree grows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2
#: Buckets that number the rows of a shard independently of each other.
SLOT_BUCKETS = 512


def shard_tree(n_shards: int, weights: Mapping[int, float] | None = None) -> dict:
    """{region: {rack: {shard: weight}}}: racks of 4 shards, regions of 2 racks."""
    tree: dict = {}
    for shard in range(n_shards):
        rack = shard // SHARDS_PER_RACK
        tree.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[shard] = float((weights or {}).get(shard, 1.0))
    return tree


def grown(tree: dict, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a rack and a region of its own: no other draw changes."""
    racks = [k for region in tree.values() for k in region]
    shards = [s for region in tree.values() for rack in region.values() for s in rack]
    return {**tree, max(tree, default=-1) + 1: {max(racks, default=-1) + 1: {max(shards, default=-1) + 1: float(weight)}}}


def _total(node) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else node


def _choose(key: Column, level: int, children: dict) -> Column:
    """The child with the largest weighted draw."""
    draws = []
    for name, node in children.items():
        if (weight := _total(node)) > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 11)
            draws.append(F.struct((F.log((bits + 1) / F.lit(float(1 << 53))) / F.lit(weight)).alias("draw"), F.lit(name).alias("name")))
    if not draws:
        raise ValueError("a tree needs a positive weight")
    return (F.array_max(F.array(*draws)) if len(draws) > 1 else draws[0])["name"]


def shard_of(key: Column, tree: dict) -> Column:
    """The shard of a key: region, then rack, then shard."""
    region = _choose(key, 0, tree)
    out = None
    for r, racks in tree.items():
        if _total(racks) <= 0:
            continue
        rack, inner = _choose(key, 1, racks), None
        for k, shards in racks.items():
            if _total(shards) <= 0:
                continue
            leaf = _choose(key, 2, shards)
            inner = F.when(rack == k, leaf) if inner is None else inner.when(rack == k, leaf)
        out = F.when(region == r, inner) if out is None else out.when(region == r, inner)
    return out.cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = SLOT_BUCKETS, tree: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of docs.

    The law is `key`: the id and the tree alone decide; the tree is that of
    n_shards and weights, or the one given (such as a grown one). grown_shard is
    the shard after the tree has grown by one, which takes rows only into the
    new shard whatever the number of shards. Slots number the rows of a shard
    from 0 without gaps: equal rows are counted, those counts are added up
    within hash buckets of a shard, and each bucket starts where the ones before
    it end, so no task holds a whole shard.

    * a null text has size 8 and crc32 0; an empty text likewise
    * a null id is a key like any other; rows that repeat an id share a shard and have slots of their own
    * ids are hashed as text: the type of a whole number makes no difference
    * an empty table gives an empty result; further columns of docs are ignored
    """
    key, tree = F.col("doc_id").cast("string"), tree or shard_tree(n_shards, weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times"))
    placed = equal.select(
        "*",
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64(key, "size", "text_crc32", F.lit("slot")), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    sums = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = F.sum("times").over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0))
    numbered = placed.withColumn("upto", upto).join(starts, ["shard", "bucket"])
    slot = F.explode(F.sequence(F.col("start") + F.col("upto") - F.col("times"), F.col("start") + F.col("upto") - 1)).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
