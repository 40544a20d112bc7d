"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Copies are combined three times, each time comparing digest and full content:
within each task (the partial aggregate below the first exchange), per salted
digest group, and over the salt winners. A group that holds a third of all rows
reaches the first exchange as at most one row per task and salt.

The text leaves the plan after the last combine; each document then finds its
group by digest, length and a second hash. Those keys are checked to name one
content each; if any names two, the documents find their group by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, joined_by_weight, written

#: Salts a digest group is split by in the second combine.
SALTS = 8


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after lower-casing A-Z. The row with the
    largest id of a group stays.

    * null text counts as the empty text; empty texts form one group
    * a null id never wins over another; a group of null ids keeps them all
    * rows that repeat one id and text count in group_size and share their fate
    * an empty table gives an empty result; further columns of docs are ignored
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(text).alias("content")).select("doc_id", "content", digest(F.col("content")).alias("digest"))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    combined = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    key = ["digest", "second", "length"]
    second, length = F.xxhash64("content").alias("second"), F.octet_length("content").alias("length")
    sha = F.col("digest") if digest is sha256 else sha256(F.col("content"))
    winners = written(combined.select("digest", second, length, "keep_id", "group_size", *([] if digest is sha256 else [sha.alias("text_sha256")])), "exact-winners")
    if digest is sha256:
        winners = winners.withColumn("text_sha256", F.col("digest"))
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    shared = winners.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if shared.isEmpty():
        found = joined_by_weight(rows.select("doc_id", "digest", second, length), winners, key, "group_size", total, F.col("doc_id"), mark=F.col("second"))
    else:
        found = rows.join(combined.withColumn("text_sha256", sha), ["digest", "content"])
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
