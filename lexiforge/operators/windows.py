"""Ranking, carry-forward and selection within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence, order: Sequence, name: str = "rank") -> DataFrame:
    """Consecutive ranks from 1 within keys; order must settle ties."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: Sequence, order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank (Spark prunes each task to k rows a group first)."""
    return ranked(df, keys, order, name).where(F.col(name) <= k)


def first_of(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row of each group: dedupe that keeps the first in a stated order."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def carried(df: DataFrame, keys: Sequence, order: Sequence, value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def carried_scope(df: DataFrame, keys: Sequence, order: Sequence, value: Column, divider: Column, name: str) -> DataFrame:
    """As carried, but a divider row forgets what came before it."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = df.withColumn("_part", F.sum(divider.cast("int")).over(upto))
    return carried(cut, [*keys, "_part"], order, value, name).drop("_part")


def span_end(df: DataFrame, keys: Sequence, order: Sequence, start: Column, last: Column, name: str = "end") -> DataFrame:
    """A unit ends where the next one starts, the last one at `last`."""
    return df.withColumn(name, F.coalesce(F.lead(start).over(W.partitionBy(*keys).orderBy(*order)), last))


def best_per_bin(df: DataFrame, keys: Sequence, offset: Column, length: Column, bins: int, order: Sequence) -> DataFrame:
    """The best row of each of `bins` equal position bins."""
    binned = df.withColumn("bin", F.least(F.lit(bins - 1), F.floor(offset * bins / length)).cast("int"))
    return first_of(binned, [*keys, "bin"], order)


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, name: str, total: str | None = None) -> DataFrame:
    """Numbers from 0 within keys (and the keys' totals), without a task that holds a whole key.

    bucket must not fall along the order, and never be null: rows are numbered
    within it, and each bucket begins where the counts of those before it end.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_total", F.sum("_size").over(W.partitionBy(*keys))).drop("_size")
    starts = starts.select(F.struct(*keys, "_bucket").alias("_at"), "_start", "_total")
    within = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    joined = rows.withColumn("_within", within).join(starts, F.struct(*keys, "_bucket").eqNullSafe(F.col("_at")))
    out = joined.withColumn(name, F.col("_start") + F.col("_within"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_bucket", "_within", "_at", "_start", "_total")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence, cap: int, bucket: Column | None = None) -> DataFrame:
    """cap evenly spaced rows of each group, all of them where there are no more; a bucket that follows the order splits large groups."""
    at = numbered(df, keys, F.lit(0) if bucket is None else bucket, order, "_i", "_n")
    step = lambda i: F.floor((i * cap + F.col("_n") - 1) / F.col("_n"))
    return at.where((F.col("_n") <= cap) | (step(F.col("_i") + 1) > step(F.col("_i")))).drop("_i", "_n")


def round_robin(df: DataFrame, bucket: Sequence, order: Sequence, limit: int, bucket_order: Sequence) -> DataFrame:
    """The k-th row of every bucket in turn, up to limit rows; no bucket can give more than that."""
    return top_k(df, bucket, order, limit, "turn").orderBy("turn", *bucket_order).limit(limit)


def runs_of(df: DataFrame, keys: Sequence, order: Sequence, flag: Column) -> DataFrame:
    """Lengths of uninterrupted runs of rows where flag holds: keys, run, length, first and last place."""
    window = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(window)).withColumn("_flag", flag)
    gaps = numbered.where("_flag").withColumn("_run", F.col("_i") - F.row_number().over(W.partitionBy(*keys).orderBy("_i")))
    return gaps.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("length"), F.min("_i").alias("first"), F.max("_i").alias("last")).drop("_run")


def canonical_winner(df: DataFrame, key: str, label: str, order: Sequence) -> DataFrame:
    """For keys with several labels: the winning row of each, and the number of labels."""
    several = df.where(F.col(label).isNotNull()).groupBy(key, label).count().groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_labels")).where("n_labels > 1")
    return first_of(df.join(several, key), [key], order)


def ratio_guard(df: DataFrame, key: str, count: str, ratio: float, name: str = "final_key", own: str = "form") -> DataFrame:
    """Members far below their group's largest count keep a key of their own."""
    return df.withColumn(name, F.when(F.col(count) < ratio * F.max(count).over(W.partitionBy(key)), F.col(own)).otherwise(F.col(key)))
