"""Unions, dedupes and keyed merges with stated precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import tag_union
from .windows import first_of


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All rows with the name of their source; columns that a source lacks are null."""
    out = None
    for name, df in parts:
        tagged = df.withColumn("source_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def collapse_duplicates(df: DataFrame, keys: Sequence[str], first: Sequence[str], order: Column, tags: Column) -> tuple[DataFrame, DataFrame]:
    """One row per key (first columns in order, union of tags), and a report of duplicate keys."""
    grouped = df.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in first), F.count(F.lit(1)).alias("n"))
    union = tag_union(df, keys, tags).select("tags", F.struct(*keys).alias("_key"))
    return grouped.drop("n").join(union, F.struct(*keys).eqNullSafe(F.col("_key"))).drop("_key"), grouped.where("n > 1").select(*keys, "n")


def append_unseen(base: DataFrame, more: DataFrame, key: Sequence[str], order: Sequence | None = None, limit: int | None = None) -> DataFrame:
    """Base rows and those of more whose key base lacks; a limit counts before that test."""
    if limit is not None:
        more = more.orderBy(*order).limit(limit)
    return base.unionByName(more.join(base.select(*key), list(key), "left_anti").select(*base.columns))


def upsert_locked(base: DataFrame, update: DataFrame, key: str, columns: Sequence[str], locked: Column, overwrite: bool = False) -> DataFrame:
    """Updates replace base rows unless locked; rows that base lacks are appended."""
    old = base.select(F.col(key), *(F.col(c).alias(f"_old_{c}") for c in columns), locked.alias("_locked"))
    new = update.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_new"))
    both = old.join(new, key, "full_outer")
    take_new = F.col("_new").isNotNull() & (F.lit(overwrite) | ~F.coalesce("_locked", F.lit(False)))
    return both.select(key, *(F.when(take_new, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in columns), F.when(F.col("_locked").isNull(), "added").when(take_new, "updated").otherwise("kept").alias("action"))


def promoted(df: DataFrame, key: str, annotator: str, label: str, dropped: Column, fields: Sequence[str]) -> DataFrame:
    """Keys on which at least two annotators agree; fields that differ are blanked.

    Whether values differ is told by their least and greatest: distinct counts
    would take each row once for each of them.
    """
    grouped = df.where(~dropped).groupBy(key).agg(
        (F.min(annotator) < F.max(annotator)).alias("_several"), (F.min(label) == F.max(label)).alias("_one"), F.min(label).alias(label),
        *(F.when(F.min(f) == F.max(f), F.min(f)).otherwise("").alias(f) for f in fields),
        F.array_join(F.array_sort(F.collect_set(F.col(annotator).cast("string"))), "+").alias("who"),
    )
    return grouped.where("_several and _one").drop("_several", "_one")


def in_all_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values that occur in every group."""
    groups = df.agg(F.count_distinct(group).alias("groups"))
    return df.groupBy(value).agg(F.count_distinct(group).alias("n")).join(F.broadcast(groups)).where("n = groups").select(value)  # one row


def prefer_first(parts: Sequence[DataFrame], key: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the first part that has it wins, then the order."""
    out = None
    for rank, df in enumerate(parts):
        df = df.withColumn("_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return first_of(out, key, ["_rank", *order]).drop("_rank")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Key and state (new, changed, same, gone) by a digest of the columns."""
    digest = lambda: F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    both = old.select(key, digest().alias("_old")).join(new.select(key, digest().alias("_new")), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "same").otherwise("changed").alias("state"))
