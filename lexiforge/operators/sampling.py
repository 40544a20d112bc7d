"""Reproducible samples, quotas and splits: the order is a hash of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import top_k


def hash_sample(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    return df.orderBy(order, key).limit(n)


def per_key_cap(df: DataFrame, keys: Sequence[str], order: Sequence, cap: int) -> DataFrame:
    return top_k(df, keys, order, cap, "_cap").drop("_cap")


def rotating_sample(df: DataFrame, key: str, order: Column, id_col: str, key_order: Column, per_key: int, n: int) -> DataFrame:
    """At most per_key rows of each key, drawn in rounds over the keys, n in all."""
    turns = top_k(df, [key], [order, F.col(id_col)], per_key, "turn")
    return turns.orderBy("turn", key_order, id_col).limit(n)


def quota_sample(df: DataFrame, stratum: str, quotas: DataFrame, order: Sequence) -> DataFrame:
    """Up to `quota` rows of each stratum; quotas (stratum, quota) is a small table.

    The largest quota bounds what any task hands on of a stratum.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    rows = top_k(df.join(F.broadcast(quotas), stratum), [stratum], order, most, "_rank")  # quotas: one row per stratum, a parameter
    return rows.where("_rank <= quota").drop("_rank", "quota")


def pinned_buckets(df: DataFrame, bucket: str, pinned: Column, order: Sequence, k: int) -> DataFrame:
    """Pinned rows of every bucket, filled up to k with others; the pool's size beside them."""
    rows = df.withColumn("pinned", F.coalesce(pinned, F.lit(False)))
    pools = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("pool"), F.sum(F.col("pinned").cast("int")).alias("_pins"))
    others = top_k(rows.where(~F.col("pinned")), [bucket], order, k, "_rank")
    chosen = rows.where("pinned").withColumn("_rank", F.lit(0)).unionByName(others)
    return chosen.join(pools, bucket).where(f"pinned or _rank <= {k} - _pins").drop("_rank", "_pins")


def group_split(df: DataFrame, group: str, order: Column, share: float) -> DataFrame:
    """Whole groups go to dev by a threshold of their hash, so no group is split."""
    return df.withColumn("split", F.when(order < int(share * (1 << 32)), "dev").otherwise("train"))


def stratified_split(df: DataFrame, stratum: str, order: Sequence, dev: int, excluded: Column) -> DataFrame:
    """dev rows of each stratum; excluded rows are never among them.

    order must settle ties: the last of a stratum's dev rows is the threshold
    that all its rows are held against.
    """
    place = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    rows = df.withColumn("_out", F.coalesce(excluded, F.lit(False))).withColumn("_place", place)
    last = top_k(rows.where(~F.col("_out")).select(stratum, "_place"), [stratum], ["_place"], dev, "_rank").groupBy(stratum).agg(F.max("_place").alias("_last"))
    marked = rows.join(last.withColumnRenamed(stratum, "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    inside = F.coalesce(~F.col("_out") & (F.col("_place") <= F.col("_last")), F.lit(False))
    return marked.withColumn("split", F.when(inside, "dev").otherwise("train")).drop("_out", "_place", "_last", "_stratum")


def folds(df: DataFrame, order: Column, k: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(order, F.lit(k)).cast("int"))


def oversample(df: DataFrame, rare: Column, factor: int) -> DataFrame:
    """Rows of the rare class factor times, numbered."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(rare, factor).otherwise(1))))


def first_by_hash(df: DataFrame, order: Column, ties: Sequence, n: int, bits: int = 16) -> DataFrame:
    """The first n rows by a 32-bit hash, ties by further columns.

    Rows are counted by the hash's upper bits; only the bucket in which the n-th
    row lies is sorted, so no task holds more than that bucket.
    """
    rows = df.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 32 - bits))
    upto = F.sum("n").over(W.orderBy("_bucket"))  # one row per bucket
    ends = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto).where(F.col("upto") >= n).orderBy("_bucket").limit(1).collect()
    if ends:
        left = n - (ends[0]["upto"] - ends[0]["n"])
        last = rows.where(F.col("_bucket") == ends[0]["_bucket"]).orderBy("_order", *ties).limit(left)
        rows = rows.where(F.col("_bucket") < ends[0]["_bucket"]).unionByName(last)
    return rows.drop("_order", "_bucket")


def balanced_negatives(df: DataFrame, positive: Column, cap_keys: Sequence[str], order: Column, ties: Sequence, cap: int) -> DataFrame:
    """All positives, and at most as many negatives, capped per key, by a 32-bit hash."""
    marked = df.withColumn("_positive", F.coalesce(positive, F.lit(False)))
    positives = marked.where("_positive").drop("_positive")
    negatives = top_k(marked.where(~F.col("_positive")), cap_keys, [order, *ties], cap, "_cap").select(*df.columns)
    return positives.unionByName(first_by_hash(negatives, order, ties, positives.count()))


def mode_union(df: DataFrame, modes: Sequence[tuple[str, Sequence]], n: int) -> DataFrame:
    """Rows among the first n by any ranking, with the names of those rankings."""
    tops = None
    for name, order in modes:
        part = df.orderBy(*order).limit(n).withColumn("_mode", F.lit(name))
        tops = part if tops is None else tops.unionByName(part)
    return tops.groupBy(*df.columns).agg(F.array_join(F.array_sort(F.collect_list("_mode")), "|").alias("modes"))


def series_pick(df: DataFrame, series: Column, order: Sequence, stratum: str, quota: int) -> DataFrame:
    """One row of each series, then the first quota of each stratum; quotas nest."""
    single = top_k(df.withColumn("series", series), ["series"], order, 1, "_one").drop("_one")
    return top_k(single, [stratum], order, quota, "place")


def coupled_quota(df: DataFrame, id_col: str, stratum: str, quotas: dict, target: str, cap: int, order: Sequence) -> DataFrame:
    """Quotas per stratum and a cap per target over all strata, filled in order of the strata.

    The greedy choice needs few rows: at most cap of a target in a stratum, and
    of those as many as all quotas could block. Only these (quota + cap * total
    per stratum, a bound by parameters) are decided on the driver.
    """
    total = sum(quotas.values())
    some = top_k(df.where(F.col(stratum).isin(*quotas)), [stratum, target], order, cap, "_c").drop("_c")
    most = max(quotas.values(), default=0) + cap * total
    rows = top_k(some, [stratum], order, most, "_place").select(id_col, stratum, target, "_place").collect()
    used: dict = {}
    chosen = []
    for name, quota in quotas.items():
        left = quota
        for r in sorted((r for r in rows if r[stratum] == name), key=lambda r: r["_place"]):
            if left and used.get(r[target], 0) < cap:
                used[r[target]] = used.get(r[target], 0) + 1
                chosen.append((r[id_col],))
                left -= 1
    ids = df.sparkSession.createDataFrame(chosen, df.select(id_col).schema)
    return df.join(F.broadcast(ids), id_col, "left_semi")  # at most the sum of the quotas
