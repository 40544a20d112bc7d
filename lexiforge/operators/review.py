"""Review sheets, annotated sentences, and predictions held against simple baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_rows(df: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence | None] | None = None, contains: Mapping[str, str | None] | None = None, least: Mapping[str, object] | None = None, blank: Mapping[str, bool | None] | None = None) -> DataFrame:
    """Rows that meet all conditions; a condition whose value is None is not asked.

    equal: a value; among: one of several; contains: a text, whatever the case;
    least: at least so much; blank: whether the column is null or blank.
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c).isin(*v) for c, v in (among or {}).items() if v is not None]
    tests += [F.lower(F.col(c)).contains(v.lower()) for c, v in (contains or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    tests += [(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") == F.lit(v) for c, v in (blank or {}).items() if v is not None]
    for test in tests:
        df = df.where(test)
    return df


def accepted(df: DataFrame, reviews: DataFrame, key: str, verdict: str, yes: Sequence[str] = ("yes", "y", "accept", "ok")) -> DataFrame:
    """Rows whose key a review accepts (verdicts in lower case)."""
    good = reviews.where(F.lower(F.trim(verdict)).isin(*yes)).select(key).distinct()
    return df.join(good, key, "left_semi")


def sentence_targets(tokens: DataFrame, keys: Sequence[str], place: str, tags: str, tiers: Sequence[Sequence[str]], frames: Sequence[str], none: str = "NONE") -> DataFrame:
    """keys, place, tier, frame: the targets of annotated sentences and the frame of each.

    tags lists a token's tags. Targets are the tokens with a tag of the first
    tier that any token of the sentence has. A target's frame is its own; else
    the sentence's only one; else the first of `frames` that the sentence has.
    """
    own = F.array_intersect(F.array(*map(F.lit, frames)), tags)  # in the order of frames
    level = F.coalesce(*(F.when(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, tier))), i) for i, tier in enumerate(tiers)))
    marked = tokens.withColumn("_level", level).withColumn("_own", own).where(F.col("_level").isNotNull() | (F.size("_own") > 0))
    single = marked.select(*keys, F.explode_outer(F.col("_own")).alias("_f"), "_level")
    rank = F.array_position(F.array(*map(F.lit, frames)), F.col("_f"))
    whole = single.groupBy(*keys).agg(F.min("_level").alias("_best"), F.min_by("_f", F.when(F.col("_f").isNotNull(), rank)).alias("_sentence"))
    picked = marked.join(whole, list(keys)).where(F.col("_level") == F.col("_best"))
    # One frame in the sentence is also the first of those it has.
    return picked.select(*keys, place, F.col("_level").alias("tier"), F.coalesce(F.try_element_at("_own", F.lit(1)), "_sentence", F.lit(none)).alias("frame"))


def against_baselines(df: DataFrame, gold: str, pred: str, candidates: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows, accuracy, how often gold is among the candidates, how often it is the first, the share of the most
    frequent gold value, the chance of a candidate drawn at random, and the lead of the accuracy over the best of these baselines."""
    listed = F.coalesce(F.col(candidates), F.array().cast("array<string>"))
    inside = F.array_contains(listed, F.col(gold))
    first = F.coalesce(F.try_element_at(listed, F.lit(1)) == F.col(gold), F.lit(False))
    chance = F.when(inside, 1.0 / F.size(F.array_distinct(listed))).otherwise(0.0)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    main = df.where(F.col(gold).isNotNull()).groupBy(*by, gold).count().groupBy(*by).agg(F.max("count").alias("_most"))
    sums = df.where(F.col(gold).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col(pred) == F.col(gold)).alias("accuracy"), share(inside).alias("reachable"), share(first).alias("first_candidate"), F.avg(chance).alias("chance"))
    both = sums.join(main, list(by)) if by else sums.crossJoin(main)  # one row each
    out = both.withColumn("majority", F.col("_most") / F.col("n"))
    lead = F.col("accuracy") - F.greatest("first_candidate", "majority", "chance")
    return out.select(*by, "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "reachable", "first_candidate", "chance", "majority")), F.round(lead, 6).alias("lead"))
