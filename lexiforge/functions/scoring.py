"""Scores from tables of rules: points and reasons for patterns at places, tiers, the best row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import first_of
from .text import ladder


@dataclass(frozen=True)
class Points:
    """So many points where a pattern stands at a place (a name of one of the score's columns).

    With `each` they count for every occurrence, with `absent` where there is none.
    """

    reason: str
    points: int
    place: str
    pattern: str
    each: bool = False
    absent: bool = False


def _hits(rule: Points, places: Mapping[str, Column]) -> Column:
    where = F.coalesce(places[rule.place], F.lit(""))
    if rule.each:
        return F.regexp_count(where, F.lit(rule.pattern))
    found = where.rlike(rule.pattern)
    return (~found if rule.absent else found).cast("int")


def score(rules: Sequence[Points], places: Mapping[str, Column]) -> tuple[Column, Column]:
    """The sum of the points, and the reasons in the order of the rules."""
    total = sum((_hits(r, places) * r.points for r in rules), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(_hits(r, places) > 0, F.lit(r.reason)) for r in rules)))
    return total, reasons


def scored(df: DataFrame, rules: Sequence[Points], places: Mapping[str, Column], tiers: Sequence[tuple[str, int, Sequence[str]]], lowest: str = "low") -> DataFrame:
    """df with score, reasons and tier: the first of (tier, least score, reasons that rule it out) that holds."""
    total, reasons = score(rules, places)
    out = df.withColumn("score", total).withColumn("reasons", reasons)
    barred = lambda names: F.arrays_overlap("reasons", F.array(*map(F.lit, names))) if names else F.lit(False)
    return out.withColumn("tier", ladder([((F.col("score") >= least) & ~barred(names), F.lit(tier)) for tier, least, names in tiers], F.lit(lowest)))


def best_scored(df: DataFrame, keys: Sequence[str], order: Sequence, skip: Sequence[str] = ("low",)) -> DataFrame:
    """Per key the row of the highest score; a later row must have strictly more to win. Rows of the tiers in skip don't take part."""
    return first_of(df.where(~F.col("tier").isin(*skip)), keys, [F.desc("score"), *order])


def review_tier(hits: Column, joint: Column, class_ok: Column) -> Column:
    """Grade of a row whose fields were held against a reference: all, several, one in the right class, class alone, nothing."""
    return ladder([(joint, F.lit("joint")), (hits >= 2, F.lit("partial_strong")), ((hits == 1) & class_ok, F.lit("partial")), (class_ok & (hits == 0), F.lit("frame_ok_zero"))], F.lit("miss"))


def few_shot(tier: Column, gold: Column, maybe: str) -> Column:
    """Whether a row is fit as an example: yes for the upper tiers, maybe for a partial hit of one class, else blank."""
    return ladder([(tier.isin("joint", "partial_strong"), F.lit("yes")), ((tier == "partial") & (gold == maybe), F.lit("maybe"))], F.lit(""))
