"""Classification, agreement and span metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal, soft_match, token_f1, tokens, wilson


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("int")), F.lit(0))


def _rate(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def per_class(pairs: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per label over the union of labels; 0 on empty denominators."""
    g = pairs.select(*by, F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("tp"))
    p = pairs.select(*by, F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp"))
    out = g.unionAll(p).groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    out = out.withColumn("precision", _rate(F.col("tp"), F.col("n_pred"))).withColumn("recall", _rate(F.col("tp"), F.col("n_gold")))
    return out.withColumn("f1", _rate(2 * F.col("tp"), F.col("n_gold") + F.col("n_pred")))


def macro_f1(pairs: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the labels that gold has, with accuracy."""
    scores = per_class(pairs, gold, pred, by).where("n_gold > 0")
    mean = scores.groupBy(*by).agg(F.round(F.avg(2 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))), 6).alias("macro_f1"), F.count(F.lit(1)).alias("labels"), _rate(F.sum("tp"), F.sum("n_gold")).alias("accuracy"))
    return mean


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, gold, pred).agg(F.count(F.lit(1)).alias("n"))


def confused_pairs(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Unordered pairs of labels that are taken for each other."""
    low, high = F.least(gold, pred).alias("label_a"), F.greatest(gold, pred).alias("label_b")
    return pairs.where(F.col(gold) != F.col(pred)).groupBy(low, high).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(scored: DataFrame, score: str, positive: Column, thresholds: Sequence[float], key: str, every: str = "ALL") -> DataFrame:
    """Recall, precision and share saved per key and over all, for each threshold, in one pass."""
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    rows = scored.select(key, F.col(score).alias("_s"), positive.alias("_p"), levels)
    kept = F.col("_s") >= F.col("threshold")
    rolled = rows.groupingSets([[F.col("threshold"), F.col(key)], [F.col("threshold")]], "threshold", key).agg(
        F.count(F.lit(1)).alias("n"), _count(kept).alias("kept"), _count(F.col("_p")).alias("positives"), _count(kept & F.col("_p")).alias("hits"), F.grouping(key).alias("_all")
    )
    rolled = rolled.withColumn(key, F.when(F.col("_all") == 1, F.lit(every)).otherwise(F.col(key).cast("string"))).drop("_all")
    return rolled.select("threshold", key, "n", "kept", "hits", _rate(F.col("hits"), F.col("positives")).alias("recall"), _rate(F.col("hits"), F.col("kept")).alias("precision"), _rate(F.col("n") - F.col("kept"), F.col("n")).alias("saved"))


def operating_points(pairs: DataFrame, keep_gold: Column, keep_pred: Column, by: Sequence[str]) -> DataFrame:
    """Recall of keeping, precision of dropping, and accuracy."""
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _count(keep_gold).alias("_g"), _count(keep_gold & keep_pred).alias("_gk"), _count(~keep_pred).alias("_d"), _count(~keep_gold & ~keep_pred).alias("_gd"))
    return out.select(*by, "n", _rate(F.col("_gk"), F.col("_g")).alias("keep_recall"), _rate(F.col("_gd"), F.col("_d")).alias("drop_precision"), _rate(F.col("_gk") + F.col("_gd"), F.col("n")).alias("accuracy"))


def agreement(marks: DataFrame, key: str, label: str, dropped: Column) -> DataFrame:
    """State per key with at least two marks: all_dropped, dropped_split, agree or disagree."""
    out = marks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), _count(dropped).alias("n_dropped"), F.count_distinct(F.when(~dropped, F.col(label))).alias("labels")).where("n >= 2")
    state = F.when(F.col("n_dropped") == F.col("n"), "all_dropped").when(F.col("n_dropped") > 0, "dropped_split").when(F.col("labels") == 1, "agree").otherwise("disagree")
    return out.select(key, "n", state.alias("state"))


def rate_with_interval(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _count(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select(*by, "n", "hits", _rate(F.col("hits"), F.col("n")).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each of some successive filters, counted in one pass."""
    holds, counts = F.lit(True), [F.count(F.lit(1)).alias("all")]
    for name, condition in stages:
        holds = holds & F.coalesce(condition, F.lit(False))
        counts.append(_count(holds).cast("long").alias(name))
    names = ["all", *(n for n, _ in stages)]
    order = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), F.col("stage"))
    return df.agg(*counts).unpivot([], names, "stage", "n").withColumn("place", order)


def span_scores(df: DataFrame, gold: str, pred: str, field: str) -> DataFrame:
    """field, n, n_positive, exact, f1, soft, and those three over rows with an answer alone.

    gold and pred are the texts of the answers' spans, empty or null where there
    is none. The blended figures go up with every rightly empty row, so the
    positive ones show what is found.
    """
    a, b = F.coalesce(F.col(gold), F.lit("")), F.coalesce(F.col(pred), F.lit(""))
    scored = df.select(
        F.col(field).alias("field"),
        (a != "").alias("positive"),
        (normal(a) == normal(b)).cast("double").alias("exact"),
        token_f1(tokens(a), tokens(b)).alias("f1"),
        soft_match(a, b).cast("double").alias("soft"),
    )
    mean = lambda c: F.round(F.avg(c), 6)
    only = lambda c: F.when(F.col("positive"), F.col(c))
    return scored.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("n_positive"),
        *(mean(F.col(c)).alias(c) for c in ("exact", "f1", "soft")), *(mean(only(c)).alias(f"positive_{c}") for c in ("exact", "f1", "soft")),
    )
