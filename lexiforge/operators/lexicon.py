"""Building an alias table: union of sources, normal form, conflicts, denylist, frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal
from .windows import first_of, top_k


def alias_table(sources: DataFrame, denied: DataFrame, frequencies: DataFrame, least_letters: int = 3) -> DataFrame:
    """(pref, alias_norm, kind, source, freq, keep, reason) from (pref, alias, kind, source, rank).

    In order: normalise, keep the first of each (pref, alias), attach
    frequencies, flag short aliases, flag aliases with several labels, clear the
    flag of the winner of each conflict, flag denied aliases again, sort.
    The denylist comes after the winners: it beats them.
    """
    rows = sources.withColumn("alias_norm", normal(F.col("alias"))).where("alias_norm <> ''")
    rows = first_of(rows, ["pref", "alias_norm"], ["rank", "kind", "source"])
    rows = rows.join(frequencies, "alias_norm", "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    short = F.char_length("alias_norm") < least_letters
    labels = rows.groupBy("alias_norm", "pref").count().groupBy("alias_norm").agg(F.count("pref").alias("_labels"))
    rows = rows.join(labels, "alias_norm").withColumn("reason", F.when(F.col("_labels") > 1, "conflict").when(short, "short")).drop("_labels")
    winner = F.row_number().over(W.partitionBy("alias_norm").orderBy(F.col("kind") != "pref", "rank", "pref", "source"))
    rows = rows.withColumn("reason", F.when((F.col("reason") == "conflict") & (winner == 1), None).otherwise(F.col("reason")))
    deny = denied.select(normal(F.col("alias")).alias("alias_norm"), F.lit(True).alias("_denied")).distinct()
    rows = rows.join(deny, "alias_norm", "left").withColumn("reason", F.when(F.col("_denied"), "denylist").otherwise(F.col("reason")))
    return rows.select("pref", "alias_norm", "kind", "source", "freq", F.col("reason").isNull().alias("keep"), F.coalesce("reason", F.lit("")).alias("reason"))


def reviewed(base: DataFrame, reviews: DataFrame, key: str, value: str) -> DataFrame:
    """Values from the latest review where there is one, else from base; `drop` removes the row."""
    latest = first_of(reviews, [key], [F.desc("seq")]).select(key, F.col("decision").alias("_decision"), F.col(value).alias("_value"))
    out = base.join(latest, key, "left").where(F.coalesce(F.col("_decision") != "drop", F.lit(True)))
    return out.withColumn(value, F.coalesce("_value", value)).withColumn("reviewed", F.col("_decision").isNotNull()).drop("_decision", "_value")


def alias_index(aliases: DataFrame, key: str) -> DataFrame:
    """alias, key, keys, words from (key, alias, rank): the key of the smallest rank (ties: the smallest key)."""
    single = aliases.where("alias is not null").groupBy(F.lower("alias").alias("alias"), key).agg(F.min("rank").alias("rank"))
    best = single.groupBy("alias").agg(F.min_by(key, F.struct("rank", key)).alias("key"), F.count(F.lit(1)).alias("keys"))
    return best.withColumn("words", F.size(F.split("alias", " ")).cast("long"))


def glossary_lookup(df: DataFrame, term: str, glossary: DataFrame) -> DataFrame:
    """Rows with the glossary's entry (alias, entry) for their whole term, else for its first word, and which of the two it was."""
    whole, head = glossary.select(F.col("alias").alias("_whole"), F.col("entry").alias("_by_whole")), glossary.select(F.col("alias").alias("_head"), F.col("entry").alias("_by_head"))
    name = F.lower(F.trim(term))
    rows = df.join(whole, name == F.col("_whole"), "left").join(head, F.element_at(F.split(name, " "), 1) == F.col("_head"), "left")
    by = F.when(F.col("_by_whole").isNotNull(), "whole").when(F.col("_by_head").isNotNull(), "head").otherwise("")
    return rows.withColumn("entry", F.coalesce("_by_whole", "_by_head")).withColumn("by", by).drop("_whole", "_head", "_by_whole", "_by_head")


def mined(hits: DataFrame, matrix: DataFrame, text: str, key: str, labels: Sequence[str], least: float, per_text: int) -> DataFrame:
    """Hits (text, key, start, label, form) of the first per_text of each text whose label's score for the key is `least` or more.

    matrix has a row per key and a column per label. As the limit comes before
    the scores, a text whose first hits score too little gives none.
    """
    first = top_k(hits, [text], [F.asc("start"), F.asc("label"), F.asc("form")], per_text, "_place").drop("_place")
    scores = matrix.unpivot([key], list(labels), "label", "score").where(F.col("score") >= least)
    found = first.join(scores, [key, "label"])
    return first_of(found, [text, "label", "form"], [F.asc("start")]).select(text, key, "start", "label", "form", F.col("score").cast("double").alias("score"))
