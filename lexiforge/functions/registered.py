"""Table and aggregate functions for SQL: registered with a session by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.segmentation import chunk_bounds, sentence_bounds


class Sentences:
    """Sentences of a text: place, bounds in code points, text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (a, b) in enumerate(sentence_bounds(text or "")):
            yield i, a, b, text[a:b]


class Chunks:
    """Overlapping chunks of a text."""

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
        for i, (a, b) in enumerate(chunk_bounds(text or "", most, overlap)):
            yield i, a, b, text[a:b]


SPAN = "ord int, start int, end int, part string"


@F.pandas_udf(DoubleType())
def kappa(a: pd.Series, b: pd.Series, n: pd.Series) -> float:
    """Cohen's kappa from counts of label pairs: rows are at most the square of the labels, so count first."""
    total = n.sum()
    if not total:
        return float("nan")
    agree = n[a == b].sum() / total
    left, right = n.groupby(a).sum() / total, n.groupby(b).sum() / total
    chance = sum(left.get(k, 0) * right.get(k, 0) for k in set(left.index) & set(right.index))
    return 1.0 if chance == 1 else float((agree - chance) / (1 - chance))


def register(spark: SparkSession) -> None:
    """lexi_sentences(text) and lexi_chunks(text, most, overlap) as table functions, lexi_kappa(a, b, n) as an aggregate."""
    spark.udtf.register("lexi_sentences", F.udtf(Sentences, returnType=SPAN))
    spark.udtf.register("lexi_chunks", F.udtf(Chunks, returnType=SPAN))
    spark.udf.register("lexi_kappa", kappa)
