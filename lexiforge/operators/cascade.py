"""Staged inference with early exits, pluggable models, retries and a failure breaker.

A model is a function from a list of texts to a list of JSON strings; it runs
over Arrow batches on the executors. Stages are written between each other, so
that a model is asked once for a row even when a later stage is computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import runs_of

Model = Callable[[Sequence[str]], Sequence[str]]


def complete(df: DataFrame, prompt: Column, model: Model, schema: str, name: str) -> DataFrame:
    """df with the model's parsed answer as a struct; null where it can't be read."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(list(model(prompts.fillna("").tolist())), index=prompts.index, dtype=object)

    return df.withColumn(name, F.from_json(ask(prompt), schema))


def stub(labels: Sequence[str]) -> Model:
    """A deterministic stand-in: the label whose letters a text holds most, first on ties."""

    def answer(prompts: Sequence[str]) -> list[str]:
        import json

        low = [p.lower() for p in prompts]
        return [json.dumps({"label": max(labels, key=lambda k: sum(p.count(c) for c in set(k.lower()))), "is_entity": len(p) % 3 != 0, "is_metaphor": len(p) % 11 == 0, "role": p[:12]}) for p in low]

    return answer


def cascade(rows: DataFrame, text: str, sieve: Column, model: Model, store: Callable[[DataFrame, str], DataFrame], override: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Sieve, entity, frame, roles: each row leaves at the first stage that drops it.

    override (key, is_entity) replaces the entity stage's answer. store writes a
    stage and gives it back. Columns: key, outcome, label, role.
    """
    marked = rows.withColumn("_sieved", ~F.coalesce(sieve, F.lit(False)))
    a = store(complete(marked.where("not _sieved"), F.col(text), model, "is_entity boolean, is_metaphor boolean", "a"), "stage-a")
    if override is not None:
        a = a.join(override.select(key, F.col("is_entity").alias("_known")), key, "left").withColumn("_entity", F.coalesce("_known", "a.is_entity"))
    else:
        a = a.withColumn("_entity", F.col("a.is_entity"))
    reason = F.when(F.col("a.is_metaphor"), "metaphor").when(~F.col("_entity"), "not_entity")
    a = a.withColumn("_reason", reason)
    b = store(complete(a.where("_reason is null").select(*rows.columns), F.col(text), model, "label string", "b"), "stage-b")
    c = complete(b.where("b.label <> 'NONE'"), F.concat_ws(": ", "b.label", text), model, "role string", "c")
    none = F.lit(None).cast("string")
    return (
        marked.where("_sieved").select(key, F.lit("sieved").alias("outcome"), none.alias("label"), none.alias("role"))
        .unionAll(a.where("_reason is not null").select(key, "_reason", none, none))
        .unionAll(b.where("b.label = 'NONE' or b.label is null").select(key, F.lit("no_frame"), "b.label", none))
        .unionAll(c.select(key, F.lit("yielded"), "b.label", "c.role"))
    )


def pending(inputs: DataFrame, done: DataFrame, key: str, retry_errors: bool = True) -> DataFrame:
    """Inputs that no finished row has; rows with an error count as unfinished unless told otherwise."""
    finished = done.where(F.col("error").isNull()) if retry_errors else done
    return inputs.join(finished.select(key), key, "left_anti")


def broken_at(results: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 10) -> DataFrame:
    """Where runs of `limit` failures or more begin within keys (a worker, a batch): first, last, length."""
    return runs_of(results, keys, order, F.col("error").isNotNull()).where(F.col("length") >= limit)


def run_batches(inputs: Iterator[DataFrame], work: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], limit: int = 10) -> int:
    """Works through batches until `limit` of them in a row have nothing but errors; returns how many were written.

    Failed batches are held back: they are written when a good one follows or
    the batches end below the limit, and dropped when the breaker trips.
    """
    held: list[DataFrame] = []
    count = 0
    for batch in inputs:
        out = work(batch)
        held.append(out)
        if not out.where(F.col("error").isNull()).isEmpty():
            for df in held:
                write(df)
            count, held = count + len(held), []
        elif len(held) >= limit:
            raise RuntimeError(f"{limit} batches failed in a row")
    for df in held:
        write(df)
    return count + len(held)


def fit_sieve(train: DataFrame, text: str, keep: str, features: int = 4096, most: int = 50_000):
    """A model of P(drop) of a text: hashed words and logistic regression (in the JVM).

    It learns from labelled rows (keep: boolean), of which a sample by hash of
    about `most` is used where there are more.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    rows = train.where(F.col(keep).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), (~F.col(keep)).cast("double").alias("_drop"))
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    stages = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\p{L}+", gaps=False), HashingTF(numFeatures=features, inputCol="_words", outputCol="_features", binary=True), LogisticRegression(featuresCol="_features", labelCol="_drop", regParam=0.02, elasticNetParam=0.0, maxIter=30, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")]
    return Pipeline(stages=stages).fit(rows)


def drop_scores(model, df: DataFrame, text: str, name: str = "p_drop") -> DataFrame:
    """df with the model's P(drop); 0 for a null text, which is never dropped unseen."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))
    p = F.when(F.col(text).isNotNull(), vector_to_array("_p")[1]).otherwise(0.0)
    return scored.withColumn(name, p).drop("_text", "_words", "_features", "_p", "_y", "_r")


def sieve_sweep(scored: DataFrame, keep: str, thresholds: Sequence[float], name: str = "p_drop") -> DataFrame:
    """threshold, dropped, lost, saved, lost_share: what dropping from each threshold up saves, and the rows to keep it loses."""
    bad = F.col(keep).isNotNull()
    rows = scored.where(bad).select(F.col(name).alias("_p"), F.col(keep).alias("_k"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_k").alias("kept"), *(c for i, t in enumerate(thresholds) for c in (F.count_if(F.col("_p") >= t).alias(f"d{i}"), F.count_if((F.col("_p") >= t) & F.col("_k")).alias(f"l{i}"))))
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"d{i}").alias("dropped"), F.col(f"l{i}").alias("lost")) for i, t in enumerate(thresholds))))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return sums.select("n", "kept", each.alias("x")).select("x.threshold", "x.dropped", "x.lost", share(F.col("x.dropped"), F.col("n")).alias("saved"), share(F.col("x.lost"), F.col("kept")).alias("lost_share"))


def chosen_threshold(sweep: DataFrame, most_lost: float) -> float:
    """The lowest threshold that loses at most that share of the rows to keep; infinity (nothing is dropped) where none does."""
    found = sweep.where(F.col("lost_share") <= most_lost).agg(F.min("threshold")).first()[0]
    return float("inf") if found is None else found
