"""A cleaning pipeline over `documents`: language, copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes
as Parquet and reads again as the next stage's docs. All stages but the last
return the columns of documents; rows are whole documents. Further columns of
docs, whatever their names, come along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.bpe import encode_decode
from lexiforge.llm.common import documents, drop_written, fold_ascii, scope, text_of, written
from lexiforge.llm.exact_dedup import exact_dedup, sha256
from lexiforge.llm.language_id import keep_languages
from lexiforge.llm.ngram_join import jaccard_components
from lexiforge.llm.queries import vocabulary
from lexiforge.llm.source_mix import mix_sources

#: Near copies: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: The stages' decisions depend on learned models, a flow and a tokenizer: no SQL.
ORACLE_SQL = None


def _id_key(doc_id: Column) -> Column:
    """A key that is never null and differs between ids."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")).alias("id_key")


def _packed(docs: DataFrame, text_key: Column) -> DataFrame:
    """Each row as one struct beside its keys, so that no column's name can clash."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, _id_key(F.col("doc_id")), text_key.alias("text_key"))


def _keys(found: DataFrame, text_key: str) -> DataFrame:
    return found.select(_id_key(F.col("doc_id")), F.col(text_key).alias("text_key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, or surely isn't the one they are labelled with, go.

    The first are null texts and texts without letters. A document without a
    label takes the predicted language. Null ids, repeated rows and very long
    texts are judged like all others.
    """
    return keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty), the document with the largest doc_id stays, once.

    Of rows that repeat an id and text one stays; an id with different texts is
    judged text by text. A null id stays only where no equal text has an id.
    """
    kept = _keys(exact_dedup(docs).where("kept"), "text_sha256").distinct()
    rows = _packed(docs, sha256(fold_ascii(text_of())))
    single = rows.groupBy("id_key", "text_key").agg(F.min_by("row", F.col("row.text")).alias("row"))
    return single.join(kept, ["id_key", "text_key"], "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.

    Documents without words are in no group and stay. Rows that repeat an id are
    one document and share its fate. Null ids stay unless their group has an id.
    """
    found = jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT, with_key=True)
    kept = _keys(found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))), "text_key").distinct()
    return _packed(docs, F.xxhash64(text_of())).join(kept, ["id_key", "text_key"], "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (up to three); documents without words are not taken.

    A null source is a source of its own. Rows that repeat an id and text, and
    null ids of one text, are each taken as often as the most taken of them.
    """
    taken, _ = mix_sources(docs, F.array("source"))
    copies = taken.where("copies > 0").select(_id_key(F.col("doc_id")), "text_key", "copies").groupBy("id_key", "text_key").agg(F.max("copies").alias("copies"))
    joined = _packed(docs, F.xxhash64(text_of())).join(copies, ["id_key", "text_key"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded text; null text has none."""
    return encode_decode(docs, vocabulary(), keep=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, and what it read and wrote before goes."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
