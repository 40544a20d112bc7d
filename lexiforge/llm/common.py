"""Shared helpers: tables, the shared work folder, written intermediates and text columns."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A key that holds more than one of so many rows is salted in joined_by_weight(): fewer keys than this can be.
HEAVY, HEAVY_SALTS = 1000, 64


class _Scopes(threading.local):
    """What the open scopes of a thread have written, innermost last: functions that remove it."""

    def __init__(self):
        self.open: list[list] = [[]]


_scopes = _Scopes()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a local session (as in tests) makes a temporary folder
    and a cluster uses the warehouse.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not context.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiforge-"))
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the executions inside go when each of them ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def scope():
    """Tables written inside go at the end, but for those written with keep=True."""
    made: list = []
    _scopes.open.append(made)
    try:
        yield
    finally:
        _scopes.open[:] = [m for m in _scopes.open if m is not made]
        for remove in made:
            remove()


def release() -> None:
    """Removes all tables that operators have written so far in this thread: for use once their results are stored."""
    for made in _scopes.open:
        while made:
            made.pop()()


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # a session that has ended
        release()


def on_release(remove) -> None:
    """Calls remove when the innermost open scope ends, or at release()."""
    _scopes.open[-1].append(remove)


def written(df: DataFrame, name: str, keep: bool = False, level: int = 3, block: int = 128 << 20) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.block.size", str(block)).parquet(path)
    schema = df.schema
    out = spark.read.schema(schema).parquet(path)
    out._lexiforge_path = path
    _scopes.open[-2 if keep and len(_scopes.open) > 1 else -1].append(lambda: drop_path(spark, path))
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    drop_path(df.sparkSession, df._lexiforge_path)


def joined_by_weight(rows: DataFrame, found: DataFrame, key: Sequence[str], weight: str, total: int, spread: Column, how: str = "inner", least: int = 0, mark: Column | None = None) -> DataFrame:
    """Rows with the row of found (one per key) that their key names; found's other columns follow.

    Rows whose key found lacks go, or with how="left" stay with nulls.

    weight is the number of rows of a key and total that of all. Keys that hold
    over a thousandth of the rows are fewer than a thousand; their hashes come
    to the driver, and their rows are dealt by `spread` (a column of rows) over
    many salts, with found's row repeated for each. So no key brings more than a
    thousandth to one task. Up to `least` rows in all, which one task can hold,
    it is a plain join. mark may name a column that both sides have as the keys'
    hash.
    """
    mark = F.xxhash64(*key) if mark is None else mark
    heavy = [r[0] for r in found.where(F.col(weight) * HEAVY > F.lit(total)).select(mark).distinct().collect()] if total > least else []  # fewer than HEAVY
    if not heavy:
        return rows.join(found, list(key), how)
    hot = F.coalesce(mark.isin(heavy), F.lit(False))
    salted = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(HEAVY_SALTS))).otherwise(F.lit(0).cast("long")))
    each = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(HEAVY_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(found.withColumn("_salt", F.explode(each)), [*key, "_salt"], how).drop("_salt")


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; all-ASCII texts take the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id."""
    return F.crc32(doc_id.cast("string"))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, *more: str, nonzero: bool = False) -> tuple[DataFrame, int]:
    """(rows, length): _id long, _v array<double> and further columns, of rows whose vector can be used.

    Null and empty vectors and those that hold null or non-finite components go,
    with nonzero also zero vectors. Vectors must have one length: that which
    most of them have (of equally many the smaller), 0 for an empty table.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    good = v.isNotNull() & finite
    if nonzero:
        good &= F.exists(v, lambda x: x != 0)
    rows = df.where(good).select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), *(F.col(f"`{c}`") for c in more))
    lengths = rows.select(F.size("_v").alias("n")).where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("many"))
    first = lengths.orderBy(F.desc("many"), "n").first()
    length = first["n"] if first else 0
    return rows.where(F.size("_v") == length), length
