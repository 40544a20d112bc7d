"""A book of queries: name -> function, and name -> oracle SQL where SQL can express it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

from ..session import table


#: Folders that queries have written, with their sessions.
_folders: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a temporary one in a local session, else the warehouse.

    It is removed by release(), at the end of kept_tables(), or when the program ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="lexiforge-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/lexiforge/{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in a fresh folder, and read again."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Removes what queries have written (after the first `since` folders): for use once results are stored."""
    while len(_folders) > since:
        spark, path = _folders.pop()
        with suppress(Exception):  # a session that has ended
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def kept_tables():
    """Queries inside keep their tables until the end of the block."""
    since = len(_folders)
    try:
        yield
    finally:
        release(since)


atexit.register(release)


class Tables:
    """The driver's tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a function of Tables under a name."""

        def add(build: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return build

        return add
