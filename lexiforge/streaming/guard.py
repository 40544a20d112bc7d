"""A breaker for streams of results: runs of failures are followed across micro-batches and restarts.

Each micro-batch is worked once and its results are written under its number,
so a batch that is run again replaces what it wrote. Failures at the end of what
has come so far are held back in the state folder (results of batch N are
judged with what batch N - 1 held). They are written when a good row follows, or
by finish(). When `limit` failures stand in a row, what came before the run is
written, the run is not, and the query stops; its offsets stay uncommitted, so a
restart works the same batch again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ServerDown(RuntimeError):
    """So many failures in a row that going on makes no sense."""


class FailureGuard:
    """For writeStream.foreachBatch: work gives results with a null `error` where they are good.

    order names columns that put the results of a batch in a row (unique
    within it). out and state are folders that outlive the query; state belongs
    to one checkpoint.
    """

    def __init__(self, work: Callable[[DataFrame], DataFrame], out: str, state: str, order: Sequence[str], limit: int = 10):
        self.work, self.out, self.state, self.order, self.limit = work, out.rstrip("/"), state.rstrip("/"), list(order), limit

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{self.state}/worked-{number}"
        self.work(batch).write.mode("overwrite").parquet(done)
        new = spark.read.parquet(done)
        held = self._held(spark, number - 1, new)
        every = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        place = F.struct("_new", *self.order)
        failed = F.col("error").isNotNull()
        counts = new.agg(F.count_if(failed), F.max(F.when(~failed, F.struct(F.lit(1).alias("_new"), *self.order)))).first()
        if held.count() + counts[0] >= self.limit and (start := self._run(every, place, failed)) is not None:
            self._write(every.where(place < self._at(every, start)), number)
            raise ServerDown(f"{self.limit} failures in a row")
        if counts[1] is None:
            good, rest = every.limit(0), every
        else:
            good, rest = every.where(place <= self._at(every, counts[1])), every.where(place > self._at(every, counts[1]))
        self._write(good, number)
        rest.drop("_new").write.mode("overwrite").parquet(f"{self.state}/held-{number}")
        _remove(spark, done, f"{self.state}/held-{number - 2}")

    def _held(self, spark: SparkSession, number: int, like: DataFrame) -> DataFrame:
        path = f"{self.state}/held-{number}"
        return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else like.limit(0)

    def _at(self, every: DataFrame, row) -> F.Column:
        """A row of places as a value to compare with."""
        kinds = {f.name: f.dataType for f in every.schema.fields}
        return F.struct(*(F.lit(row[c]).cast(kinds[c]).alias(c) for c in ("_new", *self.order)))

    def _run(self, every: DataFrame, place, failed):
        """The place of the first failure of a run that reaches the limit. Only a batch with that many failures comes here."""
        upto = W.orderBy(place).rowsBetween(W.unboundedPreceding, 0)
        runs = every.select(place.alias("p"), failed.alias("f"), F.sum((~failed).cast("long")).over(upto).alias("run")).where("f")
        long = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first")).where(F.col("n") >= self.limit)
        found = long.agg(F.min("first")).first()[0]
        return found

    def _write(self, rows: DataFrame, number: int) -> None:
        rows.drop("_new").write.mode("overwrite").parquet(f"{self.out}/batch={number}")

    def finish(self, spark: SparkSession) -> None:
        """Writes what is still held back (a run below the limit) once no more batches come."""
        numbers = sorted(int(n.rsplit("-", 1)[1]) for n in _names(spark, self.state) if n.startswith("held-"))
        if numbers:
            path = f"{self.state}/held-{numbers[-1]}"
            held = spark.read.parquet(path)
            held.write.mode("overwrite").parquet(f"{self.out}/batch={numbers[-1]}.5")
            held.limit(0).write.mode("overwrite").parquet(f"{path}.empty")
            _remove(spark, path)
            _rename(spark, f"{path}.empty", path)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    where, files = _path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def _remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where, files = _path(spark, path)
        files.delete(where, True)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    where, files = _path(spark, path)
    files.rename(where, _path(spark, to)[0])


def guarded(stream: DataFrame, guard: FailureGuard, checkpoint: str) -> None:
    """Runs a stream through a guard over all that is there, and writes what is held at its end; raises ServerDown where the guard did."""
    query = stream.writeStream.foreachBatch(guard).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as err:
        if "ServerDown" in str(err):
            raise ServerDown(f"{guard.limit} failures in a row") from err
        raise
    guard.finish(stream.sparkSession)
