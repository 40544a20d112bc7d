"""Event streams: deduplication that resumes, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as a stream, in the batch table's schema; `ts` as an instant (UTC sessions)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads folders
        stream = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    else:
        stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, span: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts and sums per window and keys."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, span), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n", "total")


def drained(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet files; a second call with the same checkpoint goes on from there."""
    if mode == "append":
        result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.parquet(out)


def deduplicated_into(stream: DataFrame, key: str, out: str, checkpoint: str) -> DataFrame:
    """Each key once for ever: every micro-batch adds the keys that no earlier one has written; no state grows in the stream.

    A batch that is run again replaces what it wrote. Keys are not null.
    """
    schema = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([key])
        where = spark._jvm.org.apache.hadoop.fs.Path(out)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            before = spark.read.option("basePath", out).parquet(out).where(F.col("batch") < number)
            new = new.join(before.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).option("basePath", out).parquet(out)
