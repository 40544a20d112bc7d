"""Progress of batches and streams: rows, errors and rate, observed while they run."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name under which a stream's numbers are observed.
NAME = "lexiforge_progress"
SCHEMA = "name string, batch long, rows long, errors long, rate double"


def _counts(error: Column) -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("rows"), F.count_if(error).alias("errors")


class Progress:
    """Numbers of one batch job: watch() a DataFrame, run an action on it, then read row().

    The numbers come from the action itself; nothing is read twice.
    """

    def __init__(self, name: str):
        self.name, self._seen, self._began = name, Observation(f"{name}-{time.monotonic_ns()}"), time.monotonic()

    def watch(self, df: DataFrame, error: Column) -> DataFrame:
        self._began = time.monotonic()
        return df.observe(self._seen, *_counts(error))

    def row(self) -> tuple[str, int, int, int, float]:
        """name, batch, rows, errors and rows a second; waits until the action has ended."""
        seen = self._seen.get
        took = max(time.monotonic() - self._began, 1e-9)
        return self.name, 0, seen["rows"], seen["errors"], seen["rows"] / took


class StreamProgress(StreamingQueryListener):
    """Numbers of every micro-batch of the streams that watch() has marked, and whether they ended well."""

    def __init__(self):
        self._rows: list[tuple] = []
        self._ended: dict[str, str | None] = {}
        self._lock = threading.Condition()

    @staticmethod
    def watch(stream: DataFrame, error: Column) -> DataFrame:
        return stream.observe(NAME, *_counts(error))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        now = event.progress
        seen = now.observedMetrics.get(NAME)
        if seen is not None:
            with self._lock:
                self._rows.append((now.name or str(now.id), now.batchId, seen["rows"], seen["errors"], now.processedRowsPerSecond))
                self._lock.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended[str(event.id)] = event.exception
            self._lock.notify_all()

    def ended(self, query, seconds: float = 30) -> str | None:
        """Waits for the news that a query has ended (all its batches are told before) and returns its error, if any."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.id) in self._ended, seconds):
                raise TimeoutError("the query's end was not told")
            return self._ended[str(query.id)]

    def rows(self) -> list[tuple]:
        with self._lock:
            return sorted(self._rows, key=lambda r: r[:2])

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each micro-batch so far."""
        return spark.createDataFrame(self.rows(), SCHEMA)
