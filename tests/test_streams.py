"""The failure guard over restarts, observed progress, and archives read in ranges."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import readers, zips
from lexiforge.streaming import guard as U
from lexiforge.streaming import progress as P

SCHEMA = "n int, ok boolean"


def feed(spark, folder, name, rows):
    """One more file of a stream: (number, whether it succeeds)."""
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"n": n, "ok": ok}) for n, ok in rows))


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))


def work(df):
    return df.select("n", F.when(~F.col("ok"), "500").alias("error"))


def outcome(spark, out):
    return {r["n"]: r["error"] for r in spark.read.option("recursiveFileLookup", True).schema("n int, error string").parquet(str(out)).collect()} if out.exists() else {}


def fresh(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", tmp_path / "out", U.FailureGuard(work, str(tmp_path / "out"), str(tmp_path / "state"), ["n"], 10), str(tmp_path / "check")


def test_nine_failures_over_a_restart_are_written(spark, tmp_path):
    into, out, guard, check = fresh(tmp_path)
    feed(spark, into, "a", [(1, True), *((n, False) for n in range(2, 7))])
    query = source(spark, into).writeStream.foreachBatch(guard).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    assert outcome(spark, out) == {1: None}  # five failures are held back
    feed(spark, into, "b", [(n, False) for n in range(7, 11)])
    again = U.FailureGuard(work, guard.out, guard.state, ["n"], 10)  # a new process
    U.guarded(source(spark, into), again, check)
    assert outcome(spark, out) == {1: None} | {n: "500" for n in range(2, 11)}
    feed(spark, into, "c", [(11, False), (12, True)])
    U.guarded(source(spark, into), again, check)
    assert outcome(spark, out) == {1: None, 12: None} | {n: "500" for n in range(2, 12)}
    rows = spark.read.option("recursiveFileLookup", True).schema("n int, error string").parquet(str(out))
    assert rows.count() == 12  # nothing twice


def test_ten_failures_over_a_restart_stop_the_query(spark, tmp_path):
    into, out, guard, check = fresh(tmp_path)
    feed(spark, into, "a", [(1, True), *((n, False) for n in range(2, 7))])
    query = source(spark, into).writeStream.foreachBatch(guard).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    feed(spark, into, "b", [*((n, False) for n in range(7, 12)), (12, True)])
    again = U.FailureGuard(work, guard.out, guard.state, ["n"], 10)
    with pytest.raises(U.ServerDown):
        U.guarded(source(spark, into), again, check)
    assert outcome(spark, out) == {1: None}
    # The server is back: the batch that stopped is worked again, and what was held before it is written with it.
    healed = U.FailureGuard(lambda df: df.select("n", F.lit(None).cast("string").alias("error")), guard.out, guard.state, ["n"], 10)
    U.guarded(source(spark, into), healed, check)
    assert outcome(spark, out) == {1: None} | {n: "500" for n in range(2, 7)} | {n: None for n in range(7, 13)}


def test_what_comes_before_a_long_run_is_written(spark, tmp_path):
    into, out, guard, check = fresh(tmp_path)
    feed(spark, into, "a", [(1, False), (2, True), (3, False), (4, True), *((n, False) for n in range(5, 16)), (16, True)])
    with pytest.raises(U.ServerDown):
        U.guarded(source(spark, into), guard, check)
    assert outcome(spark, out) == {1: "500", 2: None, 3: "500", 4: None}


def test_progress_of_a_batch(spark):
    seen = P.Progress("harvest")
    df = seen.watch(spark.range(1000), F.col("id") % 10 == 0)
    df.write.format("noop").mode("overwrite").save()
    name, batch, rows, errors, rate = seen.row()
    assert (name, batch, rows, errors) == ("harvest", 0, 1000, 100) and rate > 0


def test_progress_of_a_stream(spark, tmp_path):
    into, out, _, check = fresh(tmp_path)
    feed(spark, into, "a", [(1, True), (2, False), (3, True)])
    feed(spark, into, "b", [(4, False)])
    told = P.StreamProgress()
    spark.streams.addListener(told)
    try:
        watched = P.StreamProgress.watch(source(spark, into), ~F.col("ok"))
        query = watched.writeStream.queryName("watched").format("parquet").option("path", str(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        assert told.ended(query) is None
        rows = told.frame(spark).collect()
    finally:
        spark.streams.removeListener(told)
    assert {r["name"] for r in rows} == {"watched"} and [r["batch"] for r in rows] == [0, 1]
    assert sorted((r["rows"], r["errors"]) for r in rows) == [(1, 1), (3, 1)]


def test_archives_are_read_in_ranges(spark, tmp_path):
    texts = {f"d/{i:03}.xml": f"<p>{i} {'é' * 500}</p>" for i in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, text)
        z.writestr("notes.txt", "no")
        z.writestr("d/empty.xml", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.xml", b"\xff\xfe broken")
    df = readers.read_zipped(spark, str(tmp_path / "*.zip"), most=10_000)
    assert df.rdd.getNumPartitions() >= 6
    got = {(r["archive"].rsplit("/", 1)[1], r["member"]): r["text"] for r in df.collect()}
    assert got == {("a.zip", n): t for n, t in texts.items()} | {("a.zip", "d/empty.xml"): "", ("b.zip", "one.xml"): "�� broken"}
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("x.txt", "no")
    assert readers.read_zipped(spark, str(tmp_path / "none.zip")).count() == 0
    ranges = zips.ZipReader([str(tmp_path / "a.zip")], ".xml", 10_000).partitions()
    assert sum(len(r.members) for r in ranges) == 61 and max(len(r.members) for r in ranges) <= 10
