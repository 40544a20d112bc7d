"""Substring deduplication with a log-structured index of window fingerprints.

A window is a run of `size` words. Every window has an anchor, the shorter run
of words inside it with the smallest hash, and neighbouring windows mostly
share theirs; so consecutive windows with one anchor make one passage, about a
seventh as many rows as windows. Equal windows have equal anchors at equal
places, hence nothing is lost by looking anchors up first.

The index is a list of immutable runs: tables bucketed and sorted by anchor
hash. A new batch becomes a run of its own; its anchors are merge-joined with
those of the earlier runs, bucket by bucket without moving the runs, and only
anchors that occur twice go on. These candidates are verified by content: their
texts are fetched, and digests of the very words decide. Passages that are
equal as a whole repeat each other; where an anchor stands in different
passages, their windows are compared one by one. Later the runs are compacted
into one.

Passages that repeat within a slice of rows are settled there, so a passage
that stands in every document enters the index once per slice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, freed_shuffles, joined_by_weight, on_release, scope, work_path, written
from .words import Runs, Words, slices, text_buffers

#: Words of an anchor.
ANCHOR = 8
#: Runs an index holds before they are compacted.
MAX_RUNS = 4
SEGMENTS = "h long, r long, doc_id long, start int, windows int, text_key long, again boolean"
RUNS = "digest binary, doc_id long, text_key long, start int, words int, fresh boolean"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each `width` neighbouring values."""
    place, have = np.arange(len(values)), 1
    low = values
    while have < width:
        step = min(have, width - have)
        left = low[:-step] <= low[step:]
        place = np.where(left, place[:-step], place[step:])
        low = np.where(left, low[:-step], low[step:])
        have += step
    return place


def passages(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start, windows, anchor hash, passage hash) of all texts."""
    n = words.n
    if n < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    doc = words.docs()
    grams = Runs(words.hashes(1), 1).of(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    anchor = _smallest(grams, size - ANCHOR + 1)
    starts = np.arange(n - size + 1)
    starts = starts[doc[starts] == doc[starts + size - 1]]
    at = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, where = starts[first], at[first]
    whole = Runs(words.hashes(2), 2).of(begin, begin + count + size - 1)
    whole ^= (where - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    text = doc[begin] if len(begin) else np.zeros(0, np.int64)
    return text, begin - words.first[text], count, grams[where], whole


def same_words(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from a on equal those from b on, by their kinds."""
    out = np.ones(len(a), bool)
    upto = np.cumsum(n)
    for part in np.split(np.arange(len(a)), np.searchsorted(upto, np.arange(1 << 20, upto[-1] if len(upto) else 0, 1 << 20))):
        if len(part):
            row = np.repeat(part, n[part])
            within = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            out[row[kind[a[row] + within] != kind[b[row] + within]]] = False
    return out


def segments(docs: DataFrame, size: int) -> DataFrame:
    """Passages of rows (doc_id, text_key, text). again: the same words stand as a passage earlier in the same slice of rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = Words(*text_buffers(batch.column("text")))
                text, start, count, h, r = passages(words, size)
                ids = batch.column("doc_id").to_numpy()[text]
                order = np.lexsort((start, ids, count, r, h))
                text, start, count, h, r, ids = (x[order] for x in (text, start, count, h, r, ids))
                lead = np.ones(len(h), bool)
                lead[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (count[1:] != count[:-1])
                best = np.flatnonzero(lead)[np.cumsum(lead) - 1]
                again = (ids != ids[best]) | (start != start[best])
                if again.any():
                    these, at = np.flatnonzero(again), words.first[text] + start
                    again[these] = same_words(words.distinct()[1], at[these], at[best[these]], count[these] + size - 1)
                keys = batch.column("text_key").to_numpy()[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(keys), pa.array(again)],
                    names=["h", "r", "doc_id", "start", "windows", "text_key", "again"],
                )

    return docs.select("doc_id", "text_key", "text").mapInArrow(cut, SEGMENTS)


def run_digests(rows: DataFrame, size: int) -> DataFrame:
    """Digests of runs of words: rows (doc_id, text_key, text, heads, fresh) give those that heads name.

    heads: array of (start, windows, single); each is one run, and where it is
    single also a run for each of its windows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = Words(*text_buffers(batch.column("text")))
                heads = batch.column("heads")
                row = np.repeat(np.arange(batch.num_rows), np.diff(heads.offsets.to_numpy()))
                flat = heads.flatten()
                start, count = flat.field("start").to_numpy().astype(np.int64), flat.field("windows").to_numpy().astype(np.int64)
                many = np.where(flat.field("single").to_numpy(zero_copy_only=False).astype(bool) & (count > 1), count, 0)
                owner = np.repeat(row, many)
                each = np.repeat(start, many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                row, start = np.concatenate([row, owner]), np.concatenate([start, each])
                length = np.concatenate([count + size - 1, np.full(len(owner), size)])
                fit = words.first[row] + start + length <= words.first[row + 1]  # a repeated id may bring another text
                row, start, length = row[fit], start[fit], length[fit]
                place = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
                first = words.first[row] + start
                begin, end = place[first] - place[words.first[row]], place[first + length] - place[words.first[row]] - 1
                texts = words.sequences()
                found = [hashlib.blake2b(texts[t][a:b], digest_size=16).digest() for t, a, b in zip(row.tolist(), begin.tolist(), end.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), batch.column("fresh").take(take)],
                    names=["digest", "doc_id", "text_key", "start", "words", "fresh"],
                )

    return rows.select("doc_id", "text_key", "text", "heads", "fresh").mapInArrow(digest, RUNS)


class FingerprintIndex:
    """Runs of passages under one folder, each sorted by anchor hash in hash buckets.

    * batches come in the order of their ids: a smaller id is earlier, and no batch has ids below those of one before
    * rows without an id don't belong in a batch (substring_dedup() leaves them out); null and empty texts have no passage
    * rows that repeat an id count as one document: at equal starts none is earlier than the other
    * an empty batch adds an empty run; further columns of a batch are ignored
    """

    def __init__(self, spark: SparkSession, size: int = 20, buckets: int | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.size, self.max_runs = spark, size, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self._paths: dict[str, str] = {}
        on_release(self.close)

    def _write(self, rows: DataFrame) -> str:
        name, path = f"lexiforge_run_{uuid.uuid4().hex}", work_path(self.spark, "run")
        self._paths[name] = path
        with freed_shuffles(self.spark):
            rows.repartition(self.buckets, "h").sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self._paths.pop(name))

    def close(self) -> None:
        """Removes all runs."""
        for name in list(self._paths):
            self._drop(name)
        self.runs = []

    def compact(self) -> None:
        """Merges all runs into one; the merged ones go."""
        if len(self.runs) > 1:
            rows = self.spark.table(self.runs[0])
            for name in self.runs[1:]:
                rows = rows.unionAll(self.spark.table(name))
            old, self.runs = self.runs, [self._write(rows)]
            for name in old:
                self._drop(name)

    def _anchors(self, name: str) -> DataFrame:
        return self.spark.table(name).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))

    def ingest(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """(doc_id, text_key, start, words) of the batch's words to remove; the batch then belongs to the index.

        batch and corpus have doc_id, text_key and text; corpus has the texts of
        all documents indexed so far and of the batch. Earlier means a smaller
        doc_id or, within a document, an earlier start: batches come in the
        order of their ids.
        """
        with scope():
            return written(self._ranges(batch, corpus), "ranges", keep=True)

    def _ranges(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        size = self.size
        cut = written(segments(batch, size), "passages")
        local = cut.where("again").select("doc_id", "text_key", "start", (F.col("windows") + size - 1).alias("words"))
        if len(self.runs) >= self.max_runs:
            self.compact()
        new = self._write(cut.where("not again").drop("again", "text_key"))
        anchors = self._anchors(new)
        for old in self.runs:
            past = self._anchors(old).select("h", F.col("n").alias("n2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            anchors = anchors.hint("merge").join(past, "h", "left").select("h", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        twice = written(anchors.where("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
        self.runs.append(new)
        found = None
        for name in self.runs:
            part = self.spark.table(name).join(twice.hint("merge"), "h").withColumn("fresh", F.lit(name == new))
            found = part if found is None else found.unionAll(part)
        found = written(found, "candidates")
        key, place = ["h", "r", "windows"], F.struct("doc_id", "start")
        firsts = found.groupBy(*key).agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n"))
        judged = joined_by_weight(found, firsts, key, "n", found.count(), place)
        heads = judged.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", (F.col("mixed") & (place == F.col("head"))).alias("single"))).alias("heads"), F.max("fresh").alias("fresh"))
        runs = written(run_digests(corpus.join(heads, "doc_id"), size), "runs")
        first = runs.groupBy("digest").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        total = first.agg(F.sum("n")).first()[0] or 0
        later = joined_by_weight(runs.where("fresh"), first, ["digest"], "n", total, place).where(place != F.col("head"))
        return local.unionAll(later.select("doc_id", "text_key", "start", "words"))


def remove_ranges(docs: DataFrame, ranges: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept) of (doc_id, text_key, text) without the ranges' words."""
    grouped = ranges.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "words")).alias("ranges"))
    rows = docs.join(grouped, ["doc_id", "text_key"], "left").select("doc_id", "text", F.coalesce("ranges", F.array().cast("array<struct<start:int,words:int>>")).alias("ranges"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=8 << 20):
                data, bounds = text_buffers(batch.column("text"))
                raw = data.tobytes()
                heads = batch.column("ranges")
                cuts, flat = heads.offsets.to_numpy(), heads.flatten()
                start, many = flat.field("start").to_numpy(), flat.field("words").to_numpy()
                base = cuts[0]
                total, gone, out = [], [], []
                for i in range(batch.num_rows):
                    words = raw[bounds[i] : bounds[i + 1]].split()
                    n, a, b = len(words), cuts[i] - base, cuts[i + 1] - base
                    total.append(n)
                    if b > a:
                        mark = np.zeros(n + 1, np.int64)
                        np.add.at(mark, np.minimum(start[a:b], n), 1)
                        np.add.at(mark, np.minimum(start[a:b] + many[a:b], n), -1)
                        stay = np.flatnonzero(np.cumsum(mark[:n]) <= 0).tolist()
                        words = [words[w] for w in stay]
                    gone.append(n - len(words))
                    out.append(b" ".join(words))
                columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in out])]
                if keep_text:
                    columns.append(pa.array([t.decode() for t in out]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def substring_dedup(docs: DataFrame, size: int = 20, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept); one row per row of docs.

    Removes every word that a window of `size` words covers whose words also
    start earlier. The rows enter a fresh index in `batches` ranges of their ids.

    * null and empty texts have no words; texts shorter than a window keep them all
    * a null id is not indexed: its text is kept whole and makes no other go
    * rows that repeat an id count as one document: at equal starts none is earlier than the other
    * an empty table gives an empty result; further columns of docs are ignored
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    index = FingerprintIndex(spark, size)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    ranges = None
    for low, high in zip(edges[:-1], edges[1:]):
        part, past = rows.where("doc_id is not null"), rows.where("doc_id is not null")
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part, past = part.where(F.col("doc_id") <= high), past.where(F.col("doc_id") <= high)
        found = index.ingest(part, past)
        ranges = found if ranges is None else ranges.unionAll(found)
    index.close()
    return remove_ranges(rows, ranges, keep_text)
