"""Nearest neighbours by multi-index hashing of binary codes.

Vectors get binary codes: signs after learned rotations (iterative quantisation
on a bounded sample). Largest inner product becomes nearest angle by one further
component, sqrt(largest norm^2 - norm^2), which is zero for a query.

The index deals distinct vectors to shards by hash; within a shard each 16-bit
substring of the codes has its own table from value to rows. A query comes with
a Hamming radius. By the pigeonhole principle a code within it agrees with the
query's in at least one substring up to that substring's share of the radius, so
probing the buckets within those shares retrieves every code within the radius.
What the whole codes confirm is ranked by inner products of the vectors.

The radius is the query's own: from a bounded sample come an estimate of the
score of its k-th neighbour and, for pairs of about that score, the spread of
Hamming distances. It shrinks as the table grows, so that what shards hand on
for a query depends on the radius and not on the number of shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_by_weight, scope, usable_vectors, written

#: Bits of a substring, and of a code (a multiple of 64).
SUB, BITS = 16, 256
#: Components of the sample that rotations and radii are learned from, and its vectors that are compared with all of it.
SAMPLE_VALUES, ASKED = 1 << 20, 256
#: Steps of iterative quantisation for each rotation.
STEPS = 12
#: Standard deviations that the radius lies above the mean distance of pairs as near as the k-th neighbour.
MARGIN = 1.25
#: Vectors of a shard, and queries that meet it at once at most and at least.
SHARD, CHUNK, LEAST_CHUNK = 16_384, 4096, 256
#: Rows that a plain join takes, however they fall on keys.
FEW = 100_000
#: Set bits of every substring value.
SET_BITS = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16))


def rotations(sample: np.ndarray, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """So many columns of orthogonal matrices side by side, each fitted to the signs it gives."""
    width = sample.shape[1]
    many = -(-bits // width)
    rng, out = np.random.default_rng(seed), []
    for _ in range(many):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(STEPS):
            u, _, vt = np.linalg.svd(np.where(sample @ turn > 0, 1.0, -1.0).T @ sample)
            turn = (u @ vt).T
        out.append(turn)
    return np.concatenate(out, 1)[:, :bits]


class Coder:
    """Codes, and each query's radius. Scores are inner products over the largest norm and the query's."""

    def __init__(self, sample: np.ndarray, largest: float, total: int, k: int, margin: float = MARGIN, bits: int = BITS):
        self.largest, self.margin = largest, margin
        self.sample = self._lifted(sample)
        self.turn = rotations(self.sample, bits)
        self.codes = self._signs(self.sample)
        #: The place, among the sample's scores, of a k-th neighbour in the whole table.
        self.place = min(len(sample), max(1, math.ceil(k * len(sample) / max(total, 1))))
        self._learn()

    def _lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.largest
        return np.concatenate([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))[:, None]], 1)

    def _asking(self, v: np.ndarray) -> np.ndarray:
        v = v / self.largest  # so that squares stay within range
        return np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], 1)

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ self.turn > 0, axis=1).view(np.uint16)

    def code(self, v: np.ndarray) -> np.ndarray:
        """Codes of rows of the index, as 16-bit substrings."""
        return self._signs(self._lifted(v))

    def code_query(self, v: np.ndarray) -> np.ndarray:
        return self._signs(self._asking(v))

    def _learn(self) -> None:
        """Mean and spread of Hamming distances by score, from the sample's pairs."""
        asked = self._asking(self.sample[: min(ASKED, len(self.sample)), :-1] * self.largest)
        scores, gaps = (asked @ self.sample.T).ravel(), distances(self._signs(asked), self.codes).ravel().astype(float)
        binned = np.clip(((scores + 1) * 50).astype(int), 0, 99)
        count = np.bincount(binned, minlength=100)
        with np.errstate(all="ignore"):
            mean = np.bincount(binned, gaps, 100) / count
            spread = np.sqrt(np.maximum(0.0, np.bincount(binned, gaps * gaps, 100) / count - mean * mean))
        seen = np.flatnonzero(count >= 30)
        self.knots = np.concatenate([(seen + 0.5) / 50 - 1, [1.0]])
        self.limits = np.concatenate([(mean + self.margin * spread)[seen], [0.0]])

    def radius(self, v: np.ndarray) -> np.ndarray:
        """The Hamming radius of each query."""
        scores = self._asking(v) @ self.sample.T
        at = scores.shape[1] - self.place
        goal = np.partition(scores, at, axis=1)[:, at]
        return np.ceil(np.interp(goal, self.knots, self.limits)).astype(np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of every code of a from every one of b."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


class Shard:
    """The codes of a shard with, for each substring, its values and the bucket of every row."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.tables = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are at most so far from a code: buckets near it in some substring, then the whole codes."""
        subs = self.codes.shape[1]
        share, over = divmod(int(radius) + 1, subs)  # the shares plus one each sum to radius + 1
        near = np.zeros(len(self.codes), bool)
        for s, (values, bucket) in enumerate(self.tables):
            limit = share - (s >= over)
            if limit >= 0:
                near |= (SET_BITS[values ^ code[s]] <= limit)[bucket]
        rows = np.flatnonzero(near)
        return rows[np.bitwise_count(self.wide[rows] ^ code.view(np.uint64)).sum(1, dtype=np.int32) <= radius]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


_INDEX = "entry long, mark long, _v array<double>, asks boolean, code binary, asking binary, radius int"


def _coded(shared, width: int):
    """Entries with their codes; those that ask also with the code and radius they ask with."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # each query is compared with the whole sample
                part = batch.slice(at, 512)
                v = _matrix(part.column("_v"), width)
                asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False).astype(bool))
                asking, radius = [None] * len(v), np.zeros(len(v), np.int32)
                if len(asks):
                    radius[asks] = coder.radius(v[asks])
                    for i, code in zip(asks.tolist(), coder.code_query(v[asks])):
                        asking[i] = code.tobytes()
                columns = [*(part.column(c) for c in ("entry", "mark", "_v", "asks")), pa.array([c.tobytes() for c in coder.code(v)], pa.binary()), pa.array(asking, pa.binary()), pa.array(radius)]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "mark", "_v", "asks", "code", "asking", "radius"])

    return coded


def _probe(width: int, k: int):
    """For each query of a cell the k best rows of its shard within the query's radius."""

    def probe(cell: pa.Table) -> pa.Table:
        mine = cell.column("from_query").to_numpy().astype(bool)
        queries, rows = cell.filter(pa.array(mine)), cell.filter(pa.array(~mine))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            shard, points, ids, first = Shard(_codes(rows.column("code"))), _matrix(rows.column("_v"), width), rows.column("entry").to_numpy(), rows.column("first").to_numpy()
            each = zip(queries.column("entry").to_pylist(), _matrix(queries.column("_v"), width), _codes(queries.column("code")), queries.column("radius").to_pylist())
            for asker, vector, code, radius in each:
                found = shard.within(code, radius)
                score = (points[found] * vector).sum(1)
                if len(found) > k:
                    near = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[near], score[near]
                    order = np.lexsort((first[found], -score))[:k]
                    found, score = found[order], score[order]
                out.append((np.full(len(found), asker), ids[found], score))
        askers, entries, scores = (np.concatenate(x) for x in zip(*out))
        return pa.table({"asker": askers, "entry": entries, "score": scores})

    return probe


def _searched(index: DataFrame, queries: DataFrame, many: int, total: int, width: int, k: int) -> DataFrame:
    """asker, entry, score: every chunk of queries meets every shard of the index."""
    shards = -(-total // SHARD)
    cores = index.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-many // CHUNK), min(-(-many // LEAST_CHUNK), -(-2 * cores // shards)))
    own = lambda n: F.pmod(F.col("mark"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["from_query", "entry", "first", "code", "radius", "_v"]
    left = queries.withColumns({"from_query": F.lit(True), "code": F.col("asking"), "chunk": own(chunks)}).select("chunk", every(shards).alias("shard"), *columns)
    right = index.withColumns({"from_query": F.lit(False), "shard": own(shards)}).select(every(chunks).alias("chunk"), "shard", *columns)
    return left.unionAll(right).groupBy("chunk", "shard").applyInArrow(_probe(width, k), "asker long, entry long, score double")


def nearest(df: DataFrame, asks: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, margin: float = MARGIN, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that asks, the k best other rows found, best first.

    asks is a SQL condition on _id, the row's id. Scores are inner products in
    double precision of the vectors as they are; equal scores go by id. Equal
    vectors are one entry of the index with its k + 1 smallest ids, and an answer
    is found once for each vector that asks.

    * vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
      another length than most have, and rows without an id
    * rows that repeat an id and vector are one; an id with several vectors asks with each and is found by its best
    * with at most k other rows all are returned; an entry that finds too few within its radius asks again without one
    * an empty table gives an empty result; further columns of df are ignored
    """
    with scope():
        return written(_nearest(df, asks, id_col, vector_col, k, margin, bits), "nearest", keep=True)


def _nearest(df: DataFrame, asks: str, id_col: str, vector_col: str, k: int, margin: float, bits: int) -> DataFrame:
    spark = df.sparkSession
    rows, width = usable_vectors(df.where(F.col(id_col).isNotNull()), id_col, vector_col, nonzero=True)
    rows = rows.select("_id", "_v", F.xxhash64("_v").alias("mark"), F.coalesce(F.expr(asks), F.lit(False)).alias("asks"))
    asking = rows.where("asks").groupBy("mark", "_v").agg(F.count(F.lit(1)).alias("held"))
    place = F.dense_rank().over(W.partitionBy("mark", "_v").orderBy("_id"))
    members = rows.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("mark", "_v").agg(F.array_sort(F.collect_set("_id")).alias("members"))  # at most k + 1
    entries = members.join(asking, ["mark", "_v"], "left").select(F.monotonically_increasing_id().alias("entry"), "mark", "_v", "members", F.coalesce("held", F.lit(0)).alias("held"))
    entries = written(entries, "entries")  # numbers stay as they were written
    total, many, held = entries.agg(F.count(F.lit(1)), F.sum((F.col("held") > 0).cast("long")), F.sum("held")).first()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    most = max(1, SAMPLE_VALUES // width)
    drawn = F.pmod(F.xxhash64("mark"), F.lit(1 << 40)) <= int(min(1.0, 1.1 * most / total) * (1 << 40))
    sample = entries.where(drawn).orderBy(F.xxhash64("mark"), "_v").limit(most).select("_v").collect()  # the documented sample
    coder = Coder(np.array([r["_v"] for r in sample]), entries.agg(F.max(size)).first()[0], total, k + 1, margin, bits)
    listed = entries.select("entry", "mark", "_v", (F.col("held") > 0).alias("asks"))
    coded = written(listed.mapInArrow(_coded(spark.sparkContext.broadcast(coder), width), _INDEX), "index")
    index = coded.join(entries.select("entry", F.element_at("members", 1).alias("first")), "entry")

    found = written(_searched(index, index.where("asks"), many, total, width, k + 1), "found")
    counts = found.groupBy(F.col("asker").alias("entry")).agg(F.count(F.lit(1)).alias("n"))
    short = written(coded.where("asks").select("entry").join(counts, "entry", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select("entry"), "short")
    if again := short.count():
        wide = index.join(short, "entry", "left_semi").withColumn("radius", F.lit(bits))
        found = found.join(short.withColumnRenamed("entry", "asker"), "asker", "left_anti").unionAll(_searched(index, wide, again, total, width, k + 1))
    return _answered(rows, entries, found, k, held)


def _answered(rows: DataFrame, entries: DataFrame, found: DataFrame, k: int, held: int) -> DataFrame:
    """What the entries found, for every row that asks."""
    named = entries.select("entry", "members", F.element_at("members", 1).alias("first"))
    ordered = F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "first"))
    best = found.join(named, "entry").withColumn("_n", ordered).where(F.col("_n") <= k + 1)
    opened = best.select("asker", (-F.col("score")).alias("less"), F.explode("members").alias("vec_id")).select("asker", F.struct("less", "vec_id").alias("hit"))
    lists = opened.groupBy("asker").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("answer"))  # of at most (k + 1) squared
    answers = lists.withColumnRenamed("asker", "entry").join(entries.select("entry", "mark", "_v", "held"), "entry").drop("entry")
    asked = rows.where("asks").select(F.col("_id").alias("query_id"), "mark", "_v")
    each = joined_by_weight(asked, answers, ["mark", "_v"], "held", held, F.col("query_id"), least=FEW, mark=F.col("mark"))
    hits = each.select("query_id", F.explode("answer").alias("hit")).where("hit.vec_id <> query_id")
    single = hits.groupBy("query_id", F.col("hit.vec_id").alias("vec_id")).agg(F.min("hit.less").alias("less"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("less", "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("less")).alias("score"))
