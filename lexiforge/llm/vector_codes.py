"""Product codes of vectors by filtering Lloyd rounds.

Vectors are scaled to integers and cut into parts; every part position has a
codebook. Each task lays its vectors in blocks and builds a kd-tree over every
part of a block once: nodes keep their box, count and component sums. A round
walks the trees from the root with a set of candidate entries. The entry
nearest to the middle of a node's box eliminates every other that is nowhere in
the box nearer; where one candidate is left, the whole subtree is assigned by
its cached sums. Leaves compare their points with the candidates that are left.

All arithmetic is on whole numbers, so the codes don't depend on how rows are
dealt to tasks. Between rounds only the codebooks (at most 256 entries per part)
come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_weight, scope, usable_vectors, written

#: Components of vectors in one block, and points below which a node is not split.
BLOCK_VALUES, LEAF = 1 << 17, 32
#: Scaled components beyond this count as this: all sums of squares fit 64 bits.
LIMIT = 1 << 26
#: Up to this products of a part are whole numbers in double precision.
EXACT = 1 << 22
#: Rows that a plain join takes, however they fall on labels.
FEW = 100_000


class Tree:
    """A kd-tree over the rows of points: node k covers order[first[k]:last[k]]; left[k] is its first child, 0 for a leaf."""

    FIELDS = (("order", "int"), ("first", "int"), ("last", "int"), ("left", "int"), ("low", "int"), ("high", "int"), ("sums", "long"))

    def __init__(self, order, first, last, left, low, high, sums):
        self.order, self.first, self.last, self.left = order, first, last, left
        self.low, self.high, self.sums = (x.reshape(len(first), -1).astype(np.int64) for x in (low, high, sums))

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points), dtype=np.int32)
        first, last, left, low, high = [0], [len(points)], [], [], []
        k = 0
        while k < len(first):
            own = points[order[first[k] : last[k]]]
            low.append(own.min(0))
            high.append(own.max(0))
            extent = high[k] - low[k]
            if len(own) <= leaf or not extent.any():
                left.append(0)
            else:
                by_widest = np.argsort(own[:, int(extent.argmax())], kind="stable")
                order[first[k] : last[k]] = order[first[k] : last[k]][by_widest]
                middle = first[k] + len(own) // 2
                left.append(len(first))
                first += [first[k], middle]
                last += [middle, last[k]]
            k += 1
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], 0, dtype=np.int64)])
        first, last, left = (np.array(x, np.int32) for x in (first, last, left))
        return cls(order, first, last, left, np.array(low), np.array(high), upto[last] - upto[first])

    def fields(self) -> dict:
        return {name: getattr(self, name).ravel().astype(np.int64 if kind == "long" else np.int32) for name, kind in self.FIELDS}

    def assign(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest entry of each point (of equal ones the first), sums and counts per entry, and the distances computed."""
        size = len(book)
        entry, sums, counts, looked = np.zeros(len(points), np.int32), np.zeros((size, points.shape[1]), np.int64), np.zeros(size, np.int64), 0
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, size), bool)
        while len(nodes):
            open_ = self._left_open(nodes, open_, book)
            alone = open_.sum(1) == 1
            for k, e in zip(nodes[alone].tolist(), open_[alone].argmax(1).tolist()):
                entry[self.order[self.first[k] : self.last[k]]] = e
                sums[e] += self.sums[k]
                counts[e] += self.last[k] - self.first[k]
            leaf = (self.left[nodes] == 0) & ~alone
            for k, mask in zip(nodes[leaf].tolist(), open_[leaf]):
                own, among = self.order[self.first[k] : self.last[k]], np.flatnonzero(mask)
                found = among[_nearest(points[own], book[among])]
                looked += len(own) * len(among)
                entry[own] = found
                np.add.at(sums, found, points[own])
                counts += np.bincount(found, minlength=size)
            inner = ~(leaf | alone)
            below = self.left[nodes[inner]].astype(np.int64)
            nodes, open_ = np.concatenate([below, below + 1]), np.concatenate([open_[inner]] * 2)
        return entry, sums, counts, looked

    def _left_open(self, nodes: np.ndarray, open_: np.ndarray, book: np.ndarray) -> np.ndarray:
        """The candidates of each node that are somewhere in its box nearer than the one nearest to its middle, and that one."""
        low, high = self.low[nodes], self.high[nodes]
        twice = (low + high).astype(float)
        away = (book * book).sum(1) * 4.0 - 4.0 * twice @ book.T.astype(float)
        star = np.where(open_, away, np.inf).argmin(1)
        out = open_.copy()
        for k in range(0, len(nodes), 64):  # bounds what is held at once
            part = slice(k, k + 64)
            gap = book[None] - book[star[part]][:, None]
            both = book[None] + book[star[part]][:, None]
            corner = np.where(gap > 0, high[part][:, None], low[part][:, None])  # of the box, where the other entry does best
            more = (gap * (both - 2 * corner)).sum(2)
            out[part] &= ~((more > 0) | ((more == 0) & (np.arange(len(book)) > star[part][:, None])))
        return out


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each point in whole numbers; of equal ones the first."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) <= EXACT else np.int64
    p, c = points.astype(kind), book.astype(kind)
    return ((c * c).sum(1) - 2 * (p @ c.T)).argmin(1)


def _cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


_TREES = "ids array<long>, labels array<string>, points array<int>, trees array<struct<" + ", ".join(f"{n}:array<{k}>" for n, k in Tree.FIELDS) + ">>"


def _planted(length: int, parts: int):
    """Rows of _id, label_key and _x as blocks with a tree per part."""
    cuts, most = _cuts(length, parts), max(1, BLOCK_VALUES // length)
    inner = {"int": pa.int32(), "long": pa.int64()}
    tree = pa.list_(pa.struct([(n, pa.list_(inner[k])) for n, k in Tree.FIELDS]))

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        flat = rows.column("_x").combine_chunks().flatten().to_numpy().astype(np.int32)
        points = flat.reshape(rows.num_rows, length)
        trees = [Tree.build(np.ascontiguousarray(points[:, a:b])).fields() for a, b in zip(cuts[:-1], cuts[1:])]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [one(rows.column("_id").combine_chunks()), one(rows.column("label_key").combine_chunks()), one(pa.array(flat)), pa.array([trees], tree)]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees"])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = batch.slice(at, min(most - count, batch.num_rows - at))
                held.append(take)
                at, count = at + take.num_rows, count + take.num_rows
                if count == most:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return plant


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[int]) -> Iterator[tuple]:
    """ids, labels, and (points, tree) of each part, block by block."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
            points = batch.column("points")[k].values.to_numpy().astype(np.int64).reshape(len(ids), cuts[-1])
            trees = batch.column("trees")[k].values
            parts = []
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                parts.append((np.ascontiguousarray(points[:, a:b]), Tree(*(trees.field(n)[p].values.to_numpy() for n, _ in Tree.FIELDS))))
            yield ids, labels, parts


def _round(trees: DataFrame, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of its points' mean; unused ones stay."""
    held = trees.sparkSession.sparkContext.broadcast(books)  # at most `entries` vectors

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        total = [np.zeros(b.shape, np.int64) for b in now]
        counts = [np.zeros(len(b), np.int64) for b in now]
        for _, _, parts in _blocks(batches, cuts):
            for p, (points, tree) in enumerate(parts):
                _, s, c, _ = tree.assign(points, now[p])
                total[p] += s
                counts[p] += c
        for p in range(len(now)):
            used = np.flatnonzero(counts[p])
            width = now[p].shape[1]
            columns = [np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), total[p][used].ravel(), np.repeat(counts[p][used], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "total", "n"])

    found = trees.mapInArrow(sums, "part long, entry long, place long, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = [b.copy() for b in books]
    for r in found.collect():  # at most `entries` times the length of a vector
        after[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return after


def _coded(books: list[np.ndarray], cuts: list[int]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, parts in _blocks(batches, cuts):
            found = [tree.assign(points, books[p])[0] for p, (points, tree) in enumerate(parts)]
            error = sum(((points - books[p][found[p]]) ** 2).sum(1) for p, (points, _) in enumerate(parts))
            codes = [bytes(c).hex() for c in np.stack(found, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error.astype(np.int64))], names=["vec_id", "label_key", "code", "error"])

    return code


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label_key, code, error, label_error), and the codebooks per part.

    * rows whose vector is null, empty or holds null or non-finite components go, and those of another length than most have
    * a length that the parts don't divide gives parts whose lengths differ by one
    * scaled components beyond LIMIT count as LIMIT
    * fewer rows than entries give codebooks of that many; a null id comes after all others
    * rows that repeat an id count each; null labels are one label
    * an empty table gives an empty result and no codebooks; further columns of df are ignored
    """
    if entries > 256:
        raise ValueError("codes have one byte per part")
    with scope():
        usable, length = usable_vectors(df, id_col, vector_col, label_col)
        spark = df.sparkSession
        if not length:
            return spark.createDataFrame([], "vec_id long, label_key string, code string, error long, label_error long"), []
        whole = F.transform("_v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
        label = F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit("null"))
        rows = usable.select("_id", label.alias("label_key"), whole.alias("_x"))
        cuts = _cuts(length, parts)
        trees = written(rows.mapInArrow(_planted(length, parts), _TREES), "trees", block=32 << 20)
        start = np.array([r["_x"] for r in rows.orderBy(F.asc_nulls_last("_id"), "_x").limit(entries).select("_x").collect()], np.int64)  # at most `entries` rows
        books = [np.ascontiguousarray(start[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        for _ in range(rounds):
            books = _round(trees, books, cuts)
        coded = written(trees.mapInArrow(_coded(books, cuts), "vec_id long, label_key string, code string, error long"), "codes", keep=True)
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held"))
    total = coded.count()
    return joined_by_weight(coded, sums, ["label_key"], "held", total, F.col("vec_id"), least=FEW).drop("held"), books
