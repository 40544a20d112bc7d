"""N-gram Jaccard join by blocked sparse products of document by n-gram incidence.

Documents with the same sequence of words are one class from the start. Which
classes can meet at all follows from set sizes: sets that link differ in at most
D = (1 - t) / (1 + t) * (sum of sizes) shingles, so when the shingles are dealt
over more than D hash buckets, at least one bucket is equal. Classes that share
a bucket are a group.

The members of a large group are first compared with one of them, the pivot:
what links with it is one component from then on, and pairs within a component
are never looked at again. The pairs that are left are thinned by counts per
hash range and form clusters. Within a cluster the incidence matrix is
multiplied by its transpose, a block of documents against a block of documents
and of n-gram columns at a time: rare columns add their postings' pairs to the
overlaps, columns that fill a block are multiplied whole. Pairs whose overlap
stays below the bound that their sizes give are discarded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, joined_by_weight, scope, written
from .graph import components
from .words import Words, _mix, exact_shingle_sets, shingle_sets, slices, text_buffers

U = np.uint64
#: Shingles and documents of a block: what one side of a product holds.
BLOCK_SHINGLES, BLOCK_DOCS = 400_000, 512
#: N-gram columns multiplied at once; columns that fill more than one of so many cells are multiplied whole.
BLOCK_COLUMNS, DENSE = 4096, 32
#: Documents of a block where counts are compared, and rows of a pack of small groups.
SKETCH_DOCS, SKETCH_ROWS = 1024, 3_000
#: Nodes whose texts are wanted that are broadcast at most (40 bytes each), so that no other text moves; beyond, texts are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows of which one bit each is broadcast at most, so that no signature moves (64 to a mask of 16 bytes); beyond, signatures are joined by a shuffle.
BROADCAST_BITS = 100_000_000
#: Groups of more documents than this meet pivots first; turns in which they do at most, and members of a group that may stay apart without a further one.
PIVOT_DOCS, PIVOTS, APART_DOCS = 64, 3, 512
#: A further turn follows where the last pivots' labels hold at least one of so many members of the groups of which more than a block stays apart: a label spares the square of its share.
PAYS = 2
#: Pairs listed at once, and bytes of counts compared at once.
PAIRS, COUNT_BYTES = 100_000, 2 << 20
#: Bytes of text hashed at once.
HASH_BYTES = 512 << 10
LINKS = "a long, b long"


class SizeClasses:
    """Size classes for a threshold: bounds, and buckets per class.

    Class k holds sizes bound[k] up to bound[k + 1] - 1. Linked sets lie in one
    class or in neighbours, and meet in the class of the larger.
    """

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        bound = [1]
        while bound[-1] < most:
            bound.append(max(bound[-1] * 7 // 5, bound[-1] * 100 // percent) + 1)
        self.bound = np.array(bound, np.int64)
        largest = self.bound[1:] - 1
        differ = (100 - percent) * 2 * largest // (100 + percent)
        # Empty buckets that a document may leave out: as many as its least size makes likely.
        spare, least = np.ones(len(differ)), np.maximum(1, self.bound[:-1] * percent / 100)
        for _ in range(30):
            empty = (differ + 1 + spare) * np.exp(-least / (differ + 1 + spare))
            spare = np.minimum(np.ceil(empty + 3 * np.sqrt(empty)) + 1, differ + 5)
        self.spare = spare.astype(np.int64)
        self.buckets = differ + 1 + self.spare
        #: Smaller sets link with equal sets only.
        self.least = percent // (100 - percent) if percent < 100 else 1 << 60

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bound, size, "right") - 1


def bucket_signatures(values: np.ndarray, bounds: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all documents' buckets, and the document of each.

    Sets too small to link with any but their equal have one of the whole set.
    """
    size = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(size)), size)
    own = classes.of(np.maximum(size, 1))
    out, owner = [], []
    for shift in (0, 1):
        k = own + shift
        use = size >= classes.least
        if shift:
            use &= size * 100 >= classes.bound[k] * classes.percent
        docs = np.flatnonzero(use)
        if not len(docs):
            continue
        many = classes.buckets[k[docs]]
        begin = np.zeros(len(size), np.int64)
        begin[docs] = np.cumsum(many) - many
        pick = use[doc_of]
        v, d = values[pick], doc_of[pick]
        spread = _mix(v + (k[d] + 1).astype(U) * U(0x9E3779B97F4A7C15)) >> U(32)
        place = begin[d] + ((spread * classes.buckets[k[d]].astype(U)) >> U(32)).astype(np.int64)
        sums = np.zeros(int(many.sum()), U)
        np.add.at(sums, place, _mix(v ^ U(0xA0761D6478BD642F)))
        filled = np.bincount(place, minlength=len(sums)) > 0
        owner_of = np.repeat(docs, many)
        empties = np.bincount(owner_of[~filled], minlength=len(size))
        keep = filled | (empties > classes.spare[k])[owner_of]
        index = np.arange(len(sums)) - begin[owner_of]
        sums += (k[owner_of] * (1 << 20) + index).astype(U) * U(0xE7037ED1A0B428DB)
        out.append(_mix(sums)[keep])
        owner.append(owner_of[keep])
    small = np.flatnonzero((size > 0) & (size < classes.least))
    if len(small):
        whole = np.zeros(len(size), U)
        of_small = (size < classes.least)[doc_of]
        np.add.at(whole, doc_of[of_small], _mix(values[of_small] ^ U(0x8EBC6AF09C88C6E3)))
        out.append(_mix(whole[small] + size[small].astype(U)))
        owner.append(small)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sigs, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return sigs[order], owner[order]


def _signed(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.view(np.int64))


def sketch_width(size: np.ndarray) -> np.ndarray:
    """Hash ranges that a set of this size is counted by; 0 for the empty set."""
    return np.where(size < 1, 0, np.where(size < 400, 64, np.where(size < 3000, 256, 1024)))


def sketches(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Counts by the topmost bits of mixed hashes, one byte each, at most 255."""
    size = np.diff(bounds)
    width = sketch_width(size)
    begin = np.cumsum(width) - width
    doc_of = np.repeat(np.arange(len(size)), size)
    shift = (64 - np.log2(np.maximum(width, 2)).astype(np.int64)).astype(U)
    at = begin[doc_of] + (_mix(values ^ U(0xD6E8FEB86659FD93)) >> shift[doc_of]).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(width.sum())), 255).astype(np.uint8)
    offsets = np.append(begin, width.sum()).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(counts.tobytes())])


SIGNED = "doc_id long, text_key long, n long, seq binary, sketch binary, sigs array<long>"


def _digests(words: Words) -> list[bytes]:
    """What tells sequences of words apart."""
    return [hashlib.blake2b(t, digest_size=16).digest() for t in words.sequences()]


def _signatures(size: int, percent: int):
    classes = SizeClasses(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=HASH_BYTES):
                words = Words(*text_buffers(batch.column("text")), fold=True)
                values, bounds = shingle_sets(words, size)
                sigs, owner = bucket_signatures(values, bounds, classes)
                offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(bounds)), pa.array(_digests(words), pa.binary()), sketches(values, bounds), pa.ListArray.from_arrays(offsets, _signed(sigs))],
                    names=["doc_id", "text_key", "n", "seq", "sketch", "sigs"],
                )

    return sign


def _near_counts(size: np.ndarray, counts: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can link, by their sizes and by how far their counts differ at least."""
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    keep = np.flatnonzero(100 * low >= percent * high)
    a, b = a[keep], b[keep]
    most = (100 - percent) * (size[a] + size[b]) // (100 + percent)
    width = np.minimum(sketch_width(size[a]), sketch_width(size[b]))
    near = np.zeros(len(keep), bool)
    for w, rows in counts.items():
        these = np.flatnonzero(width == w)
        step = COUNT_BYTES // w
        for at in range(0, len(these), step):
            part = these[at : at + step]
            x, y = rows[a[part]], rows[b[part]]
            near[part] = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64) <= most[part]
    return keep[near]


def _pairs(groups: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within each group (sorted): left with right, or all where sides are 2."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    many = np.diff(np.append(starts, len(groups)))
    if (side == 2).all():
        for g in np.unique(many[many > 1]):
            i, j = np.triu_indices(g, 1)
            base = starts[many == g]
            per = max(1, PAIRS // len(i))
            for c in range(0, len(base), per):
                part = base[c : c + per, None]
                yield from _cut((part + i).ravel(), (part + j).ravel())
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for c in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
            part = left[c : c + max(1, PAIRS // max(1, len(right)))]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def _cut(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for c in range(0, len(a), PAIRS):
        yield a[c : c + PAIRS], b[c : c + PAIRS]


def reach(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label per place: the smallest place reached over links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return label


def _count_rows(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes of a task: their ids, each row's node, sizes, labels and counts by width."""
    ids, first, node = np.unique(group.column("node").to_numpy(), return_index=True, return_inverse=True)
    size, label = group.column("n").to_numpy()[first], group.column("label").to_numpy()[first]
    data, offsets = text_buffers(group.column("sketch"))
    width, counts = sketch_width(size), {}
    for w in (64, 256, 1024):
        rows = np.zeros((len(ids), w), np.uint8)
        for have in (w, 4 * w, 16 * w):
            these = np.flatnonzero(width == have)
            if len(these):
                own = data[offsets[first[these]][:, None] + np.arange(have)]
                rows[these] = np.minimum(own.reshape(len(these), w, -1).sum(2), 255)
        counts[w] = rows
    return ids, node, size, label, counts


def _compare(percent: int):
    def compare(group: pa.Table) -> pa.Table:
        """Which nodes the pairs that can link reach, but for pairs of one label."""
        order = np.argsort(group.column("group").to_numpy(), kind="stable")
        names, side = group.column("group").to_numpy()[order], group.column("side").to_numpy()[order]
        ids, node, size, known, counts = _count_rows(group)
        node = node[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _pairs(names, side):
            i, j = node[i], node[j]
            apart = known[i] != known[j]
            i, j = i[apart], j[apart]
            near = _near_counts(size, counts, i, j, percent)
            a.append(i[near])
            b.append(j[near])
        label = reach(len(ids), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    return compare


def _partners(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of pivots (side 0) and of their partners in a task of stars."""
    names, side = group.column("group").to_numpy(), group.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left = left[np.argsort(names[left], kind="stable")]
    at = np.searchsorted(names[left], names[right])
    found = at < len(left)
    found[found] = names[left[at[found]]] == names[right[found]]
    return left[at[found]], right[found]


TASK = ["group", "node", "label"]


def packed(members: DataFrame, packs: int) -> DataFrame:
    """Rows (group, node, label) of small groups dealt to tasks: pack, i, j, side; a group goes whole to a pack (side 2)."""
    none = F.lit(-1).cast("long")
    return members.select(*TASK, F.pmod(F.xxhash64("group"), F.lit(packs)).alias("pack"), none.alias("i"), none.alias("j"), F.lit(2).alias("side"))


def split(members: DataFrame, most_docs: int, most_weight: int | None = None) -> DataFrame:
    """Rows (group, node, label, main, weight) of large groups dealt to tasks: pack, i, j, side beside group, node and label.

    The members with the group's main label are split into blocks by hash, and
    the others into blocks of their own. Each pair of blocks is a task unless
    both are of the main label, with the first block on side 0 and the second on
    side 1 (2 where they are one): a group whose others fill one block takes
    work in proportion to its members. A group that fits one block is one task.
    """
    of_main = F.col("label") == F.col("main")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.when(c, F.col("weight")).otherwise(0)) / (most_weight or 1 << 60), F.sum(c.cast("int")) / most_docs)))
    whole = (F.sum("weight") <= (most_weight or 1 << 60)) & (F.count(F.lit(1)) <= most_docs)
    counts = members.groupBy("group").agg(blocks(of_main).alias("first"), blocks(~of_main).alias("second"), whole.alias("whole"))
    hashed, none = lambda n: F.pmod(F.xxhash64("node"), F.col(n)), F.lit(0).cast("long")
    own = F.when(F.col("whole"), none).when(of_main, hashed("first")).otherwise(F.col("first") + hashed("second"))
    low = F.when(of_main & ~F.col("whole"), F.col("first")).otherwise(none)
    other = F.explode(F.sequence(low, F.when(F.col("whole"), none).otherwise(F.col("first") + F.col("second") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    placed = members.join(counts, "group").withColumn("own", own).withColumn("other", other)
    return placed.select(*TASK, F.col("group").alias("pack"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def starred(pairs: DataFrame, most_docs: int, most_weight: int) -> DataFrame:
    """Pairs (a, b, n) of a pivot and a partner dealt to tasks: pack, i, side, group, node, label.

    n is the pivot's weight. Few partners go with their pivot (side 0) to one of
    many packs; many are split into blocks by hash, each with the pivot.
    """
    packs = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("weight") / most_weight, F.col("docs") / most_docs)))
    pivots = counts.select("a", blocks.alias("blocks"))
    small, none = F.col("blocks") == 1, F.lit(-1).cast("long")
    pack = F.when(small, F.pmod(F.xxhash64("a"), F.lit(packs))).otherwise(F.col("a"))
    partner = F.struct(F.when(small, none).otherwise(F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("i"), F.lit(1).alias("side"), F.col("b").alias("node"))
    rows = pairs.select("a", "b").join(pivots, "a").select(pack.alias("pack"), F.col("a").alias("group"), partner.alias("x"))
    first = F.struct(F.when(small, none).otherwise(F.col("block")).alias("i"), F.lit(0).alias("side"), F.col("a").alias("node"))
    own = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(pack.alias("pack"), F.col("a").alias("group"), first.alias("x"))
    return rows.unionAll(own).select("pack", "group", "x.*", F.col("x.node").alias("label"))


def overlap_product(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared shingles of each left with each right document."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, column = np.unique(values, return_inverse=True)
    out = np.zeros(len(left) * len(right), np.int64)
    sides, many = [], []
    total = int(column.max()) + 1 if len(column) else 0
    for docs in (left, right):
        place = np.full(len(bounds) - 1, -1)
        place[docs] = np.arange(len(docs))
        use = place[rows] >= 0
        c, r = column[use], place[rows[use]]
        order = np.argsort(c, kind="stable")
        sides.append((c[order], r[order]))
        many.append(np.bincount(c, minlength=total))
    work = many[0] * many[1]
    full = work * DENSE > len(out)
    (lc, lr), (rc, rr) = sides
    begin = np.cumsum(many[1]) - many[1]
    # Rare columns: every posting of the left with the postings of its column on the right.
    use = np.flatnonzero(~full[lc] & (many[1][lc] > 0))
    upto = np.cumsum(many[1][lc[use]])
    for part in np.split(use, np.searchsorted(upto, np.arange(10 * PAIRS, upto[-1] if len(upto) else 0, 10 * PAIRS))):
        n = many[1][lc[part]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(lr[part], n) * len(right) + rr[np.repeat(begin[lc[part]], n) + within], minlength=len(out))
    out = out.reshape(len(left), len(right))
    # Full columns: a block of them at a time.
    chosen = np.flatnonzero(full)
    number = np.full(total, -1)
    number[chosen] = np.arange(len(chosen))
    for at in range(0, len(chosen), BLOCK_COLUMNS):
        blocks = []
        for (c, r), docs in zip(sides, (left, right)):
            own = number[c] - at
            use = (own >= 0) & (own < BLOCK_COLUMNS) & (number[c] >= 0)
            block = np.zeros((len(docs), min(BLOCK_COLUMNS, len(chosen) - at)), np.float32)
            block[r[use], own[use]] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def block_links(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Label per document: the smallest place that its links in this block reach; pairs known to be linked are left out."""
    size = np.diff(bounds)
    known = np.arange(len(size)) if known is None else known
    fits = lambda a, b: 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
    can = fits(left[:, None], right[None, :]) & (known[left][:, None] != known[right][None, :])
    left, right = left[can.any(1)], right[can.any(0)]
    overlap = overlap_product(values, bounds, left, right)
    union = size[left][:, None] + size[right][None, :] - overlap
    a, b = np.nonzero((100 * overlap >= percent * union) & (left[:, None] != right[None, :]))
    return reach(len(size), left[a], right[b])


def star_links(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (pivot a, partner b) link."""
    size = np.diff(bounds)
    width = int(values.max()) + 1 if len(values) else 1
    pivots, nth = np.unique(a, return_inverse=True)
    spread = lambda docs: np.repeat(bounds[docs], size[docs]) + np.arange(size[docs].sum()) - np.repeat(np.cumsum(size[docs]) - size[docs], size[docs])
    have = np.repeat(np.arange(len(pivots)), size[pivots]) * width + values[spread(pivots)]
    pair = np.repeat(np.arange(len(b)), size[b])
    want = nth[pair] * width + values[spread(b)]
    at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
    shared = np.bincount(pair, have[at] == want if len(have) else None, len(b)).astype(np.int64)
    return 100 * shared >= percent * (size[a] + size[b] - shared)


def _texts_of(group: pa.Table) -> pa.Table:
    """One row per node and side, with the text of its class (a repeated id may bring others)."""
    words = Words(*text_buffers(group.column("text")), fold=True)
    good = np.array([d == s for d, s in zip(_digests(words), group.column("seq").to_pylist())], bool)
    rows = np.flatnonzero(good)
    key = group.column("node").to_numpy()[rows], group.column("side").to_numpy()[rows], group.column("group").to_numpy()[rows]
    order = np.lexsort(key)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in key])
    return group.take(rows[order[new]])


def _multiply(size: int, percent: int):
    def multiply(group: pa.Table) -> pa.Table:
        group = _texts_of(group)
        values, bounds = exact_shingle_sets(Words(*text_buffers(group.column("text")), fold=True), size)
        side, ids = group.column("side").to_numpy(), group.column("node").to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        label = block_links(values, bounds, left, right, percent, group.column("label").to_numpy())
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    return multiply


def _multiply_stars(size: int, percent: int):
    def multiply(group: pa.Table) -> pa.Table:
        group = _texts_of(group)
        values, bounds = exact_shingle_sets(Words(*text_buffers(group.column("text")), fold=True), size)
        ids = group.column("node").to_numpy()
        a, b = _partners(group)
        good = star_links(values, bounds, a, b, percent)
        return pa.table({"a": ids[a[good]], "b": ids[b[good]]})

    return multiply


def relabelled(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows with the labels that their nodes took: tops (node, top)."""
    return rows.join(tops, "node", "left").withColumn("label", F.coalesce("top", "label")).drop("top")


def in_place(rows: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """Rows whose number `row` is among chosen (one column of such numbers); total is the number of rows.

    The chosen numbers are told by masks of 64 bits that are broadcast, so the rows, which are wide, stay where they are.
    """
    number = chosen.toDF("row")
    if total > BROADCAST_BITS:
        return rows.join(number, "row", "left_semi")
    mask, bit = F.shiftright("row", 6).alias("mask"), F.col("row").bitwiseAND(F.lit(63)).cast("int")
    bits = number.groupBy(mask).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    return rows.withColumn("mask", mask).join(F.broadcast(bits), "mask").where(F.getbit("bits", bit) == 1).drop("mask", "bits")


class _Join:
    """The tables that the steps of one join share: texts, class nodes with sketches, and the links so far."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, size: int, percent: int):
        self.rows, self.nodes, self.size, self.percent = rows, nodes, size, percent
        self.counts = nodes.select("node", "n", "sketch")
        self.links: list[DataFrame] = []
        self.tops: list[DataFrame] = []

    def with_texts(self, tasks: DataFrame) -> DataFrame:
        """Rows of tasks with the texts of their nodes."""
        need = written(tasks, "jaccard-tasks")
        keys = written(need.select("node").distinct().join(self.nodes.select("node", "doc_id", "text_key", "seq"), "node"), "jaccard-keys")
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        same = self.rows["doc_id"].eqNullSafe(keys["doc_id"]) & (self.rows["text_key"] == keys["text_key"])
        return need.join(self.rows.join(keys, same).select("node", "seq", "text"), "node")

    def thinned(self, members: DataFrame, most_docs: int) -> tuple[DataFrame, DataFrame]:
        """Rows (group, node, n, weight, label, main, pivot) of large groups (group, node, n, weight) that are not one component yet, and the last turn's labels (node, top).

        The first turn draws as a group's pivot the node that is in most groups,
        which lost the fewest of its shingles to changes, and later turns that of
        the smallest hash: groups that share most of their members mostly share
        their pivot, too. Each node
        is compared with one pivot, of those of its groups that are of a fitting
        size the one that it shares most groups with, and takes its label where
        they link. Further turns go over groups of which more than a block
        stays apart, while they pay: what no pivot takes is compared by blocks.
        A group's main label is that of its last pivot. The rows' labels are
        those before the last turn, as few nodes may have taken others in it.
        """
        rows = written(members.withColumn("label", F.col("node")).withColumn("often", F.count(F.lit(1)).over(W.partitionBy("node"))), "jaccard-open")
        for turn in range(PIVOTS):
            if turn:
                before, rows = rows, written(relabelled(rows.drop("main", "pivot"), further), "jaccard-open")
                drop_written(before)
            drawn = rows.groupBy("group").agg(F.max_by(F.struct("label", "node", "n"), F.struct(F.lit(0) if turn else F.col("often"), F.xxhash64("node", F.lit(turn)))).alias("p"), F.count(F.lit(1)).alias("docs"))
            drawn = written(drawn.select("group", F.col("p.node").alias("pivot"), F.col("p.label").alias("own"), F.col("p.n").alias("size"), "docs"), "jaccard-pivots")
            fits = F.least("n", "size") * 100 >= F.greatest("n", "size") * self.percent
            meet = rows.join(drawn.drop("docs"), "group").where(fits).where("label <> own").groupBy("node", "pivot", "size").agg(F.count(F.lit(1)).alias("shared"))
            best = meet.groupBy("node").agg(F.max_by(F.struct("pivot", "size"), F.struct("shared", "pivot")).alias("p"))
            pairs = written(best.select(F.col("p.pivot").alias("a"), F.col("node").alias("b"), F.col("p.size").alias("n")), "jaccard-pairs")
            tasks = self.with_texts(starred(pairs, BLOCK_DOCS, BLOCK_SHINGLES))
            links = written(tasks.groupBy("pack", "i").applyInArrow(_multiply_stars(self.size, self.percent), LINKS), "jaccard-links")
            self.links.append(links)
            # A pivot may have found a pivot of its own: one step further.
            parents = links.select(F.col("a").alias("up"), F.col("b").alias("node"))
            further = written(parents.join(parents.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("top")), "jaccard-tops")
            self.tops.append(further)
            mains = drawn.select("group", F.col("pivot").alias("node"), "own", "docs").join(further, "node", "left")
            mains = written(mains.select("group", F.col("node").alias("pivot"), F.coalesce("top", "own").alias("main"), "docs"), "jaccard-mains")
            # Only memberships of nodes that took a label change how many have a group's main one.
            had = rows.groupBy("group", F.col("label").alias("main")).agg(F.count(F.lit(1)).alias("same")).join(mains.select("group", "main"), ["group", "main"])
            took = rows.select("group", "node", "label").join(further, "node").join(mains.select("group", "main"), "group")
            took = took.groupBy("group", "main").agg(F.sum((F.col("top") == F.col("main")).cast("long") - (F.col("label") == F.col("main")).cast("long")).alias("same"))
            state = had.unionByName(took).groupBy("group").agg(F.sum("same").alias("same"))
            state = mains.join(state, "group", "left").select("group", "pivot", "main", "docs", (F.col("docs") - F.coalesce("same", F.lit(0))).alias("others"))
            state = written(state, "jaccard-apart")
            before, rows = rows, written(rows.join(state.where("others > 0").select("group", "pivot", "main"), "group"), "jaccard-open")
            drop_written(before)
            others, docs = state.where(F.col("others") > most_docs).agg(F.sum("others"), F.sum("docs")).first()
            if not docs or (docs - others) * PAYS < docs:
                break
        return rows, further

    def merged(self, rows: DataFrame, tops: DataFrame) -> DataFrame:
        """Rows (group, node, label, main, weight) of open groups, in which no two nodes meet more often than they need; tops: the last labels (node, top).

        Groups that share members are joined to one where all pairs of its nodes,
        each met once, are fewer than the pairs within the groups: so near copies
        that share hundreds of buckets and stay apart are compared once. A joined
        group's main label is the one that most of its nodes have.
        """
        found = written(components(rows.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "jaccard-joined")
        last = found.join(tops, "node", "left")
        placed = rows.select("group", "node", "label", "main").join(last, "node").withColumn("label", F.coalesce("top", "label")).drop("top")
        placed = written(placed, "jaccard-placed")
        apart = placed.groupBy("component", "group").agg(F.count(F.lit(1)).alias("c")).groupBy("component").agg(F.sum(F.col("c") * F.col("c")).alias("within"))
        whole = found.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
        joined = written(apart.join(whole, "component").where("c * c <= within").select("component"), "jaccard-whole")
        few = written(placed.join(joined, "component", "left_semi").select(F.col("component").alias("group"), "node", "label").distinct(), "jaccard-few")
        many = few.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
        mains = many.groupBy("group").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        one = F.lit(1).cast("long").alias("weight")
        rest = placed.join(joined, "component", "left_anti").select("group", "node", "label", "main", one)
        return written(few.join(mains, "group").select("group", "node", "label", "main", one).unionAll(rest), "jaccard-members")

    def compare(self, meets: DataFrame) -> DataFrame:
        """Clusters (node, group) of what can link by counts; meets: (group, node, many)."""
        small = meets.where(F.col("many") <= PIVOT_DOCS).withColumn("label", F.col("node"))
        large = meets.where(F.col("many") > PIVOT_DOCS).select("group", "node", "n", F.lit(1).cast("long").alias("weight"))
        many = meets.agg(F.count_if(F.col("many") <= PIVOT_DOCS), F.count_if(F.col("many") > PIVOT_DOCS)).first()
        tasks = packed(small, many[0] // SKETCH_ROWS + 1)
        if many[1]:
            tasks = tasks.unionAll(split(self.merged(*self.thinned(large, APART_DOCS)), SKETCH_DOCS))
        near = tasks.join(self.counts, "node").groupBy("pack", "i", "j").applyInArrow(_compare(self.percent), LINKS)
        return written(components(near).withColumnRenamed("component", "group"), "jaccard-clusters")

    def multiply(self, clusters: DataFrame) -> None:
        """Links within clusters (group, node), by products of blocks."""
        members = clusters.join(self.nodes.select("node", F.col("n").alias("weight")), "node")
        groups = members.groupBy("group").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("docs"))
        groups = written(groups.withColumn("small", (F.col("all") <= BLOCK_SHINGLES) & (F.col("docs") <= BLOCK_DOCS)), "jaccard-sizes")
        total = groups.agg(F.sum("all"), F.sum("docs"), F.sum((~F.col("small")).cast("int"))).first()
        rows = members.join(groups.select("group", "small"), "group").select("group", "node", "weight", "small")
        small = rows.where("small").withColumn("label", F.col("node"))
        tasks = packed(small, int(max((total[0] or 0) // BLOCK_SHINGLES, (total[1] or 0) // BLOCK_DOCS)) + 1)
        if total[2]:
            tasks = tasks.unionAll(split(self.labelled(rows.where("not small").drop("small")), BLOCK_DOCS, BLOCK_SHINGLES))
        self.links.append(written(self.with_texts(tasks).groupBy("pack", "i", "j").applyInArrow(_multiply(self.size, self.percent), LINKS), "jaccard-links"))

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members of large clusters with the labels that their pivots gave them, or where there were none, thinned now."""
        if not self.tops:
            return written(relabelled(*self.thinned(members.withColumn("n", F.col("weight")), BLOCK_DOCS)), "jaccard-large")
        rows = members.withColumn("label", F.col("node"))
        for tops in self.tops:
            rows = relabelled(rows, tops)
        mains = rows.groupBy("group").agg(F.min_by("label", F.xxhash64("node")).alias("main"))
        return written(rows.join(mains, "group"), "jaccard-large")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs. With with_key also text_key, xxhash64 of the text.

    Documents link when 100 * intersection >= percent * union of their sets of
    `size`-word shingles (A-Z lower-cased). component_id is the smallest id that
    links reach.

    * null and empty texts, and texts without words, have an empty set and link with nothing
    * fewer words than `size`: the whole sequence is the one shingle
    * rows with equal words link whatever their number; rows that repeat an id are one document: they share a component
    * a null id is carried through without a component unless links reach an id; null ids are documents of their own
    * an empty table gives an empty result; further columns of docs are ignored
    """
    with scope():
        found = _components_of(docs, size, percent, id_col, text_col)
        return written(found if with_key else found.drop("text_key"), "jaccard", keep=True)


def _components_of(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    signed = written(rows.mapInArrow(_signatures(size, percent), SIGNED).withColumn("row", F.monotonically_increasing_id()), "jaccard-signatures")
    filled = signed.where("n > 0")
    classes = written(filled.groupBy("seq").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many")), "jaccard-classes")
    total = classes.agg(F.sum("many")).first()[0] or 0
    own = joined_by_weight(filled.select("doc_id", "text_key", "n", "row", "seq"), classes, ["seq"], "many", total, F.col("row")).select("doc_id", "text_key", "n", "node", "rep")
    found = written(own.unionAll(signed.where("n = 0").select("doc_id", "text_key", "n", F.col("row").alias("node"), F.col("doc_id").alias("rep"))), "jaccard-found")
    nodes = written(in_place(signed, classes.select("node"), total).withColumnRenamed("row", "node"), "jaccard-nodes")
    drop_written(signed)

    # Dealt by bucket once: counted there and joined there, the same at every size.
    buckets = nodes.select("node", "n", F.explode("sigs").alias("group")).where("group is not null").repartition("group")
    # Groups of the same nodes (by number and 128 bits of their hashes) are one group. With n both uses read the same columns, so that Spark deals them once.
    alike = (F.bit_xor(F.xxhash64("node", "n")).alias("x"), F.bit_xor(F.xxhash64("node", "n", F.lit(1))).alias("y"))
    sized = buckets.groupBy("group").agg(F.count(F.lit(1)).alias("many"), *alike).where("many > 1")
    shared = sized.groupBy("many", "x", "y").agg(F.min("group").alias("group")).select("group", "many")
    meets = written(buckets.join(shared, "group"), "jaccard-meets")
    join = _Join(rows, nodes, size, percent)
    join.multiply(join.compare(meets))

    # Rows that repeat an id tie their classes together.
    known = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count(F.lit(1)).alias("times")).where("a <> last")
    ties = known.select("a", "doc_id").join(found.select("doc_id", F.col("node").alias("b")), "doc_id").where("a <> b").select("a", "b").distinct()
    reached = written(components(reduce(DataFrame.unionAll, join.links, ties)), "jaccard-components")
    one = F.lit(1).cast("long").alias("many")
    reps = reached.join(classes.select("node", "rep", "many").unionAll(found.where("n = 0").select("node", "rep", one)), "node")
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = reps.join(least, "component").select("node", "component_id", "many")
    out = joined_by_weight(found, of_node, ["node"], "many", found.count(), F.col("doc_id"), "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
