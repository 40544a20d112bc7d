"""Alignment of two tokenizers over one text.

Both tokenizers cover the same bytes (a space and the text), so their tokens are
compared by byte offsets: ends are cumulative sums of token lengths, the ends
both share cut the text into groups, and two tokens are linked where their byte
ranges overlap. All documents of a slice are laid end to end; since every
document ends in a common cut, one pass of numpy serves the whole slice.

Links are counted per pair of ids over the corpus: each slice brings one row per
pair it holds, and those are summed in two shuffles, the first salted. The
counts come back to their slice by a join on the pair, so no table of pairs is
ever held whole by a task or the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, byte_letters
from .common import joined_by_weight, scope, written
from .words import slices, text_buffers

#: Bytes of text tokenised at once, and bytes whose pairs are counted together.
PART, SLICE = 256 << 10, 8 << 20
#: Salts of a pair in the first of the two sums.
SALTS = 16
#: Rows that a plain join takes, however they fall on keys.
FEW = 100_000
#: An id pair as one number: A's id times this, plus B's id.
PAIR = 1 << 24
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _Flat:
    """Strings of bytes by number, laid end to end: joins of many are gathers."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items) or b"\0", np.uint8)
        self.size = np.array([len(t) for t in items], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def joined(self, which: np.ndarray) -> np.ndarray:
        """The bytes of the items, one after the other."""
        size = self.size[which]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Numbers:
    """Decimal numbers as rows of bytes with room for a mark behind the digits."""

    def __init__(self, count: int):
        width = len(str(count - 1)) + 1
        self.size = np.array([len(str(i)) for i in range(count)], np.int32)
        self.digits = np.array([list(str(i).ljust(width).encode()) for i in range(count)], np.uint8)
        self.used = np.arange(width)[None, :] <= self.size[:, None]

    def joined(self, which: np.ndarray, marks: np.ndarray) -> bytes:
        """Each number and its mark."""
        rows = self.digits[which]
        rows[np.arange(len(which)), self.size[which]] = marks
        return rows[self.used[which]].tobytes()


class TokenPair:
    """Tokenizer A (byte-level BPE, JSON) and B (sentencepiece model), from the contents of their files."""

    def __init__(self, spec: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        model_a = json.loads(spec)["model"]
        vocab, merges = model_a["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model_a["merges"]]
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made) or any(i > made[0] for t, i in vocab.items() if len(t) == 1 and t in byte_of):
            raise ValueError("the ids of A's merges are not in their order")
        # Where ids are in the order of the merges they are the ranks themselves; so the file's own vocabulary runs in the faster coder.
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i >= made[0] and i <= made[-1]}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        of_id = {i: t for t, i in ranks.items()}
        self.bytes_a = _Flat([of_id.get(i, b"") for i in range(max(of_id) + 1)])
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = _Flat([piece(i) for i in range(self.b.get_piece_size())])
        self.names = _Numbers(max(len(self.bytes_a.size), len(self.bytes_b.size)))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where a text is empty or the joined bytes of either are not a space and the text."""
        spaced = [" " + t for t in texts]
        a = [self.a.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in spaced]
        b = [np.array(i, np.int32) for i in self.b.encode(texts, num_threads=1)]
        want = [t.encode() for t in spaced]
        given = [self._split(flat, ids, want) for flat, ids in ((self.bytes_a, a), (self.bytes_b, b))]
        none = np.zeros(0, np.int32)
        for k, text in enumerate(texts):
            if not text or given[0][k] != want[k] or given[1][k] != want[k]:
                a[k] = b[k] = none
        return a, b

    @staticmethod
    def _split(flat: _Flat, ids: list[np.ndarray], want: list[bytes]) -> list[bytes]:
        """The joined bytes of each text's tokens; where all agree with what is wanted, that."""
        every = np.concatenate([np.zeros(0, np.int32), *ids])
        joined, upto = flat.joined(every).tobytes(), np.concatenate([[0], np.cumsum(flat.size[every])])
        cut = upto[np.cumsum([0, *map(len, ids)])].tolist()
        if joined == b"".join(want) and cut == np.cumsum([0, *map(len, want)]).tolist():
            return want
        return [joined[i:j] for i, j in zip(cut[:-1], cut[1:])]


_loaded: dict[str, TokenPair] = {}


def _pair(files: tuple[bytes, bytes]) -> TokenPair:
    """The worker's tokenizers: one pair at a time is kept."""
    key = hashlib.sha256(b"".join(hashlib.sha256(f).digest() for f in files)).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TokenPair(*files)
    return _loaded[key]


def aligned(pair: TokenPair, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray]:
    """Counts of each text, the digest of its groups, and the pair numbers of its links, texts laid end to end."""
    counts_a, counts_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int32), *side]) for side in (a, b))
    ends_a, ends_b = np.cumsum(pair.bytes_a.size[ids_a]), np.cumsum(pair.bytes_b.size[ids_b])
    starts_a, starts_b = ends_a - pair.bytes_a.size[ids_a], ends_b - pair.bytes_b.size[ids_b]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)

    # B tokens that overlap an A token are consecutive.
    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    many = high - low
    of_b = np.repeat(low - (np.cumsum(many) - many), many)
    of_b += np.arange(len(of_b))
    links = np.repeat(ids_a.astype(np.int64) * PAIR, many) + ids_b[of_b]

    doc_a = np.repeat(np.arange(len(a)), counts_a)
    first_a = np.concatenate([[0], np.cumsum(counts_a)])
    last = np.concatenate([[-1], group_a])[first_a]  # the last group of all texts up to here
    out = {"n_a": counts_a, "n_b": counts_b, "n_groups": np.diff(last), "n_links": np.bincount(doc_a, many, len(a)).astype(np.int64)}

    # The groups as text: each token's number and a mark, A's tokens of a group before B's.
    n_groups = len(cuts)
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_a, before_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + (before_a + per_a)[group_b]
    stream, mark = np.empty(len(ids_a) + len(ids_b), np.int32), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    stream[place_a], stream[place_b] = ids_a, ids_b
    mark[before_a + per_a + before_b - 1] = ord("|")
    mark[before_a + per_a + before_b + per_b - 1] = ord(";")
    bounds = np.concatenate([[0], np.cumsum(pair.names.size[stream] + 1, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts_a + counts_b)])].tolist()
    raw = pair.names.joined(stream, mark)
    digests = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:])]
    return out, digests, links


_CUT = "slice long, pair long, local int, n long, parts array<struct<doc_id:{id}, n_a:long, n_b:long, n_groups:long, n_links:long, groups_sha256:string>>, links binary"


def _cut(files, id_type: pa.DataType):
    """Two kinds of rows: a slice's pairs (pair, local number, links), and parts of it (documents and the packed local numbers of their links)."""
    record = pa.struct([("doc_id", id_type), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())])
    kinds = [("slice", pa.int64()), ("pair", pa.int64()), ("local", pa.int32()), ("n", pa.int64()), ("parts", pa.list_(record)), ("links", pa.binary())]

    def rows(size: int, **columns) -> pa.RecordBatch:
        arrays = [columns[c] if c in columns else pa.nulls(size, kind) for c, kind in kinds]
        return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in kinds])

    def ended(number: int, held: list) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([links for _, links in held])
        pairs, local, n = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent pairs get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        k = len(pairs)
        yield rows(k, slice=pa.array(np.full(k, number)), pair=pa.array(pairs), local=pa.array(rank), n=pa.array(n.astype(np.int64)))
        local, at = rank[local], 0
        for documents, links in held:
            packed = pa.compress(local[at : at + len(links)].tobytes(), "zstd", asbytes=True)
            at += len(links)
            parts = pa.ListArray.from_arrays(pa.array([0, len(documents)], pa.int32()), documents)
            yield rows(1, slice=pa.array([number], pa.int64()), parts=parts, links=pa.array([packed], pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(files.value), TaskContext.get().partitionId() << 24
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, limit=PART):
                counts, digests, links = aligned(pair, *pair.encode(batch.column("text").to_pylist()))
                fields = [batch.column("doc_id").cast(id_type), *(pa.array(counts[c]) for c in COUNTS), pa.array(digests, pa.string())]
                held.append((pa.StructArray.from_arrays(fields, fields=list(record)), links))
                size += len(text_buffers(batch.column("text"))[0])
                if size >= SLICE:
                    yield from ended(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from ended(number, held)

    return cut


def align_tokens(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level BPE of a tokenizers JSON file over a space and the text,
    B a sentencepiece model over the text. n_best counts the links whose pair of
    ids is linked as often over the corpus as any pair of their B id, count_sum
    sums those numbers over links.

    * null and empty texts, and texts that the tokens of A or B don't give back byte by byte, have zeros and an empty digest
    * strings of special tokens are ordinary text; a very long text is tokenised whole
    * a null id is carried through; rows that repeat an id count each, also in the corpus counts
    * ties for the highest count are all best; an empty table gives an empty result; further columns of docs are ignored
    """
    with scope():
        return written(_aligned(docs, json_path, model_path, id_col, text_col), "token-links", keep=True)


def _aligned(docs: DataFrame, json_path: str, model_path: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(json_path).read_bytes(), Path(model_path).read_bytes()))  # two vocabulary files
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = written(rows.mapInArrow(_cut(files, pa.int64()), _CUT.format(id="long")), "links")
    own = cut.where("pair is not null").select("slice", "pair", "local", "n")
    parts = cut.where("pair is null").select("slice", "parts", "links")

    salted = own.groupBy("pair", F.pmod(F.col("slice"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    counted = written(salted.groupBy("pair").agg(F.sum("n").alias("count"), F.sum("held").alias("held")), "pairs")
    side_b = F.pmod(F.col("pair"), F.lit(PAIR)).alias("b")
    highest = counted.groupBy(side_b).agg(F.max("count").alias("most"))
    judged = counted.withColumn("b", side_b).join(F.broadcast(highest), "b")  # one row per piece of B's vocabulary
    judged = judged.select("pair", "count", (F.col("count") == F.col("most")).alias("best"), "held")
    total = counted.agg(F.sum("held")).first()[0] or 0
    back = joined_by_weight(own.select("slice", "pair", "local"), judged, ["pair"], "held", total, F.col("slice"), least=FEW)
    back = back.select(F.col("slice").alias("_slice"), "local", "count", "best")

    def gather(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        local = pairs.column("local").to_numpy()
        count[local], best[local] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        out = []
        for listed, packed in zip(texts.column("parts"), texts.column("links")):
            documents = listed.values
            ends = np.concatenate([[0], np.cumsum(documents.field("n_links").to_numpy())])
            links = np.frombuffer(pa.decompress(packed.as_buffer(), int(ends[-1]) * 4, "zstd", asbytes=True), np.int32) if ends[-1] else np.zeros(0, np.int32)
            summed = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[links])])[ends])
            columns = {c: documents.field(c) for c in ("doc_id", *COUNTS)}
            out.append(pa.table(columns | {"n_best": summed(best), "count_sum": summed(count), "groups_sha256": documents.field("groups_sha256")}))
        return pa.concat_tables(out)

    longs = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS, "n_best", "count_sum"))
    return parts.groupBy("slice").cogroup(back.groupBy("_slice")).applyInArrow(gather, f"{longs}, groups_sha256 string")
