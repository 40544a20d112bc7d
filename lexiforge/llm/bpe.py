"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

The leaves of the tree are the adjacent pairs of a piece's symbols, keyed by
(rank, place); each inner node has the smaller key of its two. The root is the
leftmost pair of lowest rank. A merge changes three leaves, and only the nodes
above them are computed anew, until the root holds no pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Pieces whose ids a Python worker remembers, for one vocabulary at a time.
CACHE_PIECES = 300_000
#: Bytes of text coded at once.
SLICE = 512 << 10
#: Fixed value: the pattern that parts text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_PAIR = 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class _Remembered(dict):
    """Ids of pieces, computed on first use; forgotten when there are too many.

    A worker has one: coders of the same vocabulary share it, another
    vocabulary's coder empties it.
    """

    encode, owner = None, None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = out = self.encode(piece)
        return out

    def lent_to(self, coder: ByteBpe) -> _Remembered:
        if self.owner != coder.vocabulary:
            self.clear()
            self.encode, self.owner = coder._piece, coder.vocabulary
        return self


_remembered = _Remembered()


class ByteBpe:
    """Encoder and decoder of one vocabulary file (tokenizers' JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.vocabulary = hashlib.sha256(json.dumps(spec["model"]).encode()).hexdigest()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letter = byte_letters()
        byte_of = {c: b for b, c in letter.items()}
        self.byte_ids = [vocab[letter[b]] for b in range(256)]
        #: (left id, right id) as one number -> (rank, id of the merged symbol)
        self.pairs = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self._prepare()

    def _prepare(self) -> None:
        self.pattern = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @property
    def ids(self) -> _Remembered:
        return _remembered.lent_to(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "split")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge([self.byte_ids[b] for b in piece.encode()]), "<u4").tobytes()

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids left when no adjacent pair can be merged."""
        n, pairs = len(symbols), self.pairs
        if n < 2:
            return symbols
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NO_PAIR] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if found := pairs.get(symbols[i] << 20 | symbols[i + 1]):
                tree[width + i] = found[0] << 32 | i
        for v in range(width - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
        while (best := tree[1]) != NO_PAIR:
            i = best & 0xFFFFFFFF
            j = after[i]
            symbols[i] = pairs[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            changed = [(i, symbols[i] << 20 | symbols[k] if k < n else -1)]
            if j < n - 1:
                changed.append((j, -1))
            if k < n:
                before[k] = i
            if (h := before[i]) >= 0:
                changed.append((h, symbols[h] << 20 | symbols[i]))
            for leaf, pair in changed:
                found = pairs.get(pair)
                key = found[0] << 32 | leaf if found else NO_PAIR
                v = width + leaf
                if v >= 2 * width or tree[v] == key:
                    continue
                tree[v] = key
                v >>= 1
                while v:
                    a, b = tree[2 * v], tree[2 * v + 1]
                    low = a if a < b else b
                    if tree[v] == low:
                        break
                    tree[v] = low
                    v >>= 1
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers."""
        ids = self.ids
        if self.split is None or not any(t in text for t in self.special):
            return b"".join(map(ids.__getitem__, self.pattern.findall(text)))
        parts = []
        for part in self.split.split(text):
            if part in self.special:
                parts.append(self.special[part].to_bytes(4, "little"))
            else:
                parts.extend(map(ids.__getitem__, self.pattern.findall(part)))
        return b"".join(parts)

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids lie between the bounds."""
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.place[ids] - (ends - size), size) + np.arange(total)].tobytes()
        cut = np.concatenate([[0], ends])[bounds].tolist()
        return [self._valid(out[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    @staticmethod
    def _valid(data: bytes) -> bytes:
        return data.decode("utf-8", "replace").encode()


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids and decoded.

    * null and empty texts have no tokens and decode to the empty text
    * special tokens that stand in a text are encoded as such; a very long text is encoded whole
    * a null id is carried through; repeated rows get equal results
    * an empty table gives an empty result; further columns of docs are ignored
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(vocabulary))  # bounded by the vocabulary file
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                coded = [bpe.encode(t) for t in batch.column("text").to_pylist()]
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
                decoded = bpe.decode_many(ids, np.concatenate([[0], np.cumsum(counts)]))
                columns = [batch.column("doc_id"), pa.array(counts), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(t).hexdigest() for t in decoded])]
                if keep:
                    columns += [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())), pa.array([t.decode() for t in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return rows.mapInArrow(code, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")
