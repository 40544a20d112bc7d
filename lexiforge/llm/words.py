"""Words of Arrow text columns as numpy arrays: bounds, hashes, exact numbers and hashes of word sequences.

Words are runs of bytes other than ASCII white space; UTF-8 keeps those bytes
for themselves. A word is read as chunks of eight bytes, each mixed with its
place before they are summed; runs of words are hashed by a tree of mixes. So
no step is linear in what it hashes. Hashes look things up; where equality
decides, words are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

U = np.uint64
#: The bytes of a chunk that belong to a word of which so many are left.
CHUNK_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
GOLDEN = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _seed(n: int) -> np.uint64:
    return _mix(np.array([n * GOLDEN % (1 << 64)], U))[0]


class Words:
    """The words of some texts. first[d] to first[d + 1] are those of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data = FOLD[data] if fold else data
        self.offsets = offsets
        word = IS_WORD[self.data]
        begins, ends = word.copy(), word.copy()
        if len(word):
            begins[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(word))]
            begins[inner] = word[inner]
            ends[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n = len(self.starts)
        self._chunked = None

    def text(self, d: int) -> np.ndarray:
        return self.data[self.offsets[d] : self.offsets[d + 1]]

    def _chunks(self) -> tuple[np.ndarray, ...]:
        """Eight bytes each: value, word, place in the word; and each word's first chunk."""
        if self._chunked is None:
            many = (self.ends - self.starts + 7) >> 3
            first = np.cumsum(many) - many
            word = np.repeat(np.arange(self.n), many)
            place = np.arange(len(word)) - first[word]
            at = self.starts[word] + 8 * place
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            values = np.lib.stride_tricks.as_strided(padded, (len(self.data) + 1, 8), (1, 1))[at].view(U).ravel()
            values &= CHUNK_MASK[np.minimum(self.ends[word] - at, 8)]
            self._chunked = values, word, place, first
        return self._chunked

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One hash per word."""
        values, word, place, first = self._chunks()
        if not len(values):
            return np.zeros(0, U)
        out = _mix(values ^ _seed(seed))
        if len(values) > self.n:
            later = np.flatnonzero(place)
            out[later] = _mix(out[later] + place[later].astype(U) * U(GOLDEN))
            out = np.add.reduceat(out, first)
        out += (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93)
        return _mix(out)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and the kind of every word; words are of a kind when their bytes are equal."""
        _, first, kind = np.unique(self.hashes(), return_index=True, return_inverse=True)
        model, size = first[kind], self.ends - self.starts
        values, word, place, begin = self._chunks()
        other = size != size[model]
        if len(values):
            same = values == values[np.minimum(begin[model][word] + place, len(values) - 1)]
            other |= ~np.logical_and.reduceat(same, begin)
        if other.any():  # a hash that stands for different words
            found: dict = {}
            raw = self.data.tobytes()
            for w in np.flatnonzero(other).tolist():
                kind[w] = found.setdefault(raw[self.starts[w] : self.ends[w]], (len(first) + len(found), w))[0]
            first = np.append(first, [w for _, w in found.values()])
        return first, kind

    def docs(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def sequences(self) -> list[bytes]:
        """Each text's words joined by one blank."""
        word = IS_WORD[self.data]
        keep = word.copy()
        keep[1:] |= word[:-1]  # the first byte after a word
        at = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[self.offsets].tolist()
        raw = np.where(word, self.data, np.uint8(32))[keep].tobytes()
        return [raw[a:b].strip(b" ") for a, b in zip(at[:-1], at[1:])]


class Runs:
    """Hashes of runs of consecutive words, from hashes of 1, 2, 4, ... words."""

    def __init__(self, hashes: np.ndarray, seed: int = 1):
        self.levels, self.key = [hashes], _seed(seed + 1000)

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            out = low[:-half] * U(0xA0761D6478BD642F)
            out += low[half:]
            out ^= self.key
            self.levels.append(_mix(out))
        return self.levels[k]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each run, from the two runs of a power of two that cover it."""
        size = ends - starts
        out = np.zeros(len(size), U)
        power = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(power).tolist():
            these = slice(None) if (power == k).all() else np.flatnonzero(power == k)
            level = self._level(k)
            part = level[starts[these]] * U(0xE7037ED1A0B428DB)
            part += level[ends[these] - (1 << k)]
            out[these] = part
        out += size.astype(U) * U(0x2545F4914F6CDD1D)
        return _mix(out)


def _shingle_places(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the first word of every shingle; a text of fewer words is one shingle, one without words none."""
    counts = np.diff(words.first)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, words.first[:-1][doc] + within


def _sets(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(docs + 1))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, and where each text's begin.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    doc, starts = _shingle_places(words, size)
    values = Runs(words.hashes()).of(starts, np.minimum(starts + size, words.first[1:][doc]))
    return _sets(values, doc, len(words.first) - 1)


def exact_shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets(), with numbers that are equal only where all words are."""
    doc, starts = _shingle_places(words, size)
    _, kind = words.distinct()
    kind = np.append(kind + 1, 0)  # 0: no word
    kinds, last = int(kind.max()) + 1, words.first[1:][doc]
    values = np.zeros(len(doc), np.int64)
    for i in range(size):
        at = np.where(starts + i < last, starts + i, words.n)
        values = np.unique(values * kinds + kind[at], return_inverse=True)[1]
    return _sets(values, doc, len(words.first) - 1)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, or a single row."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()
