"""Document likelihood over a subword lattice.

An existing vocabulary of subword pieces spans a lattice over each word. Pieces
have unigram probabilities, counted here over the training documents; the
forward recursion in log space sums over all segmentations, so a document's
score is its marginal probability. Pieces don't cross white space, hence a
document's log probability is the sum over its words, and each distinct word is
worked out once however often it stands in the corpus.

Words travel as tables: each slice of rows (some MB of text) gives its distinct
words and, per document, their local numbers; words are counted over the corpus
and scored by joins on the word, and come back to their slice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, scope, written
from .words import Words, slices, text_buffers

#: Bytes of text whose distinct words are counted together.
SLICE = 8 << 20
#: The mark that begins a word in the vocabulary.
MARK = "▁"


class Lattice:
    """Pieces and their log10 probabilities; bytes stand in for characters without a piece."""

    def __init__(self, model_path: str, counts: dict[int, int], ends: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = sum(counts.values()) + ends + len(usable) + 1
        score = {i: math.log10((counts.get(i, 0) + 1) / total) for i in usable}
        self.end = math.log10((ends + 1) / total)
        self.byte = [0.0] * 256
        self.piece: dict[str, float] = {}
        for i in usable:
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(text[3:5], 16)] = score[i]
            else:
                self.piece[text] = score[i]
        #: What a character costs as bytes (filled as characters come), and every beginning of a piece, with the piece's score where it is one.
        self.chars: dict[str, float] = {}
        self.prefix: dict[str, float | None] = {}
        for text in self.piece:
            for k in range(1, len(text)):
                self.prefix.setdefault(text[:k])
        self.prefix |= self.piece

    def log10(self, word: str) -> float:
        """log10 of the sum over all segmentations of a word, forward from place to place."""
        text, prefix, chars, none = MARK + word, self.prefix, self.chars, 1.0
        n = len(text)
        terms: list[list[float]] = [[0.0]] + [[] for _ in range(n)]
        for i in range(n):
            here = terms[i]
            way = here[0] if len(here) == 1 else _sum_log10(here)
            c = text[i]
            if (p := chars.get(c)) is None:
                p = chars[c] = sum(self.byte[b] for b in c.encode())
            j = i + 1
            terms[j].append(way + p)
            while j <= n and (p := prefix.get(text[i:j], none)) is not none:
                if p is not None:
                    terms[j].append(way + p)
                j += 1
        return _sum_log10(terms[n])


def _sum_log10(terms: list[float]) -> float:
    """log10 of the sum of numbers given by their log10."""
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + math.log10(sum([10 ** (t - top) for t in terms]))


def _slice_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: a slice's words (word, local, train) and its documents (doc_id, held_out, locals)."""
    slice_id = TaskContext.get().partitionId() << 24
    for whole in batches:
        for batch in slices(whole, limit=SLICE):
            words = Words(*text_buffers(batch.column("text")), fold=True)
            first, local = words.distinct()
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            train = np.bincount(local[~held[words.docs()]], minlength=len(first)).astype(np.int64)
            raw = words.data.tobytes()
            text = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
            order = np.argsort(-np.bincount(local, minlength=len(first)), kind="stable")  # frequent words get small numbers
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            local = number[local].astype(np.int32)
            k, n = len(first), batch.num_rows
            nothing = pa.nulls(k, pa.int64())
            bounds = pa.array(words.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, slice_id)), pa.array(text, pa.binary()).cast(pa.string()), pa.array(number.astype(np.int32)), pa.array(train), nothing, pa.nulls(k, pa.bool_()), pa.nulls(k, pa.list_(pa.int32()))],
                names=["slice", "word", "local", "train", "doc_id", "held_out", "locals"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, slice_id)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.ListArray.from_arrays(bounds, pa.array(local))],
                names=["slice", "word", "local", "train", "doc_id", "held_out", "locals"],
            )
            slice_id += 1


def _piece_counts(model_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        total: Counter = Counter()
        for batch in batches:
            often = batch.column("count").to_pylist()
            for pieces, c in zip(model.encode(batch.column("word").to_pylist(), num_threads=1), often):
                for p in pieces:
                    total[p] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["piece", "count"])

    return count


def score_documents(docs: DataFrame, model_path: str, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Tokens are words (A-Z lower-cased) and one end per text. base_score is the
    add-one unigram over tokens, score the lattice model's log10 probability of
    the text; both learn from the rows outside the held fold (crc32 of the id
    modulo folds).

    * null and empty texts are the end alone
    * a null id is held out; rows that repeat an id count each
    * without training rows every token is unknown and pieces are equally likely
    * an empty table gives an empty result; further columns of docs are ignored
    """
    with scope():
        return written(_scores(docs, model_path, folds, held_fold, id_col, text_col), "scores", keep=True)


def _scores(docs: DataFrame, model_path: str, folds: int, held_fold: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == held_fold, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = written(rows.mapInArrow(_slice_words, "slice long, word string, local int, train long, doc_id long, held_out boolean, locals array<int>"), "slices")
    own = cut.where("word is not null").select("slice", "word", "local", "train")
    # Few large slices would fall unevenly on the usual number of partitions.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cut.select("slice").distinct().count())
    texts = cut.where("word is null").select("slice", "doc_id", "held_out", "locals")

    vocabulary = written(own.groupBy("word").agg(F.sum("train").alias("count")), "vocabulary")
    spread = vocabulary.repartition(parts)  # the files are few, the lattices are what takes time
    sums = vocabulary.agg(F.sum("count"), F.sum((F.col("count") > 0).cast("long"))).first()
    ends = texts.where("not held_out").count()
    tokens, kinds = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    pieces = vocabulary.where("count > 0").mapInArrow(_piece_counts(model_path), "piece int, count long").groupBy("piece").agg(F.sum("count").alias("count"))
    lattice = Lattice(model_path, {r["piece"]: r["count"] for r in pieces.collect()}, ends)  # at most one row per piece of the vocabulary file
    shared = spark.sparkContext.broadcast(lattice)
    below = math.log10(tokens + 1 * (kinds + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            count = batch.column("count").to_numpy()
            score = pa.array([model.log10(w) for w in batch.column("word").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(count > 0), pa.array(np.log10(count + 1.0) - below), score], names=["word", "known", "base", "score"])

    weighed = written(spread.mapInArrow(weigh, "word string, known boolean, base double, score double"), "weighed")
    back = written(own.select("slice", "word", "local").join(weighed, "word").select(F.col("slice").alias("part"), "local", "known", "base", "score"), "back")
    end_base = math.log10(ends + 1) - below

    def gather(texts: pa.Table, words: pa.Table) -> pa.Table:
        n = words.num_rows
        known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        local = words.column("local").to_numpy()
        for array, name in ((known, "known"), (base, "base"), (score, "score")):
            array[local] = words.column(name).to_numpy(zero_copy_only=False)
        lists = texts.column("locals").combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        bounds = bounds - bounds[0]
        text = np.repeat(np.arange(texts.num_rows), np.diff(bounds))
        total = lambda values: np.bincount(text, values[flat], texts.num_rows) if len(flat) else np.zeros(texts.num_rows)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"),
            "n_tokens": np.diff(bounds).astype(np.int64) + 1, "n_known": total(known).astype(np.int64) + int(ends > 0),
            "train_tokens": np.full(texts.num_rows, tokens, np.int64),
            "base_score": total(base) + end_base, "score": total(score) + lattice_end,
        })

    lattice_end = lattice.end
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.repartition(parts, "slice").groupBy("slice").cogroup(back.repartition(parts, "part").groupBy("part")).applyInArrow(gather, out)
