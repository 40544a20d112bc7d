"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed against it into phrases, each the longest match that the automaton
allows; the language that needs the fewest phrases, normalised by what a phrase
costs (the log of the labelled text's length), wins.

The automata become one table of transitions, in which each language has a state
between phrases. Every move out of it starts a phrase; elsewhere a missing
transition ends the phrase and starts the next one where the same symbol leads
from the root. A symbol that the language lacks is a phrase of its own and leads
back between phrases. So parsing is one table lookup per symbol and language;
numpy takes that step for thousands of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import id_crc, written
from .words import slices, text_buffers

#: Labelled documents per language, the most taken of each, and the most of all together: the bound of the fitted sample.
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 64, 4000, 25_600_000
#: Symbols of each language's automaton, and of all together; many languages get the fewer each.
TRAIN_SYMBOLS, ALL_SYMBOLS = 30_000, 240_000
#: Languages whose draws are broadcast at most (docs_per_language short rows each).
BROADCAST_LANGUAGES = 1000
UNKNOWN = "und"
#: A text is parsed in pieces of this many bytes, side by side.
PIECE = 1024
#: Bytes of text parsed at once.
SLICE = 1 << 20


def suffix_automaton(symbols: Sequence[int], n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence; -1 where there is none."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        state, p = len(following), last
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    table = np.full((len(following), n_symbols), -1, np.int32)
    for s, moves in enumerate(following):
        for c, to in moves.items():
            table[s, c] = to
    return table


class CrossParser:
    """Automata of all languages in one table: (next state * symbols) * 2 + starts a phrase."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        seen = np.zeros(256, bool)
        for t in texts.values():
            seen[np.frombuffer(_letters(np.frombuffer(t, np.uint8)), np.uint8)] = True
        used = [b for b in range(256) if seen[b] and b != 32]
        self.symbol = np.zeros(256, np.uint8)  # 0: bytes that no language shows, and what parts words
        for i, b in enumerate(used):
            self.symbol[b] = i + 2
        self.symbol[32] = 1
        n = len(used) + 2
        parts, self.roots, self.cost, base = [], [], [], 0
        most = max(1, min(TRAIN_SYMBOLS, ALL_SYMBOLS // max(1, len(texts))))
        for lang in self.languages:
            data = self.symbol[_letters(np.frombuffer(texts[lang], np.uint8))][:most]
            table = suffix_automaton(data.tolist(), n).astype(np.int64)
            between = len(table)
            first = np.where(table[0] < 0, between, table[0])
            missing = np.vstack([table < 0, np.ones((1, n), bool)])
            move = np.where(missing, first[None, :], np.vstack([table, first[None, :]]))
            parts.append(((move + base) * n * 2 + missing).astype(np.int32))
            self.roots.append((base + between) * n)
            self.cost.append(np.log2(max(2, len(data))))
            base += between + 1
        self.moves = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        self.roots, self.cost = np.array(self.roots, np.int32), np.array(self.cost)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases needed by each text (rows) in each language (columns), each piece parsed greedily by itself."""
        symbols = self.symbol[_letters(data)]
        size = np.diff(offsets)
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][text] + nth * PIECE
        end = np.minimum(start + PIECE, offsets[1:][text])
        order = np.argsort(start - end, kind="stable")  # longest first
        text, start, end = text[order], start[order], end[order]
        length = end - start
        k = len(self.languages)
        state = np.repeat(self.roots[:, None], len(start), 1)
        count = np.zeros((k, len(start)), np.int32)
        active = len(start)
        for step in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= step:
                active -= 1
            at = state[:, :active]
            at += symbols[start[:active] + step][None, :]
            move = self.moves[at]
            count[:, :active] += move & 1
            state[:, :active] = move >> 1
        out = np.zeros((len(size), k))
        for lang in range(k):
            out[:, lang] = np.bincount(text, count[lang], len(size))
        return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of letters; one blank for each other ASCII byte."""
    if "table" not in _letters.__dict__:
        table = np.arange(256, dtype=np.uint8)
        table[:128] = 32
        table[65:91] = table[97:123] = np.arange(97, 123)
        _letters.table = table
    return _letters.table[data]


def labelled_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> dict[str, bytes]:
    """Text per language from the given labelled rows (doc_id, text, lang).

    Each language's rows fall into docs_per_language hash buckets, and each
    bucket gives one row, that of its smallest hash: at most docs_per_language
    texts of max_chars characters per language reach the driver, and fewer
    characters of each where languages are many. Of a longer text that is a
    piece at a hashed place, or from its first letter on where that piece has
    none. Every labelled language is learned.
    """
    draw = F.xxhash64("doc_id", F.lit("language sample"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", "doc_id", draw.alias("draw"), F.pmod(draw, F.lit(docs_per_language)).alias("bucket"))
    first = written(rows.groupBy("lang", "bucket").agg(F.min("draw").alias("draw")), "language-sample")
    languages = first.select("lang").distinct().count()
    chars = max(1, min(max_chars, all_chars // max(1, languages * docs_per_language)))
    place = F.pmod(F.xxhash64("draw", F.lit("place")), F.greatest(F.lit(1), F.char_length("text") - chars + 1)) + 1
    piece = lambda at: F.substring("text", at.cast("int"), F.lit(chars))
    text = F.when(F.char_length("text") <= chars, F.col("text")).when(piece(place).rlike(r"\p{L}"), piece(place)).otherwise(F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, chars))
    drawn = rows.join(F.broadcast(first) if languages <= BROADCAST_LANGUAGES else first, ["lang", "bucket", "draw"])
    found = drawn.groupBy("lang", "bucket").agg(F.min(F.struct("doc_id", text.alias("text"))).alias("row")).select("lang", "bucket", "row.text")  # a repeated id has one draw
    out: dict[str, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["bucket"])):
        out.setdefault(r["lang"], []).append(r["text"])
    lower = lambda texts: b"\n".join(t.encode() for t in pc.utf8_lower(pa.array(texts, pa.string())).to_pylist())
    return {lang: lower(texts) for lang, texts in out.items()}


def judge(model: CrossParser, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row (text, lettered)."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
    if not model.languages:
        best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
    else:
        bits = model.phrases(*text_buffers(pc.utf8_lower(batch.column("text")).fill_null(""))) * model.cost
        best = np.argmin(bits, 1)
        gap = bits - bits[np.arange(len(best)), best][:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
    best = np.where(lettered & (len(model.languages) > 0), best, len(names) - 1)
    return names[best], np.where(lettered, score, 0.0)


def predict(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, lang_pred, score of rows (doc_id, text)."""
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(parser)  # bounded by ALL_SYMBOLS
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                names, score = judge(kept.value, batch)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(parse, f"doc_id {id_type.simpleString()}, lang_pred string, score double")


def keep_languages(docs: DataFrame, wanted=None, sure: float = 0.99, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """The rows of documents that the prediction lets pass, all columns as they are but for `lang`.

    A document goes when its text has no letter, when its predicted language is
    not among those wanted (None: any), or when the prediction contradicts its
    label with a score of at least `sure`. A document without a label takes the
    predicted one. Predicts like identify_languages(), whose cases hold here
    too; nothing is shuffled. Where nothing is labelled, every text with a
    letter stays as it is. docs needs doc_id, text and lang.
    """
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(True))
    parser = CrossParser(labelled_sample(docs.where(~held).select("doc_id", "text", "lang")))
    kept = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by ALL_SYMBOLS
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for whole in batches:
            row = whole.column("row")
            named = pa.RecordBatch.from_arrays([row, whole.column("lettered"), pc.struct_field(row, [text]), pc.struct_field(row, [lang])], names=["row", "lettered", "text", "lang"])
            for batch in slices(named, limit=SLICE):
                names, score = judge(model, batch)
                good = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    label = batch.column("lang").to_numpy(zero_copy_only=False)
                    bare = np.array([x is None for x in label], bool)
                    good &= bare | (names == label) | (score < sure)
                    if wanted is not None:
                        good &= np.isin(names.astype(str), list(wanted))
                pred = pa.array(np.where(good & bool(model.languages), names, None), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pred], names=["row", "pred"]).filter(pa.array(good))

    out = whole.mapInArrow(choose, StructType([StructField("row", whole.schema["row"].dataType), StructField("pred", StringType())]))
    return out.select(*(F.coalesce(F.col("row.lang"), F.col("pred")).alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def identify_languages(docs: DataFrame, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs.

    Learns from labelled rows outside the held fold (crc32 of the id modulo
    folds), by labelled_sample(). The score is the winner's share of the
    languages' probabilities 2 ** -bits.

    * a text that is null or has no letter is `und` with score 0, as is every text when nothing is labelled
    * ties go to the first language in code-point order; a very long text is parsed whole, in pieces
    * a null id is held out; repeated rows get equal results
    * an empty table gives an empty result; further columns of docs are ignored
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(True))
    parser = CrossParser(labelled_sample(rows.where(~held)))
    return predict(rows, parser).select("doc_id", held.alias("held_out"), "lang_pred", "score")
