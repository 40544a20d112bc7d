"""Spans over texts: sentences, chunks, cued units, marked entries, suppression of overlaps.

Offsets are in code points, so the span finders are small Python helpers that
run over Arrow batches; what follows them is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .joins import band_join
from .windows import first_of, top_k

SPANS = "array<struct<start:int,end:int,part:string,gap:string>>"
_SENTENCE = re.compile(r"[.!?…;:]+(?=\s|$)")
_LINE = re.compile(r"(?m)^[^\S\n]*(?=\S)")


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Sentences end after closing marks before white space; blanks between them belong to none."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.end() if m else len(text)
        while at < end and text[at].isspace():
            at += 1
        if at < end:
            out.append((at, end))
        at = end
    return out


def chunk_bounds(text: str, most: int = 300, overlap: int = 50) -> list[tuple[int, int]]:
    """Overlapping chunks that prefer to end at a sentence end, else at the last blank beyond a third."""
    if most <= overlap or overlap < 0:
        raise ValueError("a chunk must be longer than its overlap")
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            part = text[at:end]
            stops = [m.end() for m in _SENTENCE.finditer(part) if m.end() > most // 3]
            blank = part.rfind(" ")
            end = at + (stops[-1] if stops else blank if blank > most // 3 else most)
        out.append((at, end))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def _listed(counts: list[int], **columns) -> pa.Array:
    """A list array of structs, from the number of structs up to each row and flat columns."""
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


#: Rows that a walk over texts hands on at once.
FLUSH = 10_000
_TYPES = {"int": (IntegerType(), pa.int32()), "string": (StringType(), pa.string()), "boolean": (BooleanType(), pa.bool_()), "strings": (ArrayType(StringType()), pa.list_(pa.string()))}


def walked(df: DataFrame, text: str, find, keep: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """keep, and a row for each tuple that find gives for a text, its columns by kinds (name to type).

    Rows are handed on as they come, so a worker holds a few thousand of them,
    and never those of all texts that it was given at once.
    """
    given = df.select(*keep, F.col(text).alias("_text"))
    fields = [f for f in given.schema.fields if f.name != "_text"]
    schema = StructType(fields + [StructField(name, _TYPES[kind][0]) for name, kind in kinds.items()])
    names, types = schema.names, [_TYPES[kind][1] for kind in kinds.values()]

    def walk(batches):
        for batch in batches:
            own, texts = batch.columns[:-1], batch.columns[-1]

            def table(owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
                at = pa.array(owners, pa.int64())
                return pa.RecordBatch.from_arrays([c.take(at) for c in own] + [pa.array(c, kind) for c, kind in zip(zip(*rows), types)], names=names)

            owners, rows = [], []
            for i in range(batch.num_rows):
                for row in find(texts[i].as_py() or ""):
                    owners.append(i)
                    rows.append(row)
                    if len(rows) == FLUSH:
                        yield table(owners, rows)
                        owners, rows = [], []
            if rows:
                yield table(owners, rows)

    return given.mapInArrow(walk, schema)


def _spans(find) -> Column:
    """Bounds, text and the text up to the next span, for each span of a finder."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        start, end, part, gap, counts = [], [], [], [], [0]
        for t in texts.to_pylist():
            found = find(t or "")
            for (a, b), (c, _) in zip(found, [*found[1:], (0, 0)]):
                start.append(a)
                end.append(b)
                part.append(t[a:b])
                gap.append(t[b:c])
            counts.append(len(start))
        return _listed(counts, start=pa.array(start, pa.int32()), end=pa.array(end, pa.int32()), part=pa.array(part, pa.string()), gap=pa.array(gap, pa.string()))

    return spans


def exploded(df: DataFrame, text: str, find, keep: Sequence[str], gap: bool = False) -> DataFrame:
    """keep, ord, start, end, part (and gap): the spans of a finder, one row each; the text itself isn't carried along."""
    rows = df.select(*keep, F.posexplode(_spans(find)(F.col(text))).alias("ord", "s"))
    return rows.select(*keep, "ord", "s.start", "s.end", "s.part", *(["s.gap"] if gap else []))


def sentences(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return exploded(df, text, sentence_bounds, keep)


def chunks(df: DataFrame, text: str, keep: Sequence[str], most: int = 300, overlap: int = 50) -> DataFrame:
    return exploded(df, text, lambda t: chunk_bounds(t, most, overlap), keep)


def target_sentence(df: DataFrame, text: str, term: Column, keep: Sequence[str]) -> DataFrame:
    """The sentence with a term's first hit, and whether it touches the text's edges."""
    marked = df.withColumn("_hit", F.instr(F.lower(F.col(text)), term) - 1).withColumn("_len", F.char_length(text))
    rows = sentences(marked, text, [*keep, "_hit", "_len"])
    found = rows.where("start <= _hit and _hit < end")
    return found.select(*keep, "part", (F.col("start") == 0).alias("cut_left"), (F.col("end") == F.col("_len")).alias("cut_right"))


def unit_starts(text: str) -> list[int]:
    """Where a unit may begin: at the first letter of a sentence or of a line."""
    starts = {a for a, _ in sentence_bounds(text)}
    starts.update(m.end() for m in _LINE.finditer(text))
    return sorted(starts)


def compiled_cues(cues: dict[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(k, re.compile(rf"(?:{p})(?!\w)", re.I)) for k, p in cues.items()]


def cue_places(text: str, cues: Sequence[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """Start, end and kind of the cue at each unit start that has one: the longest, then the first in order."""
    out = []
    for a in unit_starts(text):
        hits = [(m.end(), k) for k, p in cues if (m := p.match(text, a))]
        if hits:
            out.append((a, *max(hits, key=lambda h: h[0])))
    return out


def cue_units(df: DataFrame, text: str, cues: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Units from one cue at the start of a sentence or line to the next: start, end, kind, cue_end; with the text's cue density per 10,000 characters.

    cues maps a kind to a pattern of whole words, whatever the case.
    """
    compiled = compiled_cues(cues)

    @F.arrow_udf("array<struct<start:int,cue_end:int,kind:string>>")
    def find(texts: pa.Array) -> pa.Array:
        flat, counts = [], [0]
        for t in texts.to_pylist():
            flat += cue_places(t or "", compiled)
            counts.append(len(flat))
        start, end, kind = zip(*flat) if flat else ((),) * 3
        return _listed(counts, start=pa.array(start, pa.int32()), cue_end=pa.array(end, pa.int32()), kind=pa.array(kind, pa.string()))

    rows = df.select(*keep, F.char_length(text).alias("_len"), find(F.col(text)).alias("_c")).withColumn("density", F.round(F.size("_c") * 10000 / F.greatest("_len", F.lit(1)), 3))
    flat = rows.select(*keep, "_len", "density", F.posexplode("_c").alias("ord", "c"))
    end = F.coalesce(F.lead("c.start").over(W.partitionBy(*keep).orderBy("ord")), F.col("_len"))
    return flat.select(*keep, "ord", "c.start", end.alias("end"), "c.kind", "density", "c.cue_end")


def trusted_units(units: DataFrame, kinds: Sequence[str], density: float = 2.0) -> DataFrame:
    """Units of trusted kinds in texts that are dense in cues."""
    return units.where((F.col("density") >= density) & F.col("kind").isin(*kinds))


def profile(units: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Per text: units, density and dominant kind (ties: first in order)."""
    counts = units.groupBy(*keep, "density", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(W.partitionBy(*keep).orderBy(F.desc("n"), "kind"))
    total = F.sum("n").over(W.partitionBy(*keep))
    return counts.withColumn("units", total).withColumn("_r", best).where("_r = 1").select(*keep, "units", "density", F.col("kind").alias("dominant"))


class _Entries(HTMLParser):
    """One walk over markup: text, and where headings and list items begin in it."""

    SKIP = {"script", "style", "note"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.size, self.skipping, self.marks = [], 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in self.SKIP
        if re.fullmatch(r"h[1-6]|li|b|head|p", tag):
            self.marks.append((self.size, tag))

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skipping:
            self.skipping -= 1

    def handle_data(self, data):
        if not self.skipping and data.strip():
            piece = " ".join(data.split()) + " "
            self.out.append(piece)
            self.size += len(piece)


def rendered(markup: str) -> tuple[str, list[tuple[int, str]]]:
    """Text of markup and the offsets of its marks, in one walk."""
    walker = _Entries()
    walker.feed(markup)
    return "".join(walker.out), walker.marks


def markup_entries(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """keep, ord, start, end, tag, head: stretches of rendered text from one mark to the next."""

    @F.arrow_udf("array<struct<start:int,end:int,tag:string,head:string>>")
    def walk(pages: pa.Array) -> pa.Array:
        start, end, tag, head, counts = [], [], [], [], [0]
        for page in pages.to_pylist():
            text, marks = rendered(page or "")
            for (a, k), (b, _) in zip(marks, [*marks[1:], (len(text), "")]):
                start.append(a)
                end.append(b)
                tag.append(k)
                head.append(text[a:b].strip(" "))
            counts.append(len(start))
        return _listed(counts, start=pa.array(start, pa.int32()), end=pa.array(end, pa.int32()), tag=pa.array(tag, pa.string()), head=pa.array(head, pa.string()))

    return df.select(*keep, F.posexplode(walk(F.col(html))).alias("ord", "m")).select(*keep, "ord", "m.start", "m.end", "m.tag", "m.head")


def markup_sections(df: DataFrame, html: str, keep: Sequence[str], marks: str = ".:") -> DataFrame:
    """keep, ord, start, end, level, head, path, carriers, anchors: the sections that headings declare.

    A section runs to the next heading of its own or an upper level; path joins
    the heads above it and its own. carriers counts the elements that hold its
    text (up to the next heading) by tag, anchors lists the terms that begin
    such an element in bold, and rubrics its stretches in italics, without
    `marks` at their ends, each where it differs from the one before.
    """
    def walk(page: str):
        size, found = _Elements.of(page, marks)
        for i, m in enumerate(found):
            yield size, i, m["start"], m["tag"], m["text"], m["bold"], m["italic"]

    rows = walked(df, html, walk, keep, {"size": "int", "ord": "int", "start": "int", "tag": "string", "text": "string", "bold": "string", "italic": "strings"})
    upto = W.partitionBy(*keep).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("tag").rlike("^h[1-6]$")
    level = F.when(heading, F.substring("tag", 2, 1).cast("int"))
    rows = rows.withColumn("level", level).withColumn("_section", F.sum(heading.cast("int")).over(upto))
    inside = rows.where(~heading & F.col("tag").isin("p", "li", "td")).groupBy(*keep, "_section").agg(
        F.array_sort(F.collect_list(F.struct("ord", "tag", "bold", "italic"))).alias("_e")
    )
    # The heads above: for every level the last heading of it since the last one of an upper level.
    heads = rows.where(heading).withColumn("head", F.trim("text"))
    following = W.partitionBy(*keep).orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    ends = F.coalesce(*[F.when(F.col("level") == n, F.min(F.when(F.col("level") <= n, F.col("start"))).over(following)) for n in range(1, 7)], F.col("size"))
    before = W.partitionBy(*keep).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    heads = heads.withColumn("end", ends)
    for n in range(1, 7):
        heads = heads.withColumn(f"_h{n}", F.last(F.when(F.col("level") == n, F.struct("ord", "head")), ignorenulls=True).over(before))
        heads = heads.withColumn(f"_u{n}", F.last(F.when(F.col("level") < n, F.col("ord")), ignorenulls=True).over(before))
    above = F.array_compact(F.array(*(F.when((F.col("level") >= n) & (F.coalesce(F.col(f"_u{n}"), F.lit(-1)) < F.col(f"_h{n}.ord")) | (F.col("level") == n), F.col(f"_h{n}.head")) for n in range(1, 7))))
    out = heads.withColumn("path", F.array_join(above, " / ")).join(inside, [*keep, "_section"], "left")
    tags = F.transform(F.array(F.lit("p"), F.lit("li"), F.lit("td")), lambda t: F.struct(t.alias("tag"), F.coalesce(F.size(F.filter("_e", lambda e: e["tag"] == t)), F.lit(0)).alias("n")))
    carriers = F.array_join(F.transform(F.filter(tags, lambda x: x["n"] > 0), lambda x: F.concat_ws("=", x["tag"], x["n"].cast("string"))), ",")
    anchors = F.array_compact(F.transform("_e", lambda e: e["bold"]))
    italics = F.flatten(F.transform("_e", lambda e: e["italic"]))
    rubrics = F.transform(F.filter(F.arrays_zip(italics.alias("now"), F.concat(F.array(F.lit(None).cast("string")), italics).alias("last")), lambda p: p["now"].isNotNull() & ~p["now"].eqNullSafe(p["last"])), lambda p: p["now"])
    none = F.array().cast("array<string>")
    return out.select(*keep, "ord", "start", "end", "level", "head", "path", carriers.alias("carriers"), F.coalesce(anchors, none).alias("anchors"), F.coalesce(rubrics, none).alias("rubrics"))


class _Elements(HTMLParser):
    """One walk over markup: headings and content elements with their places in the rendered text."""

    CONTENT = {"p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6"}
    STYLE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic"}
    SKIP = {"script", "style", "note"}

    def __init__(self, marks: str):
        super().__init__(convert_charrefs=True)
        self.edges = marks + " "
        self.size, self.skipping, self.found = 0, 0, []
        self.pieces = self.style = None

    @classmethod
    def of(cls, markup: str, marks: str) -> tuple[int, list[dict]]:
        walker = cls(marks)
        walker.feed(markup)
        return walker.size, [walker.told(*f) for f in walker.found]

    def told(self, start: int, tag: str, pieces: list[tuple[str, str | None]]) -> dict:
        """An element from its stretches of text and their styles."""
        leads = pieces[0][0] if pieces and pieces[0][1] == "bold" else None
        italics = [stretch.strip(self.edges) for stretch, style in pieces if style == "italic"]
        return {"start": start, "tag": tag, "text": " ".join(p for p, _ in pieces), "bold": leads, "italic": [x for x in italics if x]}

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in self.SKIP
        if tag in self.CONTENT:
            self.pieces = []
            self.found.append((self.size, tag, self.pieces))
        self.style = self.STYLE.get(tag, self.style)

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping = max(0, self.skipping - 1)
        if tag in self.CONTENT:
            self.pieces = None
        if tag in self.STYLE:
            self.style = None

    def handle_data(self, data):
        stretch = " ".join(data.split())
        if stretch and not self.skipping:
            if self.pieces is not None:
                self.pieces.append((stretch, self.style))
            self.size += len(stretch) + 1


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def word_places(text: str) -> list[tuple[int, int]]:
    """Bounds of words: letters, with an apostrophe between letters."""
    return [m.span() for m in _WORD.finditer(text)]


def candidate_places(text: str, most: int, least: int, sizes: range) -> Iterator[tuple[int, int, bool]]:
    """Bounds of runs of one to `most` words, then of parts (of so many letters) of words of `least` letters or more."""
    words = word_places(text)
    yield from ((words[i][0], words[i + n][1], False) for i in range(len(words)) for n in range(min(most, len(words) - i)))
    yield from ((a + at, a + at + n, True) for a, b in words if b - a >= least for n in sizes if n < b - a for at in range(b - a - n + 1))


def candidates(df: DataFrame, text: str, keep: Sequence[str], most: int = 6, least: int = 7, sizes: range = range(4, 11)) -> DataFrame:
    """keep, ord, start, end, part, inside: what may answer a question about a context: runs of words, and parts inside long words."""

    def find(t: str):
        for i, (a, b, inside) in enumerate(candidate_places(t, most, least, sizes)):
            yield i, a, b, t[a:b], inside

    return walked(df, text, find, keep, {"ord": "int", "start": "int", "end": "int", "part": "string", "inside": "boolean"})


#: Rows of a lexicon that are broadcast at most, so that no word of a text moves; larger ones are joined by a shuffle.
LEXICON_ROWS = 200_000


def trigger_candidates(text: str, longest: int, clitics: Sequence[str], stop: frozenset, known: frozenset | None = None) -> Iterator[tuple]:
    """ord, start, end, surface, form, n, rank, clitic of every run of words in lower case, and of every word less a clitic, where known (if given) has the form."""
    places = word_places(text)
    low = [text[a:b].lower() for a, b in places]
    for i, (a, b) in enumerate(places):
        form = ""
        for n in range(1, min(longest, len(places) - i) + 1):
            form = f"{form} {low[i + n - 1]}" if form else low[i]
            if known is None or form in known:
                end = places[i + n - 1][1]
                yield i, a, end, text[a:end], form, n, -1, ""
        if low[i] not in stop:
            for rank, clitic in enumerate(clitics):
                if low[i].endswith(clitic) and len(low[i]) > len(clitic):
                    host = low[i][: -len(clitic)].removesuffix("'")
                    if known is None or host in known:
                        yield i, a, b, text[a : a + len(host)], host, 1, rank, clitic


def trigger_hits(df: DataFrame, text: str, lexicon: DataFrame, keep: Sequence[str], clitics: Sequence[str] = (), stop: Sequence[str] = (), longest: int = 3) -> DataFrame:
    """keep, start, end, surface, form, label, clitic: where forms of a lexicon (form, label) stand in a text.

    Forms are one to `longest` words in lower case, looked up by equality. A word
    that is no form itself and not in stop is also tried without each clitic at
    its end, joined by an apostrophe or not (the first clitic that leaves a form
    wins); then the surface is what stands before the clitic. One pass over the
    texts gives all candidates; a lexicon of up to LEXICON_ROWS goes to the
    tasks, so that only hits leave them, a larger one is joined by a shuffle.
    """
    barred = frozenset(stop)
    kinds = {"ord": "int", "start": "int", "end": "int", "surface": "string", "form": "string", "n": "int", "rank": "int", "clitic": "string"}
    forms, known = lexicon.select("form", "label"), None
    few = forms.limit(LEXICON_ROWS + 1).select("form").collect()
    if len(few) <= LEXICON_ROWS:
        forms, known = F.broadcast(forms), frozenset(r["form"] for r in few)
    found = walked(df, text, lambda t: trigger_candidates(t, longest, clitics, barred, known), keep, kinds).join(forms, "form")
    word = W.partitionBy(*keep, "ord")
    itself = F.max((F.col("rank") == -1) & (F.col("n") == 1)).over(word)
    first = F.min(F.when(F.col("rank") >= 0, F.struct("rank", "label"))).over(word)
    judged = found.withColumn("_itself", itself).withColumn("_first", first)
    kept = judged.where((F.col("rank") == -1) | (~F.col("_itself") & (F.struct("rank", "label") == F.col("_first"))))
    return kept.select(*keep, "start", "end", "surface", "form", "label", "clitic")


def trigger_scan(hits: DataFrame, terms: DataFrame, keep: Sequence[str], radius: int, cap: int, weight: Column | None = None) -> DataFrame:
    """keep, start, label, terms, score: triggers with the terms around them, scored, at most cap per text.

    hits (keep, start, label) and terms (keep, start, term) meet within radius
    characters. A trigger inside the window of one kept before it is left out.
    The score is the number of different terms, plus `weight` of the trigger.
    """
    a = hits.select(*keep, F.col("start").alias("_a"), "label")
    b = terms.select(*keep, F.col("start").alias("_b"), "term")
    near = band_join(a, b, list(keep), "_a", "_b", radius)
    found = near.groupBy(*keep, "_a", "label").agg(F.count_distinct("term").alias("terms"))
    rows = found.withColumn("score", F.col("terms") + (weight if weight is not None else F.lit(0)))
    places = rows.select(*keep, F.col("_a").alias("start"), (F.col("_a") + radius).alias("end"), "label", "terms", "score")
    flat = suppressed(places, keep, "start", "end", ["label"]).drop("end")
    return top_k(flat, list(keep), [F.desc("score"), F.asc("start"), F.asc("label")], cap, "_place").drop("_place")


@dataclass(frozen=True)
class Construction:
    """A construction of several words; where it needs a cue, one must stand within some characters of it."""

    name: str
    pattern: str
    cue: str | None = None


def construction_hits(df: DataFrame, text: str, constructions: Sequence[Construction], keep: Sequence[str], around: int = 100) -> DataFrame:
    """keep, ord, start, end, name, part: occurrences of constructions in the order of a text."""
    compiled = [(c.name, re.compile(c.pattern, re.I), c.cue and re.compile(c.cue, re.I)) for c in constructions]

    def find(t: str) -> list[dict]:
        hits = [(m.start(), m.end(), name) for name, rx, cue in compiled for m in rx.finditer(t) if not cue or cue.search(t, max(0, m.start() - around), m.end() + around)]
        return [{"start": a, "end": b, "name": name} for a, b, name in sorted(hits)]

    @F.arrow_udf("array<struct<start:int,end:int,name:string,part:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        flat, counts = [], [0]
        for t in texts.to_pylist():
            flat += [(h["start"], h["end"], h["name"], t[h["start"] : h["end"]]) for h in find(t or "")]
            counts.append(len(flat))
        start, end, name, part = zip(*flat) if flat else ((),) * 4
        return _listed(counts, start=pa.array(start, pa.int32()), end=pa.array(end, pa.int32()), name=pa.array(name, pa.string()), part=pa.array(part, pa.string()))

    rows = df.select(*keep, F.posexplode(spans(F.col(text))).alias("ord", "s"))
    return rows.select(*keep, "ord", "s.start", "s.end", "s.name", "s.part")


def suppressed(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = ()) -> DataFrame:
    """Greedy: of each key's rows by start (then end and order), those that begin at or after the end of the last one kept.

    Keys are dealt to tasks and sorted there; one pass remembers only the key at
    hand and the last end, so a key may have any number of rows.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, start, end, *order)

    def sweep(batches):
        last_key = last_end = None
        for batch in batches:
            own = zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(start).to_pylist(), batch.column(end).to_pylist())
            kept = []
            for i, (key, a, b) in enumerate(own):
                if key != last_key or a >= last_end:
                    last_key, last_end = key, b
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(sweep, rows.schema)


def separated_pairs(tokens: DataFrame, keep: Sequence[str], verbs: Sequence[str], particles: Sequence[str], ahead: int = 7) -> DataFrame:
    """Verbs whose particle follows within some tokens: keep, pos, token, particle."""
    window = W.partitionBy(*keep).orderBy("pos")
    later = F.array_compact(F.array(*(F.lead("token", i).over(window) for i in range(1, ahead + 1))))
    hit = F.filter(F.col("_later"), lambda x: x.isin(*particles))
    return tokens.withColumn("_later", later).where(F.col("token").isin(*verbs) & (F.size(hit) > 0)).select(*keep, "pos", "token", F.element_at(hit, 1).alias("particle"))


def first_runs(docs: DataFrame, doc: str, words: str, vocabulary: Sequence[str], longest: int) -> DataFrame:
    """doc, n, i, gram: the longest, then leftmost run of up to `longest` words of each row that a small vocabulary has (i from 1)."""
    listed = sorted({tuple(v.split(" ")) for v in vocabulary if v.count(" ") < longest})
    known = sorted({w for run in listed for w in run})
    number = {w: i for i, w in enumerate(known)}
    base = len(known) + 1
    keyed = lambda run: sum(number[w] * base**i for i, w in enumerate(run))
    sizes = [(n, sorted((keyed(r), " ".join(r)) for r in listed if len(r) == n)) for n in range(longest, 0, -1)]

    def rows(batches):
        for batch in batches:
            lists = batch.column(words)
            coded = lists.flatten().dictionary_encode()
            kinds = pa.compute.fill_null(pa.compute.index_in(coded.dictionary, value_set=pa.array(known, pa.string())), -1).to_numpy()
            kind = np.append(kinds, -1)[coded.indices.fill_null(-1).to_numpy()].astype(np.int64)
            many = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), many)
            starts = np.cumsum(many) - many
            found = np.zeros(batch.num_rows, bool)
            for n, runs in sizes:
                at = np.flatnonzero(kind >= 0)
                at = at[at + n <= len(kind)]
                at = at[owner[at + n - 1] == owner[at]]
                parts = [kind[at + j] for j in range(n)]
                good = np.all([p >= 0 for p in parts], axis=0) if len(at) else np.zeros(0, bool)
                at, key = at[good], sum(p[good] * base**j for j, p in enumerate(parts))
                wanted = np.array([k for k, _ in runs], np.int64)
                if not len(at) or not len(wanted):
                    continue
                which = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = (wanted[which] == key) & ~found[owner[at]]
                at, which = at[hit], which[hit]
                own, first = np.unique(owner[at], return_index=True)
                found[own] = True
                grams = pa.array([g for _, g in runs]).take(pa.array(which[first]))
                yield pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array(own)), pa.array(np.full(len(own), n, np.int32)), pa.array((at[first] - starts[own] + 1).astype(np.int32)), grams], names=[doc, "n", "i", "gram"])

    return docs.select(doc, words).mapInArrow(rows, f"{doc} {docs.schema[doc].dataType.simpleString()}, n int, i int, gram string")
