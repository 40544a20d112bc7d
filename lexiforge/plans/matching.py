"""Localisation of contexts, tiers of context matches, exemplars and re-ranked keyword rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import localise as O
from ..operators import vectors as V
from .base import Book, stored

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: A context is so many characters on either side of a text's middle; one character of it is spoilt, at a distance from the
#: target that goes by the id: none, or within reach of all but the next window.
AROUND, SPOILT = 80, (0, -60, -25, -15, -5)
_NORMAL = r"trim(regexp_replace(replace(replace(replace(lower(text), 'ſ', 's'), 'æ', 'ae'), 'œ', 'oe'), '[^\p{L}]+', ' ', 'g'))"
_LEVEL = f"[{', '.join(map(str, SPOILT))}][1 + doc_id % {len(SPOILT)}]"
_CONTEXTS = f"""WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, t, regexp_extract(substr(t, length(t) // 2 + 1), '\\p{{L}}{{3,}}') AS target FROM n),
p AS (SELECT *, length(t) // 2 + instr(substr(t, length(t) // 2 + 1), target) AS spot FROM m WHERE target <> ''),
w AS (SELECT doc_id, t, target, spot, greatest(1, spot - {AROUND}) AS a, substr(t, greatest(1, spot - {AROUND}), spot + {AROUND} - greatest(1, spot - {AROUND})) AS c, {_LEVEL} AS level FROM p),
c AS (SELECT doc_id, t, target, CASE WHEN level = 0 OR spot + level < a THEN c ELSE substr(c, 1, spot + level - a) || '#' || substr(c, spot + level - a + 2) END AS context FROM w),
o AS (SELECT doc_id, t, target, context, instr(context, target) AS ti, instr(t, context) AS whole FROM c)"""


def _window(width: int) -> str:
    return f"substr(context, greatest(0, ti - 1 - {width // 2}) + 1, {width})"


def _once(width: int) -> str:
    w = _window(width)
    return f"(ti > 0 AND length({w}) >= 15 AND contains(t, {w}) AND instr(substr(t, instr(t, {w}) + 1), {w}) = 0)"


def _place(width: int) -> str:
    return f"instr(t, {_window(width)}) - 1 + ti - 1 - greatest(0, ti - 1 - {width // 2})"


@BOOK.query("localised_windows", f"""{_CONTEXTS} SELECT doc_id, target, CAST(CASE WHEN whole > 0 THEN whole - 1 + greatest(ti - 1, 0) WHEN {_once(60)} THEN {_place(60)} WHEN {_once(40)} THEN {_place(40)} WHEN {_once(25)} THEN {_place(25)} END AS INTEGER) AS place,
CASE WHEN whole > 0 THEN 'exact' WHEN {_once(60)} THEN '60' WHEN {_once(40)} THEN '40' WHEN {_once(25)} THEN '25' END AS found FROM o""")
def localised_windows(t):
    """Contexts around the middle of every text, most of them spoilt at some distance from their target, found again in it."""
    texts = t.documents.where("text is not null").select("doc_id", T.normal(F.col("text")).alias("t"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    later = F.expr("substring(t, floor(char_length(t) / 2) + 1)")
    rows = texts.withColumn("target", F.regexp_extract(later, r"\p{L}{3,}", 0)).where("target <> ''").withColumn("at", half + F.instr(later, F.col("target")))
    rows = rows.withColumn("a", F.greatest(F.lit(1), F.col("at") - AROUND)).withColumn("c", F.substring("t", F.col("a"), F.col("at") + AROUND - F.col("a")))
    level = F.array(*map(F.lit, SPOILT))[F.pmod("doc_id", F.lit(len(SPOILT))).cast("int")]
    cut = F.col("at") + level - F.col("a")
    spoilt = F.concat(F.substring("c", F.lit(1), cut), F.lit("#"), F.substring("c", cut + 2, F.char_length("c")))
    contexts = rows.select("doc_id", "target", F.when((level == 0) | (cut < 0), F.col("c")).otherwise(spoilt).alias("context"))
    contexts = stored(contexts, "contexts")  # read twice
    return O.localised(contexts, texts, "doc_id", "context", "target", "t").select("doc_id", "target", "place", "found")


_SIDES = r"""WITH d AS (SELECT doc_id, lower(regexp_extract(text, '\p{L}+')) AS term, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id AS id, term, substr(text, 1, 300) AS context FROM d),
r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -1 - doc_id END AS id, term, CASE WHEN doc_id % 3 = 1 THEN substr(replace(text, ' ', '  '), 1, 300) ELSE substr(text, 11, 400) END AS context, doc_id AS place FROM d),
k AS (SELECT *, substr(trim(regexp_replace(lower(context), '\s+', ' ', 'g')), 1, 120) AS key FROM l), q AS (SELECT *, substr(trim(regexp_replace(lower(context), '\s+', ' ', 'g')), 1, 120) AS key FROM r),
one AS (SELECT id, id AS other, 1 AS tier FROM l WHERE id IN (SELECT id FROM r)),
two AS (SELECT k.id, arg_min(q.id, q.place) AS other, 2 AS tier FROM k JOIN q ON k.term = q.term AND k.key = q.key WHERE k.id NOT IN (SELECT id FROM one) AND trim(k.context) <> '' AND trim(q.context) <> '' GROUP BY k.id),
three AS (SELECT l.id, arg_min(r.id, r.place) AS other, 3 AS tier FROM l JOIN r ON l.term = r.term AND trim(l.context) <> '' AND trim(r.context) <> '' AND (contains(l.context, substr(r.context, 1, 80)) OR contains(r.context, substr(l.context, 1, 80)))
  WHERE l.id NOT IN (SELECT id FROM one) AND l.id NOT IN (SELECT id FROM two) GROUP BY l.id)"""


@BOOK.query("tiered_contexts", f"{_SIDES} SELECT l.id, l.term, m.other, m.tier FROM l LEFT JOIN (FROM one UNION ALL FROM two UNION ALL FROM three) m ON l.id = m.id")
def tiered_contexts(t):
    """Contexts of all documents matched with another table of them: by id, by term and context key, by containment either way."""
    docs = t.documents.where("text is not null").select("doc_id", F.lower(F.regexp_extract("text", r"\p{L}+", 0)).alias("term"), "text")
    left = docs.select(F.col("doc_id").alias("id"), "term", F.substring("text", 1, 300).alias("context"))
    number = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id"))
    other = F.when(F.col("doc_id") % 3 == 1, F.substring(F.replace("text", F.lit(" "), F.lit("  ")), 1, 300)).otherwise(F.substring("text", 11, 400))
    right = docs.select(number.alias("id"), "term", other.alias("context"), F.col("doc_id").alias("place"))
    return O.matched_contexts(left, right, "id", "term", "context", "place", kept=stored).select("id", "term", "other", "tier")


_UNIT = "[CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN e])) FOR x IN e]"


@BOOK.query("exemplar_candidates", f"""WITH u AS (SELECT vec_id, label, {_UNIT.replace(' e]', ' embedding]')} AS v FROM embeddings),
c AS (SELECT vec_id, label, c, CASE WHEN c = 0 THEN v ELSE list_concat(v[16 * c + 1:], v[:16 * c]) END AS v FROM u, range(4) AS r(c)),
s AS (SELECT c.vec_id, c.c, u.vec_id AS exemplar, round(list_dot_product(c.v, u.v), 6) AS score FROM c JOIN u ON c.label = u.label AND c.vec_id <> u.vec_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, c ORDER BY score DESC, exemplar) AS r FROM s) WHERE r = 1)
SELECT vec_id, candidate, exemplar, score FROM (SELECT vec_id, CAST(c AS INTEGER) AS candidate, exemplar, round(score - CASE WHEN c >= 2 THEN 0.05 ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score - CASE WHEN c >= 2 THEN 0.05 ELSE 0 END, 6) DESC, c) AS k FROM b) WHERE k = 1""")
def exemplar_candidates(t):
    """Four candidates of every vector (its turns by 16 places, two of them parts) against all other exemplars of its label, left out itself."""
    exemplars = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("field"), F.col("embedding").alias("v"))
    turned = lambda c: F.concat(F.slice("embedding", 16 * c + 1, 64), F.slice("embedding", 1, 16 * c))
    several = F.array(*(F.struct(F.lit(c).alias("candidate"), turned(c).alias("v"), F.lit(c >= 2).alias("part")) for c in range(4)))
    candidates = t.embeddings.select(F.col("vec_id").alias("row"), F.col("label").alias("field"), F.explode(several).alias("x")).select("row", "field", "x.*")
    best = V.best_candidates(candidates, exemplars, stored, 0.05)
    return best.select(F.col("row").alias("vec_id"), "candidate", "exemplar", "score")


_RANKED = """WITH u AS (SELECT vec_id, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_dot_product(u.v, c.v) / sqrt(list_dot_product(c.v, c.v)), 6) AS score FROM u, c),
n AS (SELECT a.vec_id, a.label, a.score, b.score AS none_score, a.score >= b.score + {margin} AS passed FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.label = 0 WHERE a.label <> 0),
f AS (SELECT *, NOT bool_or(passed) OVER (PARTITION BY label) AS fallback FROM n)
SELECT vec_id, label, score, fallback, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN fallback THEN round(score - none_score, 9) ELSE score END DESC, vec_id) AS r FROM f WHERE passed OR fallback) WHERE r <= 20"""


def _reranked(t, margin: float):
    centres = V.centroids(t.embeddings, "label", "embedding")
    scored = V.scores_against(t.embeddings, "vec_id", "embedding", centres, "label", "centroid").withColumn("score", F.round("score", 6))
    return V.reranked(scored, "vec_id", 0, margin, 20).select("vec_id", F.col("label").cast("int").alias("label"), "score", "fallback", "rank")


@BOOK.query("reranked_rows", _RANKED.format(margin=0.3))
def reranked_rows(t):
    """All rows against every class: those beyond the NONE score and a margin, the best first."""
    return _reranked(t, 0.3)


@BOOK.query("reranked_fallback", _RANKED.format(margin=0.9))
def reranked_fallback(t):
    """A margin that classes can't reach: all rows by their lead over the NONE score instead."""
    return _reranked(t, 0.9)
