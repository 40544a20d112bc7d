"""Tokens, collocations, keyword windows and anchors over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import segmentation as G
from ..operators import windows as X
from .base import Book, stored

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: Example targets: frequent words of the four languages.
TARGETS = ("the", "and", "und", "der", "les", "des", "los", "por")
RADIUS = 5
_LIST = ", ".join(f"'{t}'" for t in TARGETS)
_TOKENS = r"SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents"


def _words(t):
    return t.documents.select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("w"))


@BOOK.query("token_positions", f"SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS token FROM ({_TOKENS})")
def token_positions(t):
    return _words(t).select("doc_id", F.posexplode("w").alias("pos", "token"))


@BOOK.query("term_census", f"SELECT source, lang, token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, source, lang, unnest(w) AS token FROM ({_TOKENS})) GROUP BY ALL HAVING count(*) >= 5")
def term_census(t):
    exploded = _words(t).select("doc_id", "source", "lang", F.explode("w").alias("token"))
    per_doc = exploded.groupBy("doc_id", "source", "lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("source", "lang", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 5")


#: Words within the radius of any use of a target, once per document.
_USES = f"""
tok AS ({_TOKENS}),
hit AS (SELECT doc_id, w, target FROM (SELECT doc_id, w, unnest([{_LIST}]) AS target FROM tok) WHERE list_contains(w, target)),
use AS (SELECT doc_id, w, target, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = target)) AS p FROM hit),
pairs AS (SELECT DISTINCT doc_id, target, collocate FROM (
  SELECT doc_id, target, unnest(list_concat(w[greatest(1, p - {RADIUS}):p - 1], w[p + 1:p + {RADIUS}])) AS collocate FROM use) WHERE collocate <> target)"""
_PAIRS = _USES + """,
joint AS (SELECT target, collocate, count(*) AS n_pair FROM pairs GROUP BY ALL HAVING count(*) >= 2),
scored AS (SELECT target, collocate, n_pair, n_target, n_collocate, n_rows,
  round(log2((n_pair + 0.5::DOUBLE) * n_rows / ((n_target + 0.5::DOUBLE) * (n_collocate + 0.5::DOUBLE))), 6) AS pmi
  FROM joint JOIN (SELECT target, count(*) AS n_target FROM hit GROUP BY 1) USING (target)
  JOIN (SELECT collocate, count(*) AS n_collocate FROM pairs GROUP BY 1) USING (collocate), (SELECT count(*) AS n_rows FROM hit))
"""

def _counts(t, by: str | None = None):
    """[by], target, collocate, n (to be summed): documents of each pair, and beside a null collocate rows that use the target."""
    words = _words(t)
    if A.single(t.documents, "doc_id"):
        return A.collocate_counts(words, "w", TARGETS, RADIUS, by)
    pairs = A.cooccurrence(words.select("doc_id", "w"), "doc_id", "w", TARGETS, RADIUS)
    rows = words.select(*([by] if by else []), F.explode_outer(F.array_intersect(F.array(*map(F.lit, TARGETS)), "w")).alias("target")).where("target is not null")
    if by:
        pairs = pairs.join(t.documents.select("doc_id", by), "doc_id")
    return pairs.drop("doc_id").unionByName(rows.withColumn("collocate", F.lit(None).cast("string"))).withColumn("n", F.lit(1).cast("long"))


def _pmi(t):
    counts = stored(_counts(t).groupBy("target", "collocate").agg(F.sum("n").alias("n")), "counts")  # read three times
    joint = counts.where("collocate is not null").withColumnRenamed("n", "n_pair")
    scored = A.pmi_of_counts(joint, counts.where("collocate is null").select("target", F.col("n").alias("n_target")))
    return scored.select("target", "collocate", "n_pair", "n_target", "n_collocate", "n_rows", "pmi")


@BOOK.query("cooc_pmi", f"WITH {_PAIRS} SELECT * FROM scored")
def cooc_pmi(t):
    return _pmi(t)


@BOOK.query("cooc_topk", f"WITH {_PAIRS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY pmi DESC, n_pair DESC, collocate) AS INTEGER) AS rank FROM scored) WHERE rank <= 20")
def cooc_topk(t):
    return A.top_collocates(_pmi(t), 20)


@BOOK.query("log_dice_all", f"WITH {_PAIRS} SELECT target, collocate, n_pair, round(14 + log2(2.0::DOUBLE * n_pair / (n_target + n_collocate)), 6) AS log_dice FROM scored")
def log_dice_all(t):
    """All collocates, of all documents."""
    return _pmi(t).select("target", "collocate", "n_pair", A.log_dice(F.col("n_pair"), F.col("n_target"), F.col("n_collocate")).alias("log_dice"))


#: Words that are no collocates, documents of a source that count per target, documents that a collocate needs, and collocates shown.
STOP, WORK_CAP, LEAST, SHOWN = ("of", "den", "une", "una"), 60, 3, 25
#: Ids of documents that are broadcast.
MOST_IDS = 200_000


@BOOK.query("log_dice", f"""WITH {_USES}, p AS (SELECT * FROM pairs WHERE length(collocate) > 2 AND collocate NOT IN ({", ".join(f"'{w}'" for w in STOP)})),
picked AS (SELECT doc_id, target FROM (SELECT doc_id, target, row_number() OVER (PARTITION BY source, target ORDER BY CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT), doc_id) AS r FROM hit JOIN documents USING (doc_id)) WHERE r <= {WORK_CAP}),
f AS (SELECT target, collocate, count(*) AS n_pair FROM p JOIN picked USING (doc_id, target) GROUP BY ALL HAVING count(*) >= {LEAST}),
d AS (SELECT target, collocate, n_pair, n_all, round(14 + log2(2.0::DOUBLE * n_pair / (n_target + n_all)), 6) AS log_dice FROM f JOIN (SELECT target, count(*) AS n_target FROM picked GROUP BY 1) USING (target) JOIN (SELECT collocate, count(*) AS n_all FROM p GROUP BY 1) USING (collocate))
SELECT target, collocate, n_pair, n_all, log_dice FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY log_dice DESC, n_pair DESC, collocate) AS r FROM d) WHERE r <= {SHOWN}""")
def log_dice(t):
    """The strongest collocates, with a cap per source, a stop list and a minimum."""
    words = t.documents.select("doc_id", "source", T.tokens(F.col("text")).alias("w"))
    taken = (F.length("collocate") > 2) & ~F.col("collocate").isin(*STOP)
    counts = _counts(t).where(taken).groupBy("collocate").agg(F.sum("n").alias("n_all"))
    works = words.select("doc_id", "source", F.explode_outer(F.array_intersect(F.array(*map(F.lit, TARGETS)), "w")).alias("target")).where("target is not null")
    order = T.hash_order(F.col("doc_id"))
    some = stored(A.capped_works(works, "source", order, WORK_CAP), "some")
    ids = some.select("doc_id").distinct()
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    pairs = A.cooccurrence(words.select("doc_id", "w").join(ids, "doc_id", "left_semi"), "doc_id", "w", TARGETS, RADIUS).where(taken)
    return A.collocates_of(pairs, counts, "n_all", some, LEAST, SHOWN)


@BOOK.query("collocates_by_class", f"WITH {_PAIRS} SELECT target, collocate, lang, count(*) AS n FROM pairs JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) >= 3")
def collocates_by_class(t):
    return _counts(t, "lang").where("collocate is not null").groupBy("target", "collocate", "lang").agg(F.sum("n").alias("n")).where("n >= 3")


@BOOK.query("collocates_compare", f"""WITH {_PAIRS}, side AS (SELECT target, collocate, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang <> 'en') AS b FROM pairs JOIN documents USING (doc_id) GROUP BY ALL)
SELECT target, collocate, a AS n_left, b AS n_right, a - b AS diff FROM side WHERE a + b >= 3""")
def collocates_compare(t):
    """Two score vectors aligned by key, missing ones as 0, and their difference."""
    side = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    both = _counts(t, "lang").where("collocate is not null").groupBy("target", "collocate").agg(side(F.col("lang") == "en", "n_left"), side(F.col("lang") != "en", "n_right"))
    return both.where("n_left + n_right >= 3").withColumn("diff", F.col("n_left") - F.col("n_right"))


# The names that these queries had while their plain names went by the first use of a target alone.
for _build in (cooc_pmi, cooc_topk, collocates_by_class, collocates_compare):
    BOOK.query(f"{_build.__name__}_all", ORACLES[_build.__name__])(_build)


@BOOK.query("sentence_tokens", f"SELECT DISTINCT list_aggregate(w, 'string_agg', ' ') AS tokens, len(w) AS n FROM ({_TOKENS}) WHERE len(w) > 0")
def sentence_tokens(t):
    return _words(t).where(F.size("w") > 0).select(F.array_join("w", " ").alias("tokens"), F.size("w").cast("long").alias("n")).distinct()


@BOOK.query("shingles", f"SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM ({_TOKENS}) WHERE len(w) >= 5)")
def shingles(t):
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))
    return _words(t).select("doc_id", F.explode_outer(F.when(F.size("w") >= 5, F.array_distinct(runs))).alias("run")).where("run is not null")


@BOOK.query("shingle_reuse", f"""WITH run AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM ({_TOKENS}) WHERE len(w) >= 5)),
size AS (SELECT doc_id, count(*) AS n FROM run GROUP BY 1), used AS (SELECT * FROM run WHERE run IN (SELECT run FROM run GROUP BY 1 HAVING count(*) BETWEEN 2 AND 29)),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM used x JOIN used y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, shared, round(shared / least(p.n, q.n), 6) AS share FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE shared / least(p.n, q.n) >= 0.3""")
def shingle_reuse(t):
    return J.shingle_pairs(_words(t), "doc_id", "w", 5, 2, 29, 0.3).withColumn("share", F.round("share", 6))


@BOOK.query("ngram_anchor", f"""WITH g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS n FROM ({_TOKENS})) WHERE len(w) >= n)),
v AS (SELECT n_name AS alias, 1 AS x FROM nation UNION ALL SELECT unnest(['the of', 'of the', 'and the', 'de la', 'in the']), 1),
m AS (SELECT doc_id, gram, n, i FROM g JOIN (SELECT DISTINCT lower(alias) AS gram FROM v) USING (gram))
SELECT doc_id, arg_min(gram, (-n, i)) AS anchor, min((-n, i))[1] * -1 AS words FROM m GROUP BY 1""")
def ngram_anchor(t):
    """The longest, then leftmost, alias of a vocabulary in each document: runs of one to three words in one pass, a small vocabulary."""
    alias = t.nation.select(F.lower("n_name").alias("gram")).where("gram is not null").collect()  # the nations, a fixed table, and a list
    hits = G.first_runs(_words(t).select("doc_id", "w"), "doc_id", "w", [r[0] for r in alias] + ["the of", "of the", "and the", "de la", "in the"], 3)
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "i", "gram")).alias("b"))
    return best.select("doc_id", F.col("b.gram").alias("anchor"), (-F.col("b.m")).alias("words"))


_POS = "instr(lower(text), ' the ')"


@BOOK.query("kwic_clip", f"SELECT doc_id, CASE WHEN {_POS} > 0 THEN substr(text, greatest(1, {_POS} - 60), {_POS} + 60 - greatest(1, {_POS} - 60)) ELSE substr(text, 1, 120) END AS clip FROM documents")
def kwic_clip(t):
    return t.documents.select("doc_id", T.window_around(F.col("text"), F.instr(F.lower("text"), " the "), 60).alias("clip"))


@BOOK.query("kwic_scan", f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, w[i + 1] AS term, array_to_string(w[greatest(1, i - 4):i], ' ') AS before, array_to_string(w[i + 2:i + 6], ' ') AS after
FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM ({_TOKENS})) WHERE w[i + 1] IN ('that', 'with', 'und', 'pour', 'para')""")
def kwic_scan(t):
    """One row per keyword occurrence: five words on either side, cut before the rows are made."""
    return T.keyword_windows(_words(t), "w", ["that", "with", "und", "pour", "para"], 5).select("doc_id", "pos", "term", "before", "after")


_MIDDLE = """SELECT doc_id, text, low, mid, instr(substr(low, mid), 'the') AS r, instr(reverse(substr(low, 1, mid + 1)), 'eht') AS l FROM (SELECT doc_id, text, lower(text) AS low, length(text) // 2 + 1 AS mid FROM documents WHERE contains(lower(text), 'the'))"""


@BOOK.query("kwic_split", rf"""WITH p AS (SELECT doc_id, text, CASE WHEN r = 0 OR (l > 0 AND l <= r - 1) THEN mid - l ELSE mid + r - 1 END AS place FROM ({_MIDDLE})),
c AS (SELECT doc_id, substr(text, 1, place - 1) AS b, substr(text, place, 3) AS k, substr(text, place + 3) AS a FROM p), e AS (SELECT *, regexp_extract(b, '\p{{L}}+$') AS x, regexp_extract(a, '^\p{{L}}+') AS y FROM c)
SELECT doc_id, substr(b, 1, length(b) - length(x)) AS before, x || k || y AS keyword, substr(a, length(y) + 1) AS after FROM e""")
def kwic_split(t):
    """Around the occurrence nearest the middle, widened to its whole token."""
    return T.split_at_middle(t.documents, "text", "the").select("doc_id", "before", "keyword", "after")


@BOOK.query("marker_injection", f"SELECT doc_id, CASE WHEN {_POS} > 0 THEN substr(text, 1, {_POS}) || '<t>the</t>' || substr(text, {_POS} + 4) ELSE '<t>the</t> ' || text END AS marked FROM documents")
def marker_injection(t):
    at = F.instr(F.lower("text"), " the ")
    inside = F.concat(F.substring("text", F.lit(1), at), F.lit("<t>the</t>"), F.substring("text", at + 4, F.length("text")))
    return t.documents.select("doc_id", F.when(at > 0, inside).otherwise(F.concat(F.lit("<t>the</t> "), "text")).alias("marked"))


@BOOK.query("neighbour_counts", f"""WITH tok AS (SELECT doc_id, i, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM ({_TOKENS})))
SELECT a.token AS anchor, b.token AS neighbour, count(*) AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 8
WHERE a.token IN ('that', 'pour') AND b.token IN ('with', 'was', 'dans', 'une') GROUP BY ALL""")
def neighbour_counts(t):
    tok = _words(t).select("doc_id", F.posexplode("w").alias("i", "token"))
    left = tok.where(F.col("token").isin("that", "pour")).select("doc_id", F.col("i").alias("a"), F.col("token").alias("anchor"))
    right = tok.where(F.col("token").isin("with", "was", "dans", "une")).select("doc_id", F.col("i").alias("b"), F.col("token").alias("neighbour"))
    return J.band_join(left, right, ["doc_id"], "a", "b", 8).groupBy("anchor", "neighbour").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("sub_words", f"""SELECT DISTINCT token, substr(token, i, 4) AS part FROM (SELECT token, unnest(range(1, length(token) - 2)) AS i FROM (SELECT DISTINCT unnest(w) AS token FROM ({_TOKENS})) WHERE length(token) >= 9)""")
def sub_words(t):
    token = _words(t).select(F.explode("w").alias("token")).distinct().where(F.length("token") >= 9)
    parts = F.transform(F.sequence(F.lit(1), F.length("token") - 3), lambda i: F.substring(F.col("token"), i, F.lit(4)))
    return token.select("token", F.explode(F.array_distinct(parts)).alias("part"))


@BOOK.query("stride_chunks", "SELECT doc_id, CAST(s AS INTEGER) AS start, substr(text, s + 1, 300) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 250)) AS s FROM documents)")
def stride_chunks(t):
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("text")) - 1, F.lit(250)))
    return t.documents.select("doc_id", "text", starts.alias("start")).select("doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(300)).alias("chunk"))


@BOOK.query("contains_join", "SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(documents.text, b.text)")
def contains_join(t):
    needles = t.benchmark.select("item_id", F.col("text").alias("needle"))
    return J.contains_join(t.documents.select("doc_id", "text"), needles, "doc_id", "text", "needle").select("doc_id", "item_id")


@BOOK.query("class_ladder", r"""SELECT doc_id, CASE WHEN length(text) < 100 THEN 'fragment' WHEN regexp_matches(text, '[0-9a-f]{16}') THEN 'secret'
WHEN regexp_matches(lower(text), '(license|copyright)') THEN 'legal' WHEN length(text) > 20000 THEN 'book' ELSE 'UNKNOWN' END AS class FROM documents""")
def class_ladder(t):
    rules = [(F.length("text") < 100, "fragment"), (F.col("text").rlike("[0-9a-f]{16}"), "secret"), (F.lower("text").rlike("(license|copyright)"), "legal"), (F.length("text") > 20000, "book")]
    return t.documents.select("doc_id", T.ladder(rules, "UNKNOWN").alias("class"))


@BOOK.query("routing_upgrade", r"""SELECT doc_id, base, CASE WHEN base = 'UNKNOWN' AND regexp_matches(lower(substr(text, 1, 200)), '\bthe\b') THEN 'english' WHEN base = 'UNKNOWN' AND regexp_matches(lower(substr(text, 1, 200)), ' (und|der) ') THEN 'german' ELSE base END AS routed
FROM (SELECT *, CASE WHEN n_chars > 5000 THEN 'long' ELSE 'UNKNOWN' END AS base FROM documents)""")
def routing_upgrade(t):
    head = F.lower(F.substring("text", 1, 200))
    rows = t.documents.withColumn("base", F.when(F.col("n_chars") > 5000, "long").otherwise("UNKNOWN"))
    unknown = F.col("base") == "UNKNOWN"
    return rows.select("doc_id", "base", T.ladder([(unknown & head.rlike(r"\bthe\b"), "english"), (unknown & head.rlike(" (und|der) "), "german")], F.col("base")).alias("routed"))


@BOOK.query("risk_case", r"""SELECT doc_id, CAST(a + b + c AS INTEGER) AS score, CASE WHEN a + b + c >= 2 THEN 'high' WHEN a + b + c = 1 THEN 'medium' ELSE 'low' END AS risk,
concat_ws(';', CASE WHEN a = 1 THEN 'digits' END, CASE WHEN b = 1 THEN 'at' END, CASE WHEN c = 1 THEN 'short' END) AS reasons
FROM (SELECT doc_id, CAST(regexp_matches(text, '[0-9]{4}') AS INTEGER) AS a, CAST(contains(text, '@') AS INTEGER) AS b, CAST(length(text) < 200 AS INTEGER) AS c FROM documents)""")
def risk_case(t):
    a, b, c = (x.cast("int") for x in (F.col("text").rlike("[0-9]{4}"), F.col("text").contains("@"), F.length("text") < 200))
    rows = t.documents.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c")).withColumn("score", F.col("a") + F.col("b") + F.col("c"))
    reasons = F.concat_ws(";", F.when(F.col("a") == 1, "digits"), F.when(F.col("b") == 1, "at"), F.when(F.col("c") == 1, "short"))
    return rows.select("doc_id", "score", T.ladder([(F.col("score") >= 2, "high"), (F.col("score") == 1, "medium")], "low").alias("risk"), reasons.alias("reasons"))


@BOOK.query("storage_gate", r"""SELECT doc_id, NOT regexp_matches(w, 'token') AND regexp_matches(w, '(key|secret|password)') AS passed
FROM (SELECT doc_id, lower(substr(text, greatest(1, p - 100), 200)) AS w FROM (SELECT doc_id, text, instr(text, '=') AS p FROM documents) WHERE p > 0)""")
def storage_gate(t):
    """A negative cue vetoes and a positive one is required within 100 characters of a mark."""
    at = F.instr("text", "=")
    near = F.lower(F.substring("text", F.greatest(F.lit(1), F.col("p") - 100), F.lit(200)))
    rows = t.documents.select("doc_id", "text", at.alias("p")).where("p > 0").select("doc_id", near.alias("w"))
    return rows.select("doc_id", (~F.col("w").rlike("token") & F.col("w").rlike("(key|secret|password)")).alias("passed"))


@BOOK.query("names_over_time", r"""SELECT source, word, CAST(sum((length(t) - length(replace(t, word, ''))) // length(word)) AS BIGINT) AS hits, CAST(sum(CAST(contains(t, word) AS INTEGER)) AS BIGINT) AS docs
FROM (SELECT source, lower(text) AS t FROM documents), (SELECT unnest(['the', 'und', 'les', 'que']) AS word) GROUP BY ALL""")
def names_over_time(t):
    words = ["the", "und", "les", "que"]
    low = t.documents.select("source", F.lower("text").alias("t"))
    counted = low.select("source", F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.regexp_count("t", F.lit(w)).alias("hits")) for w in words))).alias("x"))
    return counted.groupBy("source", F.col("x.word").alias("word")).agg(F.sum("x.hits").cast("long").alias("hits"), F.sum((F.col("x.hits") > 0).cast("int")).alias("docs"))


@BOOK.query("normalised_text", r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(lower(text), 'ſ', 's'), 'æ', 'ae'), 'œ', 'oe'), '[^\p{L}]+', ' ', 'g')) AS norm FROM documents")
def normalised_text(t):
    return t.documents.select("doc_id", T.normal(F.col("text")).alias("norm"))


#: Rules of spelling, sound and print made up for the words of these tables.
RULES = (T.Rule("greek_f", "ph", "f"), T.Rule("sharp_s", "ß", "ss"), T.Rule("tion", "tion(?=s?$)", "cion"), T.Rule("last_h", "(?<=[aeiou])h$", ""), T.Rule("twice", r"([mnlr])\1", "$1"))
SOUNDS, ALIKE = (("sch", "j"), ("ou", "u"), ("ei", "ai")), ("bgä", "pke")
PRINT = (("rn", "m"), ("cl", "d"), ("h", "b"))


@BOOK.query("spelling_keys", r"""SELECT token, regexp_replace(replace(replace(token, 'ph', 'f'), 'ß', 'ss'), 'tion(s?)$', 'cion\1') AS key_part, length(token) >= 3 AS eligible FROM (SELECT DISTINCT unnest(w) AS token FROM (""" + _TOKENS + r""")) WHERE NOT regexp_matches(token, '[æœſ]') AND lower(token) = token""")
def spelling_keys(t):
    """The rules that any engine can apply, the others skipped."""
    token = _words(t).select(F.explode("w").alias("token")).distinct().where(~F.col("token").rlike("[æœſ]") & (F.lower("token") == F.col("token")))
    return token.select("token", T.spelling_key(F.col("token"), RULES, ("last_h", "twice")).alias("key_part"), T.eligible(F.col("token")).alias("eligible"))


@BOOK.query("spelling_key_full")
def spelling_key_full(t):
    """Keys with look-behind and back references, and the rules that fired (no SQL for those)."""
    token = _words(t).select(F.explode("w").alias("token")).distinct()
    c = F.col("token")
    return token.select("token", T.spelling_key(c, RULES).alias("key"), T.loose_key(c, ("ge", "er")).alias("loose"), T.sound_key(c, SOUNDS, ALIKE).alias("phonetic"), F.array_join(T.fired_rules(c, RULES), ";").alias("fired"))


@BOOK.query("confusable_forms", f"""WITH v AS (SELECT DISTINCT unnest(w) AS form FROM ({_TOKENS})), s AS (SELECT unnest(['rn', 'cl', 'h']) AS a, unnest(['m', 'd', 'b']) AS b),
n AS (SELECT DISTINCT form, left(form, CAST(i - 1 AS BIGINT)) || b || substr(form, CAST(i + length(a) AS BIGINT)) AS other, a || '>' || b AS swap FROM (SELECT form, a, b, unnest(range(1, length(form) - length(a) + 2)) AS i FROM v, s) WHERE substr(form, CAST(i AS BIGINT), length(a)) = a)
SELECT n.form, n.other, n.swap FROM n JOIN v ON n.other = v.form""")
def confusable_forms(t):
    """Vocabulary words that one misread letter turns into another vocabulary word."""
    form = _words(t).select(F.explode("w").alias("form")).distinct()
    near = form.select("form", F.explode(F.array_distinct(T.swapped(F.col("form"), PRINT))).alias("x")).select("form", "x.other", "x.swap")
    return near.join(form.select(F.col("form").alias("other")), "other", "left_semi").select("form", "other", "swap")


@BOOK.query("key_list_join", f"""WITH v AS (SELECT DISTINCT unnest(w) AS form FROM ({_TOKENS})), k AS (SELECT form, replace(replace(form, 'th', 't'), 'ph', 'f') AS key FROM v)
SELECT key, count(*) AS forms, min(form) AS first_form FROM k GROUP BY 1 HAVING count(*) > 1""")
def key_list_join(t):
    form = _words(t).select(F.explode("w").alias("form")).distinct()
    keyed = form.select("form", T.rewritten(F.col("form"), (("th", "t"), ("ph", "f"))).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.min("form").alias("first_form")).where("forms > 1")


_COMPOUNDS = f"""WITH v AS (SELECT DISTINCT unnest(w) AS form FROM ({_TOKENS})), c AS (SELECT form, unnest(range(2, length(form) - 2)) AS stem FROM v WHERE length(form) >= 5),
d AS (SELECT form, max(length(form) - stem) AS n FROM c WHERE right(form, length(form) - stem) IN (SELECT form FROM v) AND left(form, stem) IN (SELECT form FROM v) GROUP BY 1) SELECT form, right(form, n) AS head, left(form, length(form) - n) AS modifier FROM d"""


@BOOK.query("compound_parts_all", _COMPOUNDS)
@BOOK.query("compound_parts", _COMPOUNDS)
def compound_parts(t):
    """The longest head of three letters or more after a known stem of two or more."""
    return A.compounds(_words(t).select(F.explode("w").alias("form")).distinct(), "form")
