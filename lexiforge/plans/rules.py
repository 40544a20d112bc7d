"""Queries of rule tables: word forms, scores, goals, reach; pools, names over time, the sieve and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as W
from ..functions import scoring as K
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import cascade as C
from ..operators import goals as O
from ..operators import segmentation as G
from ..streaming import events as R
from ..streaming import progress as P
from .base import Book, folder, stored
from .spans import CUES

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

# -- forms ----------------------------------------------------------------------------------------

#: Form rules made up for the words of these tables. Spellings feed each other: sch, sh, sj; ck, kk, x.
FORMS = W.FormRules(
    ending="en",
    stems=(T.Rule("double", r"([bdfgklmnprst])[bdfgklmnprst]$", "$1"), T.Rule("open", r"([aeou])([klmnpr])$", "$1$1$2")),
    finals=(T.Rule("v", "v$", "f"), T.Rule("z", "z$", "s")),
    kinds={"stem": ("", ""), "third": ("", "t"), "past": ("", "te"), "participle": ("ge", "t")},
    spellings=(T.Rule("sch", "sch", "sh"), T.Rule("sh", "sh", "sj"), T.Rule("ck", "ck", "kk"), T.Rule("kk", "kk", "x"), T.Rule("ei", "ei", "ij"), T.Rule("ij", "ij", "y"), T.Rule("ge", "^ge", "ghe")),
    exceptions={"ten": ("tun", "tat"), "schen": ("schacht",)},
)
_RULES = [(r.pattern, r.replacement) for r in FORMS.spellings]
_STEM = r"CASE WHEN regexp_matches(b, '([bdfgklmnprst])[bdfgklmnprst]$') THEN regexp_replace(b, '([bdfgklmnprst])[bdfgklmnprst]$', '\1') WHEN regexp_matches(b, '([aeou])([klmnpr])$') THEN regexp_replace(b, '([aeou])([klmnpr])$', '\1\1\2') ELSE b END"
_IRREGULAR = ", ".join(f"('{w}', '{f}')" for w, forms in FORMS.exceptions.items() for f in forms)
_KINDS = {"lemma": 0, **{k: i + 1 for i, k in enumerate(FORMS.kinds)}, "irregular": 9}


@BOOK.query("verb_form_closure", rf"""WITH RECURSIVE v AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents) WHERE suffix(word, 'en') AND length(word) BETWEEN 3 AND 9),
s AS (SELECT word, regexp_replace(regexp_replace({_STEM}, 'v$', 'f'), 'z$', 's') AS stem FROM (SELECT word, left(word, length(word) - 2) AS b FROM v)),
x(word, form) AS (VALUES {_IRREGULAR}),
seed AS (SELECT word, word AS form, 0 AS k FROM v UNION ALL SELECT word, p || stem || e, k FROM s, (VALUES {", ".join(f"('{p}', '{e}', {_KINDS[k]})" for k, (p, e) in FORMS.kinds.items())}) AS r(p, e, k) WHERE word NOT IN (SELECT word FROM x)
  UNION ALL SELECT v.word, form, 9 FROM v JOIN x USING (word)),
grown(word, form, k) AS (SELECT * FROM seed UNION SELECT word, regexp_replace(form, p, r, 'g'), k FROM grown, (VALUES {", ".join(f"('{p}', '{r}')" for p, r in _RULES)}) AS q(p, r))
SELECT word, form, CASE min(k) {" ".join(f"WHEN {i} THEN '{k}'" for k, i in _KINDS.items())} END AS kind FROM grown GROUP BY word, form""")
def verb_form_closure(t):
    """All spellings of all forms of the words that look like verbs, with the kind of each."""
    words = t.documents.select(F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("word")).where(F.endswith("word", F.lit("en")) & F.char_length("word").between(3, 9)).distinct()
    return words.select("word", F.explode_outer(W.all_forms(F.col("word"), FORMS)).alias("x")).select("word", "x.form", "x.kind")


# -- scores ---------------------------------------------------------------------------------------

TRIGGERS, AROUND = ("that", "with", "und", "pour", "para"), 8
SCORES = (
    K.Points("core", 4, "term", "^(with|pour|und)$"), K.Points("weak", 2, "term", "^(that|para)$"), K.Points("close_noun", 2, "after", "^[^ ]*(tion|ung|ment|ad)( |$)"),
    K.Points("article", 1, "before", "(^| )(the|der|les|los)$"), K.Points("far_noun", 1, "after", "(tion|ung|ment|ad)( |$)"), K.Points("short_text", -2, "after", "^([^ ]+ ?){0,3}$"),
    K.Points("conflict", -3, "around", "(^| )(that|with|und|pour|para)( |$)", each=True), K.Points("no_article", -1, "around", "(^| )(the|der|les|los|and|die|des|que)( |$)", absent=True),
)
TIERS = (("high", 6, ("conflict",)), ("medium", 4, ()))


def _case(rule: K.Points) -> str:
    place = {"term": "term", "after": "after", "before": "before", "around": "around"}[rule.place]
    if rule.each:
        return f"len(regexp_extract_all({place}, '{rule.pattern}'))"
    return f"CAST({'NOT ' if rule.absent else ''}regexp_matches({place}, '{rule.pattern}') AS INTEGER)"


@BOOK.query("context_score", rf"""WITH w AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents)),
h AS (SELECT doc_id, i AS pos, w[i + 1] AS term, array_to_string(w[greatest(1, i - {AROUND - 1}):i], ' ') AS before, array_to_string(w[i + 2:i + {AROUND + 1}], ' ') AS after FROM w WHERE w[i + 1] IN ({", ".join(f"'{x}'" for x in TRIGGERS)})),
a AS (SELECT *, before || ' | ' || after AS around FROM h),
s AS (SELECT doc_id, pos, term, {" + ".join(f"({r.points}) * {_case(r)}" for r in SCORES)} AS score, list_filter([{", ".join(f"CASE WHEN {_case(r)} > 0 THEN '{r.reason}' END" for r in SCORES)}], lambda x: x IS NOT NULL) AS reasons FROM a),
t AS (SELECT *, CASE WHEN score >= 6 AND NOT list_contains(reasons, 'conflict') THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS tier FROM s)
SELECT doc_id, pos, term, score, array_to_string(reasons, ',') AS reasons, tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM t WHERE tier <> 'low') WHERE r = 1""")
def context_score(t):
    """The clearest use of a trigger in each text by a table of rules, with its reasons and tier."""
    words = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))
    hits = T.keyword_windows(words, "w", TRIGGERS, AROUND).withColumn("around", F.concat_ws(" | ", "before", "after"))
    rows = K.scored(hits, SCORES, {c: F.col(c) for c in ("term", "before", "after", "around")}, TIERS)
    best = K.best_scored(rows, ["doc_id"], ["pos"])
    return best.select("doc_id", F.col("pos").cast("long").alias("pos"), "term", F.col("score").cast("long").alias("score"), F.array_join("reasons", ",").alias("reasons"), "tier")


_GRADES = """WITH a AS (SELECT * FROM part), b AS (SELECT p_partkey - 1 AS p_partkey, p_brand AS brand, p_type AS kind, p_name AS name, p_size AS size FROM part),
m AS (SELECT a.p_partkey, p_type, CAST(p_brand = brand AS INTEGER) + CAST(p_type = kind AS INTEGER) + CAST(string_split(p_name, ' ')[1] = string_split(name, ' ')[1] AS INTEGER) AS hits, p_size % 2 = size % 2 AS ok FROM a JOIN b USING (p_partkey)),
g AS (SELECT *, CASE WHEN hits = 3 THEN 'joint' WHEN hits >= 2 THEN 'partial_strong' WHEN hits = 1 AND ok THEN 'partial' WHEN ok AND hits = 0 THEN 'frame_ok_zero' ELSE 'miss' END AS tier FROM m)
SELECT p_partkey, CAST(hits AS INTEGER) AS hits, tier, CASE WHEN tier IN ('joint', 'partial_strong') THEN 'yes' WHEN tier = 'partial' AND p_type = 'ECONOMY' THEN 'maybe' ELSE '' END AS few_shot FROM g"""


@BOOK.query("tier_flag", _GRADES)
def tier_flag(t):
    """Each part's fields held against those of the next: grade, and whether it is fit as an example."""
    head = lambda c: F.element_at(F.split(c, " "), 1)
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    hits = (F.col("p_brand") == F.col("brand")).cast("int") + (F.col("p_type") == F.col("kind")).cast("int") + (head("p_name") == head("name")).cast("int")
    rows = t.part.join(after, "p_partkey").withColumn("hits", hits)
    tier = K.review_tier(F.col("hits"), F.col("hits") == 3, F.col("p_size") % 2 == F.col("size") % 2)
    return rows.withColumn("tier", tier).select("p_partkey", "hits", "tier", K.few_shot(F.col("tier"), F.col("p_type"), "ECONOMY").alias("few_shot"))


# -- reach, names, pools --------------------------------------------------------------------------

LEVELS = (("1-URGENT", "specific"), ("2-HIGH", "light"), ("3-MEDIUM", "flagged"))
SETS = (("any", ("specific", "light", "flagged")), ("unflagged", ("specific", "light")), ("specific", ("specific",)))
_UNREACHED = "n - reached"


def _wilson(sign: str) -> str:
    p, z = "(n - reached)::DOUBLE / n", 1.96
    return f"round(({p} + {z * z} / (2 * n) {sign} {z} * sqrt(({p} * (1 - {p}) + {z * z} / (4 * n)) / n)) / (1 + {z * z} / n), 6)"


@BOOK.query("level_reach", f"""WITH c AS (SELECT c_custkey, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS a, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS u, bool_or(o_orderpriority = '1-URGENT') AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
r AS (SELECT unnest(['any', 'unflagged', 'specific']) AS name, n, unnest([a, u, s]) AS reached FROM (SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (u) AS u, count(*) FILTER (s) AS s FROM c))
SELECT name, n, reached, {_UNREACHED} AS unreached, round((n - reached)::DOUBLE / n, 6) AS share, {_wilson('-')} AS low, {_wilson('+')} AS high FROM r""")
def level_reach(t):
    """How many customers growing sets of order priorities reach."""
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("listed"))
    rows = t.customer.select("c_custkey").join(lists, "c_custkey", "left")
    return A.level_reach(rows, "c_custkey", "listed", t.spark.createDataFrame(LEVELS, "member string, level string"), SETS)


#: Names of one thing, as patterns of whole words.
NAMES = (("size", r"\b(small|little)\b", r"\b(large|big)\b"), ("round", r"\b(ring|wheel)\b", r"\b(ball|disc)\b"), ("tool", r"\b(bolt|screw)\b", r"\b(gear|valve)\b"))


@BOOK.query("names_by_decade", rf"""WITH r AS (SELECT l_orderkey AS work, year(l_shipdate) // 10 * 10 AS since, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT since, count(*) AS texts, sum(len(regexp_extract_all(t, '\S+'))) AS words FROM r GROUP BY 1),
u AS (SELECT work, since, concept, len(regexp_extract_all(t, a)) AS a, len(regexp_extract_all(t, b)) AS b FROM r, (VALUES {", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in NAMES)}) AS n(concept, a, b))
SELECT concept, CAST(since AS INTEGER) AS since, CAST(sum(a) AS BIGINT) AS left, CAST(sum(b) AS BIGINT) AS right, count(DISTINCT work) AS works, texts, CAST(words AS BIGINT) AS words FROM u JOIN w USING (since) WHERE a + b > 0 GROUP BY concept, since, texts, words""".replace(" AS left,", ' AS "left",').replace(" AS right,", ' AS "right",'))
def names_by_decade(t):
    """Uses of two names of a concept per decade, with the distinct works that use them."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.year("l_shipdate").alias("year"), "p_name")
    return A.names_by_span(rows, "p_name", "year", "l_orderkey", NAMES)


_NORM = r"trim(regexp_replace(replace(replace(replace(lower(x), 'ſ', 's'), 'æ', 'ae'), 'œ', 'oe'), '[^\p{L}]+', ' ', 'g'))"
_HEAD = r"regexp_extract(text, '\p{L}+')"


@BOOK.query("pool_overlap", f"""WITH d AS (SELECT doc_id, source, n_chars, {_NORM.replace('(x)', f'({_HEAD})')} AS term, substr({_NORM.replace('(x)', '(text)')}, 1, 240) AS context FROM documents WHERE text IS NOT NULL),
k AS (SELECT term, context, bool_or(quality = 1) AS yes, bool_or(quality <> 1) AS nay FROM d JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT source, term, context, count(*) AS n, sum(n_chars) AS total FROM d GROUP BY ALL)
SELECT source AS pool, CAST(sum(n) AS BIGINT) AS n, count(*) AS keys, count(*) FILTER (coalesce(yes, false)) AS in_positive, count(*) FILTER (coalesce(nay, false)) AS in_negative,
round((count(*) FILTER (coalesce(yes, false)) + count(*) FILTER (coalesce(nay, false)))::DOUBLE / count(*), 6) AS known, round(sum(total)::DOUBLE / sum(n), 6) AS mean_score FROM p LEFT JOIN k USING (term, context) GROUP BY 1""")
def pool_overlap(t):
    """The sources as pools of contexts, held against the labelled documents by term and context."""
    docs = t.documents.where("text is not null").select("doc_id", "source", "n_chars", F.regexp_extract("text", r"\p{L}+", 0).alias("term"), F.col("text").alias("context"))
    gold = docs.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    return A.pool_overlap(docs, gold, "source", "term", "context", "good", "n_chars")


# -- goals ----------------------------------------------------------------------------------------

#: Goal rules made up for the function words of these tables.
GOALS = O.GoalRules(
    cues=CUES,
    rules={
        "en": O.GoalRule(after=r"\b(?:of|with|in)\b", last=True, skip=("the", "and")), "de": O.GoalRule(before=r"\b(?:und|mit)\b"),
        "fr": O.GoalRule(skip=("les", "pour", "la")), "es": O.GoalRule(inherits=True),
    },
    stop=r"[,.;:!?()]|\b(?:that|was|dans|que|ist)\b",
)


@BOOK.query("unit_goals")
def unit_goals(t):
    """The goals of all units, and where they stand."""
    return O.unit_goals(t.documents, "text", GOALS, ["doc_id"]).drop("body")


@BOOK.query("goal_carry")
def goal_carry(t):
    """Goals with inheritance: units of a kind that states none take the last one before them."""
    return O.inherited(O.unit_goals(t.documents, "text", GOALS, ["doc_id"]).drop("body"), ["doc_id"]).select("doc_id", "ord", "kind", "goal", "goal_from")


@BOOK.query("goals_in_sql")
def goals_in_sql(t):
    """The same by a table function, joined laterally in SQL."""
    O.register_goals(t.spark, "lexi_goals", GOALS)
    return t.spark.sql("SELECT doc_id, ord, kind, goal FROM {docs}, LATERAL lexi_goals(text)", docs=t.documents.select("doc_id", "text"))


@BOOK.query("feasibility_goals")
def feasibility_goals(t):
    """Per source: how many units state a goal, and whether their bodies bear it out."""
    return O.reach(O.unit_goals(t.documents, "text", GOALS, ["doc_id", "source"]), ["source"])


@BOOK.query("feasibility_languages")
def feasibility_languages(t):
    """The same per language."""
    return O.reach(O.unit_goals(t.documents, "text", GOALS, ["doc_id", "lang"]), ["lang"])


@BOOK.query("feasibility_segments")
def feasibility_segments(t):
    """Per source: texts that fall into units, and the median of their number."""
    return O.segmentability(t.documents, G.cue_units(t.documents, "text", CUES, ["doc_id"]), "doc_id", ["source"])


@BOOK.query("candidate_spans")
def candidate_spans(t):
    """Runs of one to six words and parts of long words of every turn."""
    return G.candidates(t.conversations, "text", ["conv_id", "turn"])


# -- sieve and progress ---------------------------------------------------------------------------


@BOOK.query("sieved_cascade")
def sieved_cascade(t):
    """The cascade behind a fitted sieve: what each threshold saves and loses, which one is taken, and how the rows end."""
    labelled = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id", "left")
    model = C.fit_sieve(labelled, "text", "good")
    scored = stored(C.drop_scores(model, labelled.select("doc_id", "text", "good"), "text"), "scored")
    sweep = stored(C.sieve_sweep(scored, "good", [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98]), "sweep")
    limit = C.chosen_threshold(sweep, 0.02)
    rows = scored.select(F.col("doc_id").alias("id"), "text", "p_drop")
    out = C.cascade(rows, "text", F.col("p_drop") < F.lit(limit), C.stub(["NONE", "prepare", "store", "trade"]), stored)
    ends = out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    return ends.select(F.lit("outcome").alias("part"), F.col("outcome").alias("name"), "n", none.cast("long").alias("lost"), none.cast("double").alias("lost_share")).unionAll(
        sweep.select(F.when(F.col("threshold") == limit, "taken").otherwise("sweep"), F.col("threshold").cast("string"), "dropped", "lost", "lost_share")
    )


@BOOK.query("progress_rows", "SELECT 'events' AS name, CAST(0 AS BIGINT) AS batch, count(*) AS \"rows\", count(*) FILTER (event_type = 'error') AS errors FROM events UNION ALL SELECT 'labels', CAST(0 AS BIGINT), count(*), count(*) FILTER (toxic = 1) FROM labels")
def progress_rows(t):
    """Rows and errors of two jobs, observed while they wrote their tables."""
    seen = []
    for name, df, error in (("events", t.events, F.col("event_type") == "error"), ("labels", t.labels, F.col("toxic") == 1)):
        job = P.Progress(name)
        stored(job.watch(df, error), name)
        seen.append(job.row())
    return t.spark.createDataFrame(seen, P.SCHEMA).drop("rate")


@BOOK.query("stream_progress", "SELECT count(*) AS \"rows\", count(*) FILTER (event_type = 'error') AS errors FROM events")
def stream_progress(t):
    """Rows and errors of all micro-batches of a stream, told by a listener."""
    told, where = P.StreamProgress(), folder(t.spark)
    t.spark.streams.addListener(told)
    try:
        watched = told.watch(R.event_stream(t.spark, f"{t.sf_dir.rstrip('/')}/events.parquet"), F.col("event_type") == "error")
        query = watched.select("event_id").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        told.ended(query)
        rows = told.frame(t.spark)
    finally:
        t.spark.streams.removeListener(told)
    return rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
