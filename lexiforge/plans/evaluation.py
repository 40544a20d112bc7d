"""Metrics, vectors, nested data, markup, lexicon and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lexicon as L
from ..operators import metrics as E
from ..operators import vectors as V
from ..operators import windows as X
from .base import Book, stored

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: gold: a document's quality; pred: a rule on its length; cls: its language; size_class as a second label.
_SQL = """p AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN n_chars > 3000 THEN 'good' WHEN n_chars > 300 THEN 'bad' ELSE 'unseen' END AS pred,
toxic = 1 AS drop_gold, contains(text, '!') AS drop_pred, least(1.0, n_chars / 5000) AS score, n_chars FROM labels JOIN documents USING (doc_id))"""


def _pairs(t):
    rows = t.labels.join(t.documents, "doc_id")
    pred = T.ladder([(F.col("n_chars") > 3000, "good"), (F.col("n_chars") > 300, "bad")], "unseen")
    return rows.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), pred.alias("pred"), (F.col("toxic") == 1).alias("drop_gold"), F.col("text").contains("!").alias("drop_pred"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("score"), "n_chars")


def _r(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END, 6)"


_SCORES = f"""c AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(q) AS BIGINT) AS n_pred FROM (SELECT gold AS label, 1 AS g, 0 AS q, CAST(gold = pred AS INTEGER) AS tp FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p) GROUP BY 1)"""


@BOOK.query("prf_per_class", f"WITH {_SQL}, {_SCORES} SELECT *, {_r('tp', 'n_pred')} AS precision, {_r('tp', 'n_gold')} AS recall, {_r('2 * tp', 'n_gold + n_pred')} AS f1 FROM c")
def prf_per_class(t):
    return E.per_class(_pairs(t))


@BOOK.query("macro_f1", f"WITH {_SQL}, {_SCORES} SELECT round(avg(2 * tp / (n_gold + n_pred)), 6) AS macro_f1, count(*) AS labels, {_r('sum(tp)', 'sum(n_gold)')} AS accuracy FROM c WHERE n_gold > 0")
def macro_f1(t):
    return E.macro_f1(_pairs(t))


@BOOK.query("multi_run", f"WITH {_SQL} SELECT source AS run, n, accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, source) AS INTEGER) AS rank FROM (SELECT source, count(*) AS n, {_r('count(*) FILTER (WHERE gold = pred)', 'count(*)')} AS accuracy FROM p GROUP BY 1)")
def multi_run(t):
    """Runs (here: sources) by accuracy; the table of runs is small."""
    from pyspark.sql import Window as W

    runs = _pairs(t).groupBy(F.col("source").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("gold") == F.col("pred")) / F.count(F.lit(1)), 6).alias("accuracy"))
    return runs.withColumn("rank", F.row_number().over(W.orderBy(F.desc("accuracy"), "run")))


@BOOK.query("metrics_by_class", f"WITH {_SQL} SELECT lang, count(*) AS n, {_r('count(*) FILTER (WHERE NOT drop_gold AND NOT drop_pred)', 'count(*) FILTER (WHERE NOT drop_gold)')} AS keep_recall, {_r('count(*) FILTER (WHERE drop_gold AND drop_pred)', 'count(*) FILTER (WHERE drop_pred)')} AS drop_precision, {_r('count(*) FILTER (WHERE drop_gold = drop_pred)', 'count(*)')} AS accuracy FROM p GROUP BY 1")
def metrics_by_class(t):
    return E.operating_points(_pairs(t), ~F.col("drop_gold"), ~F.col("drop_pred"), ["lang"])


@BOOK.query("operating_points", f"WITH {_SQL} SELECT source, count(*) AS n, {_r('count(*) FILTER (WHERE NOT drop_gold AND NOT drop_pred)', 'count(*) FILTER (WHERE NOT drop_gold)')} AS keep_recall, {_r('count(*) FILTER (WHERE drop_gold AND drop_pred)', 'count(*) FILTER (WHERE drop_pred)')} AS drop_precision, {_r('count(*) FILTER (WHERE drop_gold = drop_pred)', 'count(*)')} AS accuracy FROM p GROUP BY 1")
def operating_points(t):
    return E.operating_points(_pairs(t), ~F.col("drop_gold"), ~F.col("drop_pred"), ["source"])


@BOOK.query("stage_metrics", f"""WITH {_SQL} SELECT lang, count(*) AS shared, {_r('count(*) FILTER (WHERE drop_gold = drop_pred)', 'count(*)')} AS stage_a, count(*) FILTER (WHERE NOT drop_gold AND NOT drop_pred) AS n_b, {_r('count(*) FILTER (WHERE NOT drop_gold AND NOT drop_pred AND gold = pred)', 'count(*) FILTER (WHERE NOT drop_gold AND NOT drop_pred)')} AS stage_b FROM p GROUP BY 1""")
def stage_metrics(t):
    """Stage A counts all shared ids, stage B only those that neither side dropped."""
    both = ~F.col("drop_gold") & ~F.col("drop_pred")
    n, n_b = F.count(F.lit(1)), F.count_if(both)
    return _pairs(t).groupBy("lang").agg(n.alias("shared"), F.round(F.count_if(F.col("drop_gold") == F.col("drop_pred")) / n, 6).alias("stage_a"), n_b.alias("n_b"), F.round(F.when(n_b > 0, F.count_if(both & (F.col("gold") == F.col("pred"))) / n_b).otherwise(0.0), 6).alias("stage_b"))


@BOOK.query("confusion", f"WITH {_SQL} SELECT lang, gold, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(t):
    return E.confusion(_pairs(t), by=["lang"])


@BOOK.query("confusion_cube", f"WITH {_SQL} SELECT coalesce(gold, 'ALL') AS gold, coalesce(pred, 'ALL') AS pred, count(*) AS n FROM p GROUP BY CUBE (gold, pred)")
def confusion_cube(t):
    return A.crosstab_margins(_pairs(t), "gold", "pred")


@BOOK.query("confused_pairs", f"WITH {_SQL} SELECT least(gold, pred) AS label_a, greatest(gold, pred) AS label_b, count(*) AS n FROM p WHERE gold <> pred GROUP BY ALL")
def confused_pairs(t):
    return E.confused_pairs(_pairs(t))


@BOOK.query("threshold_sweep", f"""WITH {_SQL}, s AS (SELECT p.*, threshold FROM p, (SELECT unnest([0.1, 0.25, 0.5, 0.9])::DOUBLE AS threshold))
SELECT threshold, coalesce(lang, 'ALL') AS lang, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS kept, count(*) FILTER (WHERE score >= threshold AND gold = 'good') AS hits,
{_r("count(*) FILTER (WHERE score >= threshold AND gold = 'good')", "count(*) FILTER (WHERE gold = 'good')")} AS recall, {_r("count(*) FILTER (WHERE score >= threshold AND gold = 'good')", "count(*) FILTER (WHERE score >= threshold)")} AS precision, {_r("count(*) FILTER (WHERE score < threshold)", "count(*)")} AS saved FROM s GROUP BY GROUPING SETS ((threshold, lang), (threshold))""")
def threshold_sweep(t):
    return E.threshold_sweep(_pairs(t), "score", F.col("gold") == "good", [0.1, 0.25, 0.5, 0.9], "lang")


_Z = 1.96


def _wilson(sign: str) -> str:
    return f"round((h / n + {_Z}::DOUBLE * {_Z} / (2 * n) {sign} {_Z}::DOUBLE * sqrt((h / n * (1 - h / n) + {_Z}::DOUBLE * {_Z} / (4 * n)) / n)) / (1 + {_Z}::DOUBLE * {_Z} / n), 6)"


@BOOK.query("wilson_ci", f"WITH {_SQL} SELECT lang, n, h AS hits, round(h / n, 6) AS rate, {_wilson('-')} AS low, {_wilson('+')} AS high FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS h FROM p GROUP BY 1)")
def wilson_ci(t):
    return E.rate_with_interval(_pairs(t), ["lang"], F.col("gold") == F.col("pred"))


@BOOK.query("accuracy_by_position", f"WITH {_SQL} SELECT stratum, n, h AS hits, round(h / n, 6) AS rate, {_wilson('-')} AS low, {_wilson('+')} AS high FROM (SELECT CASE WHEN n_chars < 500 THEN 'head' WHEN n_chars < 3000 THEN 'near' ELSE 'body' END AS stratum, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS h FROM p GROUP BY 1)")
def accuracy_by_position(t):
    stratum = T.ladder([(F.col("n_chars") < 500, "head"), (F.col("n_chars") < 3000, "near")], "body")
    return E.rate_with_interval(_pairs(t).withColumn("stratum", stratum), ["stratum"], F.col("gold") == F.col("pred"))


@BOOK.query("annotator_agreement", "SELECT l_orderkey, n, CASE WHEN d = n THEN 'all_dropped' WHEN d > 0 THEN 'dropped_split' WHEN k = 1 THEN 'agree' ELSE 'disagree' END AS state FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity < 5) AS d, count(DISTINCT l_returnflag) FILTER (WHERE l_quantity >= 5) AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 2)")
def annotator_agreement(t):
    return E.agreement(t.lineitem, "l_orderkey", "l_returnflag", F.col("l_quantity") < 5)


@BOOK.query("role_match", "SELECT p_partkey, exact, soft, CAST(exact AS INTEGER) + CAST(soft AS INTEGER) = 2 AS joint FROM (SELECT p_partkey, lower(p_name) = lower(p_type) AS exact, CASE WHEN a = '' AND b = '' THEN true WHEN a = '' OR b = '' THEN false ELSE contains(a, b) OR contains(b, a) END AS soft FROM (SELECT *, lower(trim(regexp_replace(p_name, '[^\\p{L}]+', ' ', 'g'))) AS a, CASE WHEN p_size % 7 = 0 THEN '' ELSE lower(trim(regexp_replace(substr(p_name, 1, 5), '[^\\p{L}]+', ' ', 'g'))) END AS b FROM part))".replace("\\\\", "\\"))
def role_match(t):
    """Exact and soft equality of two fields; joint is both."""
    other = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.substring("p_name", 1, 5))
    rows = t.part.select("p_partkey", (F.lower("p_name") == F.lower("p_type")).alias("exact"), T.soft_match(F.col("p_name"), other).alias("soft"))
    return rows.withColumn("joint", F.col("exact") & F.col("soft"))


@BOOK.query("field_agreement", "SELECT source, CASE WHEN a = 0 AND b = 0 THEN 'both_blank' WHEN a = 0 OR b = 0 THEN 'one_blank' WHEN a = b THEN 'agree' ELSE 'disagree' END AS status FROM (SELECT source, count(*) FILTER (WHERE quality = 0) AS a, count(*) FILTER (WHERE toxic = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def field_agreement(t):
    rows = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("source", T.ladder([((a == 0) & (b == 0), "both_blank"), ((a == 0) | (b == 0), "one_blank"), (a == b, "agree")], "disagree").alias("status"))


@BOOK.query("disagreements", f"WITH {_SQL} SELECT doc_id, gold, pred, lang FROM p WHERE gold <> pred")
def disagreements(t):
    return _pairs(t).where("gold <> pred").select("doc_id", "gold", "pred", "lang")


@BOOK.query("human_prior_model", f"""WITH {_SQL}, r AS (SELECT source, CASE WHEN 2 * count(*) FILTER (WHERE gold = 'good') >= count(*) THEN 'good' ELSE 'bad' END AS prior FROM p GROUP BY 1)
SELECT gold, prior, pred, count(*) AS n FROM p JOIN r USING (source) GROUP BY ALL""")
def human_prior_model(t):
    pairs = _pairs(t)
    prior = pairs.groupBy("source").agg(F.when(2 * F.count_if(F.col("gold") == "good") >= F.count(F.lit(1)), "good").otherwise("bad").alias("prior"))
    return pairs.join(prior, "source").groupBy("gold", "prior", "pred").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("pool_comparison", """SELECT lang, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS both, round(avg(n_chars) FILTER (WHERE a), 4) AS mean_a FROM (SELECT *, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b FROM documents) GROUP BY 1""")
def pool_comparison(t):
    a, b = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    return t.documents.groupBy("lang").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("both"), F.round(F.avg(F.when(a, F.col("n_chars"))), 4).alias("mean_a"))


@BOOK.query("token_f1", r"""WITH w AS (SELECT p.item_id, regexp_extract_all(lower(p.text), '\p{L}+') AS a, regexp_extract_all(lower(q.text), '\p{L}+') AS b FROM benchmark p JOIN benchmark q ON q.item_id = p.item_id + 1),
s AS (SELECT item_id, sum(least(x.n, y.n)) AS shared FROM (SELECT item_id, tok, count(*) AS n FROM (SELECT item_id, unnest(a) AS tok FROM w) GROUP BY ALL) x JOIN (SELECT item_id, tok, count(*) AS n FROM (SELECT item_id, unnest(b) AS tok FROM w) GROUP BY ALL) y USING (item_id, tok) GROUP BY 1)
SELECT item_id, round(coalesce(2.0::DOUBLE * shared / (len(a) + len(b)), 0), 6) AS f1 FROM w LEFT JOIN s USING (item_id)""")
def token_f1(t):
    """Each item's words against those of the next."""
    following = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return t.benchmark.join(following, "item_id").select("item_id", F.round(T.token_f1(T.tokens(F.col("text")), T.tokens(F.col("next"))), 6).alias("f1"))


@BOOK.query("span_qa", f"""WITH {_SQL} SELECT CASE WHEN drop_gold THEN 'empty' ELSE 'positive' END AS side, count(*) AS n, round(avg(CAST(gold = pred AS INTEGER)), 6) AS em, round(avg(CASE WHEN drop_gold = drop_pred THEN score ELSE 0 END), 6) AS soft FROM p GROUP BY 1""")
def span_qa(t):
    rows = _pairs(t).withColumn("side", F.when(F.col("drop_gold"), "empty").otherwise("positive"))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("em"), F.round(F.avg(F.when(F.col("drop_gold") == F.col("drop_pred"), F.col("score")).otherwise(0.0)), 6).alias("soft"))


_ANSWERS = r"""SELECT lang AS field, g, p, [x FOR x IN regexp_extract_all(lower(g), '\p{L}+')] AS a, [x FOR x IN regexp_extract_all(lower(p), '\p{L}+')] AS b FROM (SELECT lang, regexp_extract(text, '[A-Z]\w+ \w+ \w+') AS g, CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_extract(text, '[A-Z]\w+ \w+') END AS p FROM documents)"""
_NORM = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}]+', ' ', 'g'))"


@BOOK.query("span_answers", f"""WITH r AS ({_ANSWERS}), n AS (SELECT *, {_NORM('g')} AS x, {_NORM('p')} AS y FROM r), s AS (SELECT field, g <> '' AS pos, CAST(x = y AS DOUBLE) AS exact,
CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(list_sum([least(len(list_filter(a, lambda z: z = w)), len(list_filter(b, lambda z: z = w))) FOR w IN list_distinct(a)]), 0) / (len(a) + len(b)) END AS f1,
CAST(CASE WHEN x = '' AND y = '' THEN true WHEN x = '' OR y = '' THEN false ELSE contains(x, y) OR contains(y, x) END AS DOUBLE) AS soft FROM n)
SELECT field, count(*) AS n, count(*) FILTER (WHERE pos) AS n_positive, round(avg(exact), 6) AS exact, round(avg(f1), 6) AS f1, round(avg(soft), 6) AS soft,
round(avg(exact) FILTER (WHERE pos), 6) AS positive_exact, round(avg(f1) FILTER (WHERE pos), 6) AS positive_f1, round(avg(soft) FILTER (WHERE pos), 6) AS positive_soft FROM s GROUP BY 1""")
def span_answers(t):
    """Answers cut from texts against predicted ones that are shorter or missing."""
    gold = F.regexp_extract("text", r"[A-Z]\w+ \w+ \w+", 0)
    pred = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.regexp_extract("text", r"[A-Z]\w+ \w+", 0))
    return E.span_scores(t.documents.select("lang", gold.alias("g"), pred.alias("p")), "g", "p", "lang")


@BOOK.query("boundary_score", """WITH g AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS a FROM events WHERE event_type = 'signup'), q AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS b FROM events WHERE event_type = 'purchase'),
h AS (SELECT user_id, a, b FROM g JOIN q USING (user_id) WHERE abs(a - b) <= 43200) SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM q) AS n_pred, (SELECT count(*) FROM (SELECT DISTINCT user_id, a FROM h)) AS gold_hit, (SELECT count(*) FROM (SELECT DISTINCT user_id, b FROM h)) AS pred_hit""")
def boundary_score(t):
    """Boundaries that have a partner within a tolerance."""
    from ..operators.joins import band_join

    at = T.whole_seconds(F.col("ts"))
    g = t.events.where("event_type = 'signup'").select("user_id", at.alias("a"))
    q = t.events.where("event_type = 'purchase'").select("user_id", at.alias("b"))
    h = band_join(g, q, ["user_id"], "a", "b", 43200)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(g, "n_gold").join(one(q, "n_pred")).join(one(h.select("user_id", "a").distinct(), "gold_hit")).join(one(h.select("user_id", "b").distinct(), "pred_hit"))  # single rows


@BOOK.query("funnel", "SELECT unnest(['all', 'text', 'long', 'english']) AS stage, unnest([count(*), count(*) FILTER (WHERE text <> ''), count(*) FILTER (WHERE text <> '' AND n_chars > 500), count(*) FILTER (WHERE text <> '' AND n_chars > 500 AND lang = 'en')]) AS n, unnest([0, 1, 2, 3]) AS place FROM documents")
def funnel(t):
    return E.funnel(t.documents, [("text", F.col("text") != ""), ("long", F.col("n_chars") > 500), ("english", F.col("lang") == "en")])


@BOOK.query("filter_report", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 50 THEN 'short' WHEN source IN ('src1', 'src2') THEN 'denylist' WHEN quality = 0 THEN 'prior' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def filter_report(t):
    return _filtered(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _filtered(t):
    deny = t.spark.createDataFrame([("src1", True), ("src2", True)], "source string, denied boolean")
    rows = t.documents.join(F.broadcast(deny), "source", "left").join(t.labels, "doc_id", "left")  # deny: a parameter
    return rows.withColumn("reason", T.ladder([(F.col("n_chars") < 50, "short"), (F.col("denied"), "denylist"), (F.col("quality") == 0, "prior")], "kept"))


@BOOK.query("denylist_filter", "SELECT doc_id, toxic = 1 AS soft FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 50 AND source NOT IN ('src1', 'src2') AND coalesce(quality, 1) <> 0")
def denylist_filter(t):
    return _filtered(t).where("reason = 'kept'").select("doc_id", (F.col("toxic") == 1).alias("soft"))


@BOOK.query("scope_gate", "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src3') AND NOT (lang = 'fr' AND source = 'src4')")
def scope_gate(t):
    out = t.spark.createDataFrame([("en", "src3"), ("fr", "src4")], "lang string, source string")
    return t.documents.join(F.broadcast(out), ["lang", "source"], "left_anti").select("doc_id")  # out: a parameter


@BOOK.query("tag_filter", "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_type), ' '), ['economy', 'small'])")
def tag_filter(t):
    return t.part.where(F.arrays_overlap(T.tag_set(F.replace("p_type", F.lit(" "), F.lit("|"))), F.array(F.lit("economy"), F.lit("small")))).select("p_partkey")


@BOOK.query("vocabulary_semi", r"SELECT p_partkey FROM part WHERE lower(trim(regexp_replace(p_brand, '[^\p{L}]+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(p_brand, '[^\p{L}]+', ' ', 'g'))) FROM part WHERE p_size < 3)")
def vocabulary_semi(t):
    lookup = t.part.where("p_size < 3").select(T.normal(F.col("p_brand")).alias("k")).distinct()
    return t.part.withColumn("k", T.normal(F.col("p_brand"))).join(lookup, "k", "left_semi").select("p_partkey")


@BOOK.query("whole_word_terms", r"SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) WHERE term IN ('that', 'with', 'und', 'pour')")
def whole_word_terms(t):
    vocabulary = t.spark.createDataFrame([("that",), ("with",), ("und",), ("pour",)], "term string")
    words = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return words.join(F.broadcast(vocabulary), "term").select("doc_id", "term")  # a parameter


@BOOK.query("nearest_pick", r"""WITH w AS (SELECT doc_id, w, CAST(unnest(range(len(w))) AS BIGINT) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)), h AS (SELECT doc_id, i, w[i + 1] AS term FROM w WHERE w[i + 1] IN ('that', 'with', 'was', 'for'))
SELECT doc_id, arg_min(term, (CAST(i < 100 AS INTEGER), abs(i - 100), i)) AS term FROM h GROUP BY 1""")
def nearest_pick(t):
    """The hit nearest to an anchor, those at or after it first."""
    hits = t.documents.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "term")).where(F.col("term").isin("that", "with", "was", "for"))
    return hits.groupBy("doc_id").agg(F.min_by("term", F.struct((F.col("i") < 100).cast("int"), F.abs(F.col("i") - 100), "i")).alias("term"))


@BOOK.query("year_bins", "SELECT o_orderkey, y AS year, y // 10 * 10 AS decade, y // 25 * 25 AS quarter_century, CAST(y // 100 + 1 AS VARCHAR) || 'th' AS century FROM (SELECT o_orderkey, CAST(regexp_extract(CAST(o_orderdate AS VARCHAR), '(1[2-9][0-9][0-9]|20[0-9][0-9])', 1) AS INTEGER) AS y FROM orders)")
def year_bins(t):
    rows = t.orders.select("o_orderkey", T.year_of(F.col("o_orderdate").cast("string")).alias("year"))
    return rows.select("o_orderkey", "year", T.floor_to(F.col("year"), 10).alias("decade"), T.floor_to(F.col("year"), 25).alias("quarter_century"), F.concat((F.floor(F.col("year") / 100) + 1).cast("string"), F.lit("th")).alias("century"))


@BOOK.query("tolerant_bool", "SELECT event_id, CASE WHEN v IN ('true', '1', 'yes', 'y', 'ja', 'x') THEN true WHEN v IN ('false', '0', 'no', 'n', 'nee') THEN false END AS flag FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ja' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '' ELSE 'maybe' END AS v FROM events)")
def tolerant_bool(t):
    raw = T.ladder([(F.col("event_id") % 5 == i, v) for i, v in enumerate((" Ja", "NO", "1", ""))], "maybe")
    return t.events.select("event_id", T.tolerant_bool(raw).alias("flag"))


@BOOK.query("slug_ids", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM pages")
def slug_ids(t):
    return t.pages.select("page_id", T.slug(F.col("url")).alias("id"))


@BOOK.query("legacy_alias", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS label, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE lower(c_mktsegment) END AS kind FROM customer")
def legacy_alias(t):
    new = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.coalesce(F.nullif(new, F.lit("")), "c_name").alias("label"), F.coalesce(T.mapped(F.col("c_mktsegment"), {"BUILDING": "works", "MACHINERY": "works"}), F.lower("c_mktsegment")).alias("kind"))


@BOOK.query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS missing FROM events")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNull().alias("missing"))


@BOOK.query("flatten_nested", "SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS customer_segment, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS role FROM orders JOIN customer ON o_custkey = c_custkey")
def flatten_nested(t):
    nested = _nested(t)
    return nested.select("o_orderkey", F.col("customer.name").alias("customer_name"), F.col("customer.segment").alias("customer_segment"), F.when(F.col("step.frame") == "F", F.col("step.role")).otherwise("").alias("role"))


def _nested(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"), F.struct(F.col("o_orderstatus").alias("frame"), F.col("o_orderpriority").alias("role")).alias("step"))


@BOOK.query("rebuild_nested", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus || ':' || o_orderpriority END AS annotation FROM orders WHERE o_orderstatus <> 'O'")
def rebuild_nested(t):
    """Flat rows to a nested record and back through JSON; unlabelled rows vanish."""
    labelled = _nested(t).where("step.frame <> 'O'").select("o_orderkey", F.to_json("step").alias("json"))
    back = labelled.select("o_orderkey", F.from_json("json", "frame string, role string").alias("s"))
    return back.select("o_orderkey", F.when(F.col("s.frame") != "P", F.concat_ws(":", "s.frame", "s.role")).alias("annotation"))


@BOOK.query("list_literal_parse", "SELECT p_partkey, list_distinct([lower(x) FOR x IN string_split(p_type, ' ')])[1] AS first_term, len(list_distinct([lower(x) FOR x IN string_split(p_type, ' ')])) AS n FROM part")
def list_literal_parse(t):
    literal = F.concat(F.lit("['"), F.replace("p_type", F.lit(" "), F.lit("', '")), F.lit("']"))
    terms = F.array_distinct(F.transform(T.parse_list(literal), lambda x: F.lower(x)))
    return t.part.select("p_partkey", terms.alias("terms")).select("p_partkey", F.col("terms")[0].alias("first_term"), F.size("terms").cast("long").alias("n"))


@BOOK.query("wide_to_long", "SELECT p_partkey, unnest(list_distinct(string_split(lower(p_type), ' '))) AS term FROM part")
def wide_to_long(t):
    return t.part.select("p_partkey", F.explode(F.array_distinct(F.filter(F.split(F.lower("p_type"), " "), lambda x: x != ""))).alias("term"))


@BOOK.query("alias_explode", "SELECT p_brand AS pref, p_brand AS alias, 'pref' AS kind FROM part UNION ALL SELECT p_brand, unnest(string_split(p_name, ' ')), 'alt' FROM part")
def alias_explode(t):
    pref = t.part.select(F.col("p_brand").alias("pref"), F.col("p_brand").alias("alias"), F.lit("pref").alias("kind"))
    return pref.unionAll(t.part.select("p_brand", F.explode(F.split("p_name", " ")), F.lit("alt")))


@BOOK.query("training_labels", "SELECT doc_id, CASE WHEN n_chars < 50 THEN 'skip' WHEN toxic = 1 THEN 'NONE' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN n_chars < 50 THEN NULL WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS label_id FROM documents JOIN labels USING (doc_id)")
def training_labels(t):
    label = T.ladder([(F.col("n_chars") < 50, "skip"), (F.col("toxic") == 1, "NONE"), (F.col("quality") == 1, "good")], "bad")
    ids = t.spark.createDataFrame([("NONE", 0), ("bad", 1), ("good", 2)], "label string, label_id int")
    return t.documents.join(t.labels, "doc_id").select("doc_id", label.alias("label")).join(F.broadcast(ids), "label", "left")  # a parameter


@BOOK.query("qa_examples", "SELECT p_partkey, role, answer, instr(lower(p_name), lower(answer)) AS place FROM (SELECT p_partkey, p_name, 'brand' AS role, p_brand AS answer FROM part UNION ALL SELECT p_partkey, p_name, 'head', string_split(p_name, ' ')[1] FROM part) WHERE contains(lower(p_name), lower(answer))")
def qa_examples(t):
    """One row per record and role; answers that the text does not hold are rejected."""
    roles = F.explode(F.array(F.struct(F.lit("brand").alias("role"), F.col("p_brand").alias("answer")), F.struct(F.lit("head").alias("role"), F.element_at(F.split("p_name", " "), 1).alias("answer"))))
    rows = t.part.select("p_partkey", "p_name", roles.alias("x")).select("p_partkey", "p_name", "x.role", "x.answer")
    return rows.withColumn("place", F.expr("locate(lower(answer), lower(p_name))").cast("long")).where("place > 0").drop("p_name")


_HELD = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(trim(b.text))) WHERE trim(b.text) <> ''"


@BOOK.query("grounding", _HELD)
def grounding(t):
    """Every document with each whole item that it holds."""
    items = t.benchmark.select("item_id", F.col("text").alias("item"))
    return J.found_values(t.documents.select("doc_id", "text"), items, "doc_id", "text", "item").select("doc_id", "item_id")


BOOK.query("grounding_all", _HELD)(grounding)  # its name while the plain one tried one item a document


@BOOK.query("strip_tags", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM pages""")
def strip_tags(t):
    return t.pages.select("page_id", T.strip_tags(F.col("html")).alias("body"))


@BOOK.query("note_append", "SELECT o_orderkey, concat_ws('; ', nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END, ''), 'checked') AS note FROM orders")
def note_append(t):
    old = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.concat_ws("; ", F.nullif(old, F.lit("")), F.lit("checked")).alias("note"))


@BOOK.query("scheme_priority", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_brand END, CASE WHEN p_size > 20 THEN p_type END, 'none') AS value, CASE WHEN p_size > 40 THEN 'brand' WHEN p_size > 20 THEN 'type' END AS scheme FROM part")
def scheme_priority(t):
    """The first value in a fixed order of schemes, from an array of claims."""
    claims = F.array_compact(F.array(F.when(F.col("p_size") > 40, F.struct(F.lit("brand").alias("scheme"), F.col("p_brand").alias("value"))), F.when(F.col("p_size") > 20, F.struct(F.lit("type").alias("scheme"), F.col("p_type").alias("value")))))
    first = t.part.select("p_partkey", F.get(claims, F.lit(0)).alias("c"))
    return first.select("p_partkey", F.coalesce("c.value", F.lit("none")).alias("value"), F.col("c.scheme").alias("scheme"))


# -- vectors --------------------------------------------------------------------------------------


@BOOK.query("l2_norm", "SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 5) AS norm FROM embeddings")
def l2_norm(t):
    return t.embeddings.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@BOOK.query("centroids", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL")
def centroids(t):
    return V.centroids(t.embeddings, "label", "embedding").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 5))


_VEC = "u AS (SELECT vec_id, label, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings)"


@BOOK.query("cosine_topk", f"WITH {_VEC}, s AS (SELECT a.vec_id, b.vec_id AS query, round(list_dot_product(a.v, b.v), 5) AS score FROM u a, (SELECT * FROM u WHERE vec_id % 100 = 0) b WHERE a.vec_id <> b.vec_id) SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10")
def cosine_topk(t):
    """Every vector whose id is divisible by 100 against all vectors."""
    return V.most_similar(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 10, 5).select("query", "vec_id", "score")


_LOO = f"WITH {_VEC}, s AS (SELECT a.vec_id, b.vec_id AS exemplar, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, exemplar, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, exemplar) AS r FROM s) WHERE r = 1"


@BOOK.query("loo_nearest_all", _LOO)
@BOOK.query("loo_nearest", _LOO)
def loo_nearest(t):
    """Every vector against all others of its label, by clusters with bounds."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("field"), F.col("embedding").alias("v"))
    near = V.nearest_in_clusters(rows.select(F.col("id").alias("query"), F.col("id").alias("own"), "field", "v"), rows, stored)
    return near.select(F.col("query").alias("vec_id"), F.col("id").alias("exemplar"), "score")


@BOOK.query("retrieve_margin", f"""WITH {_VEC}, c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_dot_product(u.v, c.v) / sqrt(list_dot_product(c.v, c.v)), 6) AS score FROM u, c), g AS (SELECT a.vec_id, a.label, a.score - n.score AS gap FROM s a JOIN s n ON a.vec_id = n.vec_id AND n.label = 0 WHERE a.label <> 0),
m AS (SELECT *, gap >= 0.2 AS passed, count(*) FILTER (WHERE gap >= 0.2) OVER (PARTITION BY label) AS k FROM g) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY passed DESC, round(gap, 6) DESC, vec_id) AS r FROM m WHERE passed OR k < 2.0) WHERE r <= 8""")
def retrieve_margin(t):
    centres = V.centroids(t.embeddings, "label", "embedding")
    scored = V.scores_against(t.embeddings, "vec_id", "embedding", centres, "label", "centroid").withColumn("score", F.round("score", 6))
    return V.retrieve(scored, "vec_id", 0, 0.2, 8).select(F.col("label").cast("int").alias("label"), "vec_id")


_CENTRES = "c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)"


_HYBRID = f"""WITH {_VEC}, {_CENTRES}, s AS (SELECT u.vec_id, c.label, round(list_dot_product(u.v, c.v) / sqrt(list_dot_product(c.v, c.v)), 5) AS gap FROM u, c),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap DESC, label) AS r FROM s) WHERE r = 1), t AS (SELECT vec_id, label, CASE WHEN gap >= 0.1 AND vec_id % 3 = 0 THEN 0 WHEN gap >= 0.1 THEN 1 ELSE 2 END AS tier, gap FROM b)
SELECT vec_id, label, tier FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, gap DESC, vec_id) AS r FROM t) WHERE r <= 15"""


@BOOK.query("hybrid_candidates_all", _HYBRID)
@BOOK.query("hybrid_candidates", _HYBRID)
def hybrid_candidates(t):
    """With the class centroids as labels: anchored rows first, then semantic ones, then those deferred by the margin."""
    centres = V.centroids(t.embeddings, "label", "embedding")
    scored = V.scores_against(t.embeddings, "vec_id", "embedding", centres, "label", "centroid", top=1, digits=5).withColumn("gap", F.round("score", 5))
    return V.hybrid(scored, "vec_id", t.embeddings.where("vec_id % 3 = 0"), 0.1, 15).select("vec_id", "label", "tier")


@BOOK.query("mean_pool", "SELECT label, CAST(i AS INTEGER) AS i, count(*) FILTER (WHERE keep) AS n, round(coalesce(avg(x) FILTER (WHERE keep), 0), 5) AS x FROM (SELECT label, vec_id % 3 > 0 AS keep, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL")
def mean_pool(t):
    """Each label's rows as its tokens, under a mask."""
    pooled = V.mean_pool(t.embeddings.withColumn("keep", F.col("vec_id") % 3 > 0), "label", "embedding", "keep")
    return pooled.select("label", "n", F.posexplode("pooled").alias("i", "x")).select("label", "i", "n", F.round("x", 5).alias("x"))


# -- lexicon and lineage --------------------------------------------------------------------------


@BOOK.query("alias_index", """WITH a AS (SELECT p_partkey, lower(p_name) AS alias, 1 AS rank FROM part UNION ALL SELECT p_partkey, lower(p_type), 2 FROM part), b AS (SELECT alias, p_partkey, min(rank) AS rank FROM a GROUP BY ALL)
SELECT alias, arg_min(p_partkey, (rank, p_partkey)) AS key, count(*) AS keys, len(string_split(alias, ' ')) AS words FROM b GROUP BY alias""")
def alias_index(t):
    """alias -> the key of its best source, how many keys it may mean, and its length in words."""
    one = lambda c, rank: t.part.select("p_partkey", F.col(c).alias("alias"), F.lit(rank).alias("rank"))
    return L.alias_index(one("p_name", 1).unionAll(one("p_type", 2)), "p_partkey")


@BOOK.query("trigger_merge", """WITH s AS (SELECT p_name AS form, p_brand AS frame, 1 AS prio, 'seed' AS src FROM part WHERE p_size < 20 UNION ALL SELECT p_name, p_brand, 2, 'corpus' FROM part WHERE p_size >= 10), d AS (SELECT p_name AS form FROM part WHERE p_size > 48)
SELECT form, arg_min(frame, (prio, frame)) AS frame, array_to_string(list_sort(list_distinct(list(src))), '|') AS sources FROM s WHERE form NOT IN (SELECT form FROM d) GROUP BY 1""")
def trigger_merge(t):
    """First frame by priority, union of sources, reviewed drops removed."""
    part = lambda where, prio, src: t.part.where(where).select(F.col("p_name").alias("form"), F.col("p_brand").alias("frame"), F.lit(prio).alias("prio"), F.lit(src).alias("src"))
    rows = part("p_size < 20", 1, "seed").unionAll(part("p_size >= 10", 2, "corpus"))
    drops = t.part.where("p_size > 48").select(F.col("p_name").alias("form"))
    return rows.join(drops, "form", "left_anti").groupBy("form").agg(F.min_by("frame", F.struct("prio", "frame")).alias("frame"), F.array_join(F.array_sort(F.collect_set("src")), "|").alias("sources"))


@BOOK.query("candidate_forms", "SELECT p_type AS form, count(*) AS n, count(DISTINCT p_brand) AS generators, array_to_string(list_sort(list_distinct(list(p_name)))[1:3], '|') AS examples FROM part GROUP BY 1")
def candidate_forms(t):
    counts = t.part.groupBy(F.col("p_type").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("generators"))
    return counts.join(A.first_values(t.part.withColumnRenamed("p_type", "form"), ["form"], "p_name", 3, "examples"), "form")


@BOOK.query("auto_keep", "SELECT c_custkey, manual = 'yes' OR (auto AND manual <> 'no') AS keep FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS manual, c_acctbal > 0 AS auto FROM customer)")
def auto_keep(t):
    rows = t.customer.select("c_custkey", T.ladder([(F.col("c_custkey") % 3 == 0, "yes"), (F.col("c_custkey") % 3 == 1, "no")], "").alias("manual"), (F.col("c_acctbal") > 0).alias("auto"))
    return rows.select("c_custkey", ((F.col("manual") == "yes") | (F.col("auto") & (F.col("manual") != "no"))).alias("keep"))


@BOOK.query("glossary_lookup", """WITH g AS (SELECT lower(p_type) AS alias, min(p_brand) AS entry FROM part GROUP BY 1 UNION ALL SELECT lower(p_name), min(p_brand) FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p_partkey, coalesce(w.entry, h.entry) AS entry, CASE WHEN w.entry IS NOT NULL THEN 'whole' WHEN h.entry IS NOT NULL THEN 'head' ELSE '' END AS by FROM part LEFT JOIN g w ON lower(trim(p_name)) = w.alias LEFT JOIN g h ON lower(string_split(trim(p_name), ' ')[1]) = h.alias""")
def glossary_lookup(t):
    """A term's glossary entry by its whole name, else by its first word."""
    part = lambda df, c: df.groupBy(F.lower(c).alias("alias")).agg(F.min("p_brand").alias("entry"))
    return L.glossary_lookup(t.part, "p_name", part(t.part, "p_type").unionAll(part(t.part.where("p_size > 45"), "p_name"))).select("p_partkey", "entry", "by")


_CATALOG = "c(name, parent, mirror_of, recorded, live) AS (VALUES ('raw', NULL, NULL, 'a', 'a'), ('clean', 'raw', NULL, 'b', 'b'), ('tokens', 'clean', NULL, 'c', 'c'), ('clean_copy', 'clean', 'clean', 'b', 'x'), ('loop_a', 'loop_b', NULL, 'd', 'd'), ('loop_b', 'loop_a', NULL, 'e', 'e'))"


@BOOK.query("lineage_chain", f"WITH RECURSIVE {_CATALOG}, chain AS (SELECT name AS child, name AS node, parent, 0 AS depth FROM c UNION ALL SELECT chain.child, c.name, c.parent, depth + 1 FROM chain JOIN c ON chain.parent = c.name WHERE depth < 8 AND c.name <> chain.child) SELECT child, node, depth FROM chain")
def lineage_chain(t):
    from ..sources.lineage import chain

    return chain(_catalog(t))


@BOOK.query("mirror_stale", f"WITH {_CATALOG} SELECT m.name, m.mirror_of, m.live <> s.recorded AS stale FROM c m JOIN c s ON m.mirror_of = s.name")
def mirror_stale(t):
    from ..sources.lineage import stale_mirrors

    return stale_mirrors(_catalog(t))


def _catalog(t):
    rows = [("raw", None, None, "a", "a"), ("clean", "raw", None, "b", "b"), ("tokens", "clean", None, "c", "c"), ("clean_copy", "clean", "clean", "b", "x"), ("loop_a", "loop_b", None, "d", "d"), ("loop_b", "loop_a", None, "e", "e")]
    return t.spark.createDataFrame(rows, "name string, parent string, mirror_of string, recorded string, live string")
