"""Projections, gates, adapters and the alias table over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from ..operators import windows as X
from .base import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


@BOOK.query("bundle_explode", "SELECT p_partkey, unnest(CASE WHEN contains(p_type, ' ') THEN string_split(p_type, ' ') ELSE [p_type] END) AS category FROM part")
def bundle_explode(t):
    bundle = F.when(F.col("p_type").contains(" "), F.split("p_type", r"\s+")).otherwise(F.array("p_type"))
    return t.part.select("p_partkey", F.explode(bundle).alias("category"))


@BOOK.query("flagged_projection", "SELECT coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), p_type) AS label, p_brand AS category, 'part' AS source FROM part WHERE p_size > 10")
def flagged_projection(t):
    stem = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    return t.part.where("p_size > 10").select(F.coalesce(F.nullif(stem, F.lit("")), "p_type").alias("label"), F.col("p_brand").alias("category"), F.lit("part").alias("source"))


@BOOK.query("labelling_rows", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic, '' AS verdict FROM documents d LEFT JOIN labels USING (doc_id)")
def labelling_rows(t):
    """Review rows: nulls as empty text, blank columns to fill in."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", blank("quality"), blank("toxic"), F.lit("").alias("verdict"))


_ADAPT = """SELECT 'doc' || doc_id AS record_id, source AS corpus, CASE WHEN n_chars < 20 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN NOT regexp_matches(text, ' ') THEN 'one_word' END AS reject FROM documents"""


def _adapted(t):
    reject = T.ladder([(F.col("n_chars") < 20, "too_short"), (~F.col("lang").isin("en", "de"), "language"), (~F.col("text").contains(" "), "one_word")])
    return t.documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source").alias("corpus"), reject.alias("reject"))


@BOOK.query("adapter_rows", f"SELECT record_id, corpus FROM ({_ADAPT}) WHERE reject IS NULL")
def adapter_rows(t):
    return _adapted(t).where("reject is null").select("record_id", "corpus")


@BOOK.query("adapter_rejects", f"SELECT record_id, reject FROM ({_ADAPT}) WHERE reject IS NOT NULL")
def adapter_rejects(t):
    return _adapted(t).where("reject is not null").select("record_id", "reject")


@BOOK.query("few_shot_rows", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'NONE' WHEN quality = 1 THEN 'keep' ELSE 'check' END AS teach, sheet FROM (SELECT *, 'a' AS sheet FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT *, 'b' FROM labels WHERE doc_id % 2 = 1)")
def few_shot_rows(t):
    sheets = t.labels.where("doc_id % 2 = 0").withColumn("sheet", F.lit("a")).unionByName(t.labels.where("doc_id % 2 = 1").withColumn("sheet", F.lit("b")))
    return sheets.select("doc_id", T.ladder([(F.col("toxic") == 1, "NONE"), (F.col("quality") == 1, "keep")], "check").alias("teach"), "sheet")


@BOOK.query("allow_list", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def allow_list(t):
    return t.documents.where(F.col("lang").isin("en", "fr")).select("doc_id")


@BOOK.query("trust_gate", "SELECT p_partkey FROM part WHERE (list_contains(string_split(p_type, ' '), 'ECONOMY') AND p_size > 10) OR list_has_any(string_split(p_type, ' '), ['SMALL', 'STANDARD'])")
def trust_gate(t):
    flags = F.split("p_type", " ")
    return t.part.where((F.array_contains(flags, "ECONOMY") & (F.col("p_size") > 10)) | F.arrays_overlap(flags, F.array(F.lit("SMALL"), F.lit("STANDARD")))).select("p_partkey")


@BOOK.query("dropout_rule", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'metaphor' WHEN quality = 0 THEN 'not_entity' END AS reason, toxic = 1 OR quality = 0 AS dropped FROM labels")
def dropout_rule(t):
    reason = T.ladder([(F.col("toxic") == 1, "metaphor"), (F.col("quality") == 0, "not_entity")])
    return t.labels.select("doc_id", reason.alias("reason"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("dropped"))


_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents"


@BOOK.query("word_kind_ladder", f"SELECT token, CASE WHEN token IN ('the', 'und', 'les', 'que') THEN 'stop' WHEN suffix(token, 'en') AND length(token) > 4 THEN 'verb' WHEN token IN ('in', 'on', 'of', 'mit') THEN 'prep' WHEN suffix(token, 'ble') OR suffix(token, 'ly') THEN 'adj' ELSE 'other' END AS kind FROM ({_WORDS})")
def word_kind_ladder(t):
    token = t.documents.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).distinct()
    ends = lambda s: F.endswith("token", F.lit(s))
    rules = [(F.col("token").isin("the", "und", "les", "que"), "stop"), (ends("en") & (F.length("token") > 4), "verb"), (F.col("token").isin("in", "on", "of", "mit"), "prep"), (ends("ble") | ends("ly"), "adj")]
    return token.select("token", T.ladder(rules, "other").alias("kind"))


@BOOK.query("indication_matcher", r"SELECT doc_id, len(regexp_extract_all(lower(text), '(the \p{L}+ of|in \p{L}+ with|zu \p{L}+en)')) AS n FROM documents WHERE regexp_matches(lower(text), '(the \p{L}+ of|in \p{L}+ with|zu \p{L}+en)')")
def indication_matcher(t):
    """Occurrences of multi-word constructions."""
    found = F.regexp_count(F.lower("text"), F.lit(r"(the \p{L}+ of|in \p{L}+ with|zu \p{L}+en)"))
    return t.documents.select("doc_id", found.cast("long").alias("n")).where("n > 0")


@BOOK.query("pair_join", "SELECT a.o_orderkey, a.o_orderstatus AS label, b.o_orderpriority AS label_ctx FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE b.o_totalprice > 100000")
def pair_join(t):
    ctx = t.orders.where("o_totalprice > 100000").select("o_orderkey", F.col("o_orderpriority").alias("label_ctx"))
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("label")).join(ctx, "o_orderkey")


@BOOK.query("gold_left_join", "SELECT d.doc_id, coalesce(a.quality, b.quality, 0) AS pred FROM documents d LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) a USING (doc_id) LEFT JOIN (SELECT doc_id - 1 AS doc_id, quality FROM labels WHERE doc_id % 2 = 1) b USING (doc_id)")
def gold_left_join(t):
    """Predictions by id, else by a variant of it; a missing one is a miss."""
    exact = t.labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("q1"))
    variant = t.labels.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("q2"))
    return t.documents.join(exact, "doc_id", "left").join(variant, "doc_id", "left").select("doc_id", F.coalesce("q1", "q2", F.lit(0)).alias("pred"))


@BOOK.query("localised_text", "SELECT item_id, doc_id, instr(d.text, b.text) AS at FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def localised_text(t):
    from ..operators.joins import contains_join

    hits = contains_join(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("needle")), "doc_id", "text", "needle")
    return hits.select("item_id", "doc_id", F.expr("locate(needle, text)").cast("long").alias("at"))


@BOOK.query("best_per_chunk", "SELECT conv_id, role, len FROM (SELECT conv_id, role, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, role, turn) AS r FROM conversations) WHERE r = 1")
def best_per_chunk(t):
    best = X.first_of(t.conversations.withColumn("len", F.length("text")), ["conv_id"], [F.desc("len"), "role", "turn"])
    return best.select("conv_id", "role", F.col("len").cast("long").alias("len"))


@BOOK.query("passage_sample", "SELECT doc_id, tag, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, lang AS tag, row_number() OVER (PARTITION BY lang ORDER BY CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT), doc_id) AS turn FROM documents) ORDER BY turn, tag LIMIT 40")
def passage_sample(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("tag"))
    return X.round_robin(rows, ["tag"], [T.hash_order(F.col("doc_id")), "doc_id"], 40, ["tag"])


@BOOK.query("cross_source_dedupe", "SELECT doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS r FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS rank FROM documents)) WHERE r = 1")
def cross_source_dedupe(t):
    """Of equal texts the one of the best source, then the least id; texts meet under a digest, in every task before they shuffle."""
    place = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1).alias("rank"), "doc_id")
    best = t.documents.groupBy(F.sha2("text", 256).alias("k"), F.length("text").alias("n")).agg(F.min(place).alias("b"))
    return best.select("b.doc_id", "b.rank")


@BOOK.query("pool_minus_anchors", "SELECT event_id FROM events WHERE event_type = 'click' AND (user_id, CAST(ts AS DATE)) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase')")
def pool_minus_anchors(t):
    day = F.to_date("ts").alias("day")
    anchors = t.events.where("event_type = 'purchase'").select("user_id", day).distinct()
    return t.events.where("event_type = 'click'").select("event_id", "user_id", day).join(anchors, ["user_id", "day"], "left_anti").select("event_id")


@BOOK.query("historic_forms", "SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN list_concat(string_split(lower(p_type), ' '), [replace(lower(p_type), ' ', '')]) IF x <> ''])), '|') AS forms FROM part")
def historic_forms(t):
    parts = F.concat(F.split(F.lower("p_type"), r"[ ,;|]+"), F.array(F.regexp_replace(F.lower("p_type"), " ", "")))
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), "|").alias("forms"))


@BOOK.query("coarse_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' WHEN 'P' THEN 'open' END AS coarse FROM orders")
def coarse_mapping(t):
    return t.orders.select("o_orderkey", T.mapped(F.col("o_orderstatus"), {"O": "open", "F": "done", "P": "open"}).alias("coarse"))


@BOOK.query("claims_array", "SELECT p_partkey, len(c) AS n, array_to_string(list_sort(list_distinct([x FOR x IN c])), '|') AS schemes FROM (SELECT p_partkey, [x FOR x IN [CASE WHEN p_size > 10 THEN 'size' END, CASE WHEN p_retailprice > 1000 THEN 'price' END, 'brand'] IF x IS NOT NULL] AS c FROM part)")
def claims_array(t):
    claim = lambda scheme, c: F.struct(F.lit(scheme).alias("scheme"), F.col(c).cast("string").alias("value"))
    claims = F.array_compact(F.array(F.when(F.col("p_size") > 10, claim("size", "p_size")), F.when(F.col("p_retailprice") > 1000, claim("price", "p_retailprice")), claim("brand", "p_brand")))
    rows = t.part.select("p_partkey", claims.alias("c"))
    return rows.select("p_partkey", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform("c", lambda x: x["scheme"]))), "|").alias("schemes"))


@BOOK.query("gloss_rules", r"SELECT p_partkey, CASE string_split(p_type, ' ')[1] WHEN 'ECONOMY' THEN 'trade' WHEN 'PROMO' THEN 'trade' WHEN 'SMALL' THEN 'store' ELSE CASE WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'metal' ELSE 'none' END END AS frame FROM part")
def gloss_rules(t):
    """The head word's frame, then keyword rules."""
    head = T.mapped(F.element_at(F.split("p_type", " "), 1), {"ECONOMY": "trade", "PROMO": "trade", "SMALL": "store"})
    return t.part.select("p_partkey", F.coalesce(head, F.when(F.col("p_type").rlike("STEEL|TIN"), "metal"), F.lit("none")).alias("frame"))


@BOOK.query("hint_text", "SELECT n_nationkey, n_name || ' lies in ' || r_name || '.' AS hint FROM nation JOIN region ON n_regionkey = r_regionkey")
def hint_text(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.format_string("%s lies in %s.", "n_name", "r_name").alias("hint"))  # region: a fixed table


@BOOK.query("trigger_windows", r"""WITH w AS (SELECT doc_id, w, CAST(unnest(range(len(w))) AS BIGINT) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)), h AS (SELECT doc_id, i, w[i + 1] AS token FROM w)
SELECT a.doc_id, a.i AS pos, a.token AS trigger, count(*) AS terms FROM h a JOIN h b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 10 WHERE a.token IN ('that', 'pour') AND b.token IN ('with', 'was', 'une', 'dans') GROUP BY ALL""")
def trigger_windows(t):
    """Triggers that have terms within ten tokens, with their number."""
    from ..operators.joins import band_join

    tok = t.documents.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "token"))
    a = tok.where(F.col("token").isin("that", "pour")).select("doc_id", F.col("i").alias("pos"), F.col("token").alias("trigger"))
    b = tok.where(F.col("token").isin("with", "was", "une", "dans")).select("doc_id", F.col("i").alias("at"))
    pairs = band_join(a, b, ["doc_id"], "pos", "at", 10)
    return pairs.groupBy("doc_id", F.col("pos").cast("long").alias("pos"), "trigger").agg(F.count(F.lit(1)).alias("terms"))


@BOOK.query("sentence_targets", "SELECT conv_id, arg_min(role, (CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, turn)) AS target, count(DISTINCT role) AS labels, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'mixed' END AS frame FROM conversations GROUP BY 1")
def sentence_targets(t):
    """Tiered choice within a group: unanimity, else priority."""
    tier = T.ladder([(F.col("role") == "assistant", 1), (F.col("role") == "user", 2)], 3)
    return t.conversations.groupBy("conv_id").agg(F.min_by("role", F.struct(tier.alias("p"), F.col("turn").alias("q"))).alias("target"), F.count_distinct("role").alias("labels"), F.when(F.count_distinct("role") == 1, F.min("role")).otherwise("mixed").alias("frame"))


@BOOK.query("thesaurus_build", r"""WITH s AS (SELECT p_brand AS pref, p_type AS alias, 'alt' AS kind, 'types' AS source, 2 AS rank FROM part UNION ALL SELECT p_brand, string_split(p_name, ' ')[1], 'pref', 'names', 1 FROM part),
n AS (SELECT *, trim(regexp_replace(lower(alias), '[^\p{L}]+', ' ', 'g')) AS alias_norm FROM s), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pref, alias_norm ORDER BY rank, kind, source) AS r FROM n WHERE alias_norm <> '') WHERE r = 1),
f AS (SELECT trim(regexp_replace(lower(p_type), '[^\p{L}]+', ' ', 'g')) AS alias_norm, count(*) AS freq FROM part GROUP BY 1), c AS (SELECT alias_norm, count(DISTINCT pref) AS k FROM d GROUP BY 1),
j AS (SELECT d.*, coalesce(freq, 0) AS freq, CASE WHEN k > 1 THEN 'conflict' WHEN length(alias_norm) < 3 THEN 'short' END AS reason, row_number() OVER (PARTITION BY alias_norm ORDER BY kind <> 'pref', rank, pref, source) AS win FROM d JOIN c USING (alias_norm) LEFT JOIN f USING (alias_norm)),
w AS (SELECT *, CASE WHEN alias_norm IN (SELECT trim(regexp_replace(lower(p_type), '[^\p{L}]+', ' ', 'g')) FROM part WHERE p_size > 49) THEN 'denylist' WHEN reason = 'conflict' AND win = 1 THEN NULL ELSE reason END AS final FROM j)
SELECT pref, alias_norm, kind, source, freq, final IS NULL AS keep, coalesce(final, '') AS reason FROM w""")
def thesaurus_build(t):
    names = t.part.select(F.col("p_brand").alias("pref"), F.element_at(F.split("p_name", " "), 1).alias("alias"), F.lit("pref").alias("kind"), F.lit("names").alias("source"), F.lit(1).alias("rank"))
    types = t.part.select(F.col("p_brand").alias("pref"), F.col("p_type").alias("alias"), F.lit("alt").alias("kind"), F.lit("types").alias("source"), F.lit(2).alias("rank"))
    freq = t.part.groupBy(T.normal(F.col("p_type")).alias("alias_norm")).agg(F.count(F.lit(1)).alias("freq"))
    return L.alias_table(names.unionByName(types), t.part.where("p_size > 49").select(F.col("p_type").alias("alias")), freq)


@BOOK.query("review_round_trip", "SELECT p_partkey, CASE WHEN r.p_partkey IS NOT NULL THEN 'REVIEWED' ELSE p_brand END AS p_brand, r.p_partkey IS NOT NULL AS reviewed FROM part LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 40) r USING (p_partkey) WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def review_round_trip(t):
    """The latest decision of each key wins; dropped keys go."""
    keep = t.part.where("p_size > 40").select("p_partkey", F.lit("keep").alias("decision"), F.lit("REVIEWED").alias("p_brand"), F.lit(1).alias("seq"))
    drop = t.part.where("p_size > 45").select("p_partkey", F.lit("drop").alias("decision"), F.lit("").alias("p_brand"), F.lit(2).alias("seq"))
    return L.reviewed(t.part.select("p_partkey", "p_brand"), keep.unionByName(drop), "p_partkey", "p_brand").select("p_partkey", "p_brand", "reviewed")


@BOOK.query("score_matrix_candidates", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE n >= 3) WHERE r <= 2")
def score_matrix_candidates(t):
    scores = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return X.top_k(scores, ["user_id"], [F.desc("n"), "event_type"], 2).drop("rank")


@BOOK.query("baseline_evaluation", "SELECT count(*) AS n, round(avg(CAST(quality = 1 AS INTEGER)), 6) AS always_good, round(avg(CAST((n_chars > 3000) = (quality = 1) AS INTEGER)), 6) AS by_length FROM documents JOIN labels USING (doc_id)")
def baseline_evaluation(t):
    good = F.col("quality") == 1
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return t.documents.join(t.labels, "doc_id").agg(F.count(F.lit(1)).alias("n"), share(good).alias("always_good"), share((F.col("n_chars") > 3000) == good).alias("by_length"))


@BOOK.query("backfill_column", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN upper(substr(o_orderpriority, 3)) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def backfill_column(t):
    fixed = F.when(F.col("o_orderstatus") == "P", F.upper(F.expr("substring(o_orderpriority, 3)"))).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", fixed.alias("o_orderpriority"))


@BOOK.query("insertion_cap", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 30")
def insertion_cap(t):
    return X.top_k(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 30).select("l_orderkey", "l_linenumber")


@BOOK.query("dense_labels", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS level FROM part")
def dense_labels(t):
    return t.part.select("p_partkey", F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("level"))
