"""Aggregates, windows, joins, merges and samples over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import merge as M
from ..operators import sampling as S
from ..operators import windows as X
from .base import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def _h(key: str) -> str:
    return f"CAST(concat('0x', substr(md5(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


# -- aggregates -----------------------------------------------------------------------------------


@BOOK.query("group_count", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def group_count(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@BOOK.query("crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\", count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def crosstab(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["O", "F"])


@BOOK.query("crosstab_margins", "SELECT coalesce(o_orderstatus, 'ALL') AS o_orderstatus, coalesce(o_orderpriority, 'ALL') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(t):
    return A.crosstab_margins(t.orders, "o_orderstatus", "o_orderpriority")


@BOOK.query("key_plus_all", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type)")
def key_plus_all(t):
    return A.key_plus_all(t.events, "event_type", [F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total")])


@BOOK.query("pivot_two_measures", """SELECT p_brand, count(*) FILTER (WHERE y = 0) AS n_low, count(DISTINCT l_orderkey) FILTER (WHERE y = 0) AS orders_low, count(*) FILTER (WHERE y = 1) AS n_high, count(DISTINCT l_orderkey) FILTER (WHERE y = 1) AS orders_high
FROM (SELECT *, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pivot_two_measures(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("y", F.when(F.col("l_quantity") > 25, "high").otherwise("low"))
    long = rows.groupBy("p_brand", "y").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"))
    return long.groupBy("p_brand").agg(*(F.coalesce(F.max(F.when(F.col("y") == y, F.col(c))), F.lit(0)).alias(f"{c}_{y}") for y in ("low", "high") for c in ("n", "orders")))


@BOOK.query("row_shares", "SELECT o_orderstatus, o_orderpriority, n, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS row_total, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def row_shares(t):
    return A.shares(t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", "n")


@BOOK.query("timeline", """SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'signup') AS signups,
count(*) FILTER (WHERE event_type NOT IN ('purchase', 'signup')) AS rest FROM events GROUP BY 1""")
def timeline(t):
    count = lambda c: F.count_if(c)
    kind = F.col("event_type")
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), count(kind == "purchase").alias("purchases"), count(kind == "signup").alias("signups"), count(~kind.isin("purchase", "signup")).alias("rest"))


@BOOK.query("fill_rates", "SELECT unnest(['text', 'lang', 'source', 'first']) AS column_name, unnest([round(avg(CAST(trim(coalesce(text, '')) <> '' AS INTEGER)), 6), round(avg(CAST(trim(coalesce(lang, '')) <> '' AS INTEGER)), 6), round(avg(CAST(trim(coalesce(source, '')) <> '' AS INTEGER)), 6), round(avg(CAST(n_chars > 500 AS INTEGER)), 6)]) AS fill_rate FROM documents")
def fill_rates(t):
    return A.fill_rates(t.documents.withColumn("first", F.when(F.col("n_chars") > 500, "x").otherwise(" ")), ["text", "lang", "source", "first"])


@BOOK.query("cell_cube", "SELECT source, lang, CAST(n_chars // 1000 * 1000 AS BIGINT) AS size_bin, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def cell_cube(t):
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("size_bin", F.floor(F.col("n_chars") / 1000) * 1000)
    return rows.groupBy("source", "lang", "size_bin", "quality").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("before_after_shift", """SELECT user_id, count(*) FILTER (WHERE NOT a) AS n_before, count(*) FILTER (WHERE a) AS n_after, round(count(*) FILTER (WHERE NOT a AND h) / count(*) FILTER (WHERE NOT a), 6) AS before, round(count(*) FILTER (WHERE a AND h) / count(*) FILTER (WHERE a), 6) AS after,
round(count(*) FILTER (WHERE a AND h) / count(*) FILTER (WHERE a) - count(*) FILTER (WHERE NOT a AND h) / count(*) FILTER (WHERE NOT a), 6) AS shift FROM (SELECT user_id, ts >= TIMESTAMP '2024-01-15' AS a, event_type = 'purchase' AS h FROM events) GROUP BY 1 HAVING count(*) FILTER (WHERE NOT a) >= 3 AND count(*) FILTER (WHERE a) >= 3""")
def before_after_shift(t):
    return A.before_after(t.events, "user_id", F.col("ts") >= F.lit("2024-01-15").cast("timestamp"), F.col("event_type") == "purchase", 3)


@BOOK.query("stratum_estimate", f"""WITH s AS (SELECT * FROM orders WHERE {_h('o_orderkey')} % 10 = 0) SELECT p.o_orderstatus, p.size, s.sampled, round(p.size / s.sampled, 6) AS weight, round(s.mean * p.size, 2) AS estimate, round(s.median, 2) AS median
FROM (SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1) p JOIN (SELECT o_orderstatus, count(*) AS sampled, avg(o_totalprice) AS mean, median(o_totalprice) AS median FROM s GROUP BY 1) s USING (o_orderstatus)""")
def stratum_estimate(t):
    return A.stratum_estimate(t.orders, t.orders.where(F.pmod(T.hash_order(F.col("o_orderkey")), F.lit(10)) == 0), "o_orderstatus", "o_totalprice")


@BOOK.query("tag_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(lower(o_orderpriority)))), '|') AS tags FROM orders GROUP BY 1")
def tag_union(t):
    return A.tag_union(t.orders, ["o_custkey"], T.tag_set(F.col("o_orderpriority")))


@BOOK.query("tag_histogram", "SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size < 5 THEN ['(missing)'] ELSE list_distinct(string_split(lower(p_type), ' ')) END) AS tag FROM part) GROUP BY 1")
def tag_histogram(t):
    tags = F.when(F.col("p_size") < 5, F.lit("")).otherwise(F.replace("p_type", F.lit(" "), F.lit("|")))
    return A.tag_histogram(t.part, T.tag_set(tags))


@BOOK.query("per_key_overview", "SELECT n_name, first_name, n, n_segments, coalesce(n_orders, 0) AS n_orders FROM (SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, count(*) AS n, count(DISTINCT c_mktsegment) AS n_segments FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1) USING (c_nationkey)")
def per_key_overview(t):
    """First value, counts and distinct counts per key, enriched; counts without rows are 0."""
    per = t.customer.groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"), F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("n_segments"))
    open_orders = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_orders"))
    out = per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(open_orders, "c_nationkey", "left")
    return out.select("n_name", "first_name", "n", "n_segments", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@BOOK.query("per_work_rollup", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS priorities, count(*) AS size, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def per_work_rollup(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@BOOK.query("majority_vote", "SELECT l_partkey, l_returnflag AS top, votes, n, round(votes / n, 3) AS agreement FROM (SELECT l_partkey, l_returnflag, votes, CAST(sum(votes) OVER (PARTITION BY l_partkey) AS BIGINT) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_returnflag) AS r FROM (SELECT l_partkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL)) WHERE r = 1")
def majority_vote(t):
    return A.majority(t.lineitem, ["l_partkey"], "l_returnflag")


@BOOK.query("weighted_collapse", "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS variants FROM lineitem GROUP BY 1")
def weighted_collapse(t):
    return A.weighted_collapse(t.lineitem.withColumn("q", F.col("l_quantity").cast("long")), "l_suppkey", "l_discount", "q", "l_returnflag")


@BOOK.query("group_priors", "SELECT source, n, CAST(passed AS BIGINT) AS passed, CAST(dropped AS BIGINT) AS dropped, round(passed / n, 4) AS pass_rate, round(dropped / n, 4) AS drop_rate, CASE WHEN n < 3 THEN 'few' WHEN round(dropped / n, 4) >= 0.5 THEN 'blocked' WHEN round(passed / n, 4) < 0.7 AND round(dropped / n, 4) >= 0.1 THEN 'unsure' ELSE 'fine' END AS flag FROM (SELECT source, count(*) AS n, sum(quality) AS passed, sum(toxic) AS dropped FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def group_priors(t):
    return A.priors(t.documents.join(t.labels, "doc_id"), "source", F.col("quality") == 1, F.col("toxic") == 1)


@BOOK.query("ratio_guard", "SELECT p_brand, p_type, n, CASE WHEN n < 0.5 * max(n) OVER (PARTITION BY p_brand) THEN p_type ELSE p_brand END AS final_key FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)")
def ratio_guard(t):
    return X.ratio_guard(t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), "p_brand", "n", 0.5, own="p_type")


@BOOK.query("coverage", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_event, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def coverage(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_event"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@BOOK.query("glossary_candidates", "SELECT * FROM (SELECT p_brand, max(p_size) AS max_size, arg_min(p_type, p_partkey) AS first_type, array_to_string(list_sort(list_distinct(list(p_name)))[1:5], '|') AS names FROM part GROUP BY 1) ORDER BY max_size DESC, p_brand LIMIT 15")
def glossary_candidates(t):
    out = t.part.groupBy("p_brand").agg(F.max("p_size").alias("max_size"), F.min_by("p_type", "p_partkey").alias("first_type"))
    top = out.orderBy(F.desc("max_size"), "p_brand").limit(15)
    names = A.first_values(t.part, ["p_brand"], "p_name", 5, "names")
    return top.join(names, "p_brand")


@BOOK.query("stem_groups", "WITH c AS (SELECT substr(p_name, 1, 6) AS stem, p_name, count(*) AS n, sum(p_size) AS s FROM part GROUP BY ALL) SELECT stem, array_to_string(list_sort(list(p_name)), '|') AS forms, CAST(sum(n) AS BIGINT) AS size, CAST(sum(s) AS BIGINT) AS total, arg_min(p_name, (-n, p_name)) AS example FROM c GROUP BY 1")
def stem_groups(t):
    """The distinct forms of each stem, and the commonest (ties: the first in order)."""
    forms = t.part.groupBy(F.substring("p_name", 1, 6).alias("stem"), "p_name").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s"))
    return forms.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("forms"), F.sum("n").alias("size"), F.sum("s").alias("total"), F.min_by("p_name", F.struct(-F.col("n"), "p_name")).alias("example"))


@BOOK.query("best_level", "SELECT best, count(*) AS n FROM (SELECT o_custkey, min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END) AS best FROM orders GROUP BY 1) GROUP BY 1")
def best_level(t):
    level = T.ladder([(F.col("o_orderpriority") == "1-URGENT", 1), (F.col("o_orderpriority") == "2-HIGH", 2)], 3)
    return t.orders.groupBy("o_custkey").agg(F.min(level).alias("best")).groupBy("best").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("summary_row", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(*) FILTER (WHERE p_size > 25) AS large FROM part")
def summary_row(t):
    return t.part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count_if(F.col("p_size") > 25).alias("large"))


@BOOK.query("map_histogram", "SELECT o_custkey, array_to_string(list_sort(list(o_orderpriority || '=' || n)), ',') AS histogram FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def map_histogram(t):
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "o_orderpriority", F.col("n").cast("string")))), ",").alias("histogram"))


@BOOK.query("class_weights", "SELECT o_orderpriority, n, round(total / (k * n), 6) AS weight FROM (SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) OVER () AS k FROM orders GROUP BY 1)")
def class_weights(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(total)).select("o_orderpriority", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))  # one row


# -- windows --------------------------------------------------------------------------------------


@BOOK.query("rank_in_group", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def rank_in_group(t):
    return X.ranked(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@BOOK.query("top_k_per_group", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 5")
def top_k_per_group(t):
    return X.top_k(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@BOOK.query("per_key_cap", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 30")
def per_key_cap(t):
    return S.per_key_cap(t.documents, ["source"], ["doc_id"], 30).select("source", "doc_id")


@BOOK.query("conflict_winner", "SELECT p_name, p_brand, n_labels FROM (SELECT *, (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_name = part.p_name) AS n_labels, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1 AND n_labels > 1")
def conflict_winner(t):
    return X.canonical_winner(t.part, "p_name", "p_brand", [F.desc("p_size"), F.asc("p_partkey")]).select("p_name", "p_brand", F.col("n_labels").cast("long").alias("n_labels"))


@BOOK.query("group_distinct_flag", "SELECT p_partkey, CASE WHEN n > 1 THEN 'conflict' WHEN p_size < 5 THEN 'small' ELSE '' END AS flag FROM part JOIN (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) USING (p_name)")
def group_distinct_flag(t):
    labels = F.size(F.collect_set("p_brand").over(W.partitionBy("p_name")))
    return t.part.withColumn("n", labels).select("p_partkey", T.ladder([(F.col("n") > 1, "conflict"), (F.col("p_size") < 5, "small")], "").alias("flag"))


@BOOK.query("position_bins", """SELECT conv_id, turn, CAST(bin AS INTEGER) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, bin ORDER BY length(text) DESC, turn, role, text) AS r FROM (SELECT *, least(3, floor(turn * 4 / (max(turn) OVER (PARTITION BY conv_id) + 1))) AS bin FROM conversations)) WHERE r = 1""")
def position_bins(t):
    rows = t.conversations.withColumn("len", F.max("turn").over(W.partitionBy("conv_id")) + 1)
    return X.best_per_bin(rows, ["conv_id"], F.col("turn"), F.col("len"), 4, [F.desc(F.length("text")), F.asc("turn"), F.asc("role"), F.asc("text")]).select("conv_id", "turn", "bin")


@BOOK.query("evenly_spaced", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 4 OR ((i + 1) * 4 + n - 1) // n > (i * 4 + n - 1) // n")
def evenly_spaced(t):
    return X.evenly_spaced(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 4, F.to_date("ts")).select("user_id", "event_id")


@BOOK.query("carry_forward", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def carry_forward(t):
    return X.carried(t.conversations, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "last_user").select("conv_id", "turn", "role", "last_user")


@BOOK.query("carry_forward_scope", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope
FROM (SELECT *, sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)""")
def carry_forward_scope(t):
    return X.carried_scope(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), F.col("event_type") == "purchase", "scope").select("user_id", "event_id", "scope")


@BOOK.query("span_lead", "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 1000) AS end_turn FROM conversations")
def span_lead(t):
    return X.span_end(t.conversations, ["conv_id"], ["turn", "role", "text"], F.col("turn"), F.lit(1000).cast("long"), "end_turn").select("conv_id", "turn", "end_turn")


@BOOK.query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_seen(t):
    return X.first_of(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@BOOK.query("occurrence_ids", "SELECT source || '__' || lang || CASE WHEN r > 0 THEN '__' || r ELSE '' END AS id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS r FROM documents)")
def occurrence_ids(t):
    rows = X.numbered(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], F.floor(F.col("doc_id") / 100_000), ["doc_id"], "r")
    return rows.select(F.concat_ws("__", "source", "lang", F.when(F.col("r") > 0, F.col("r").cast("string"))).alias("id"), "doc_id")


@BOOK.query("run_length_breaker", "SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i FROM events) WHERE event_type = 'error' OR event_type = 'click') GROUP BY user_id, g HAVING count(*) >= 3")
def run_length_breaker(t):
    return X.runs_of(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "click")).where("length >= 3")


@BOOK.query("round_robin", "SELECT source, doc_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def round_robin(t):
    return X.round_robin(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 50, ["source"])


# -- joins ----------------------------------------------------------------------------------------


@BOOK.query("left_enrich", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_enrich(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@BOOK.query("fallback_fill", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, g) AS segment FROM customer LEFT JOIN (SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') AS g FROM customer WHERE c_acctbal >= 0 GROUP BY 1) USING (c_nationkey)")
def fallback_fill(t):
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    group = t.customer.where("c_acctbal >= 0").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("g"))
    return t.customer.join(group, "c_nationkey", "left").select("c_custkey", F.coalesce(known, "g").alias("segment"))


@BOOK.query("last_wins_join", "SELECT o_custkey, c_name, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON o_custkey = c_custkey WHERE r = 1")
def last_wins_join(t):
    last = J.last_wins(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", "o_orderkey")


@BOOK.query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@BOOK.query("anti_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@BOOK.query("asof_last", "SELECT p.event_id, p.user_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts")
def asof_last(t):
    purchases = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signups = t.events.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("event_id").alias("signup_id"))
    return J.bucketed_asof_join(purchases, signups, ["user_id"], "ts", "start", ["signup_id"], 7 * 86400).select("event_id", "user_id", "signup_id")


_SEC = "CAST(epoch(ts) AS BIGINT)"


@BOOK.query("interval_contains", f"WITH s AS (SELECT user_id, event_id AS span_id, {_SEC} AS a, {_SEC} + 86400 AS b FROM events WHERE event_type = 'signup') SELECT e.event_id, s.span_id FROM events e JOIN s ON e.user_id = s.user_id AND {_SEC} >= a AND {_SEC} < b WHERE e.event_type = 'click'")
def interval_contains(t):
    at = T.whole_seconds(F.col("ts"))
    spans = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), at.alias("a"), (at + 86400).alias("b"))
    points = t.events.where("event_type = 'click'").select("user_id", "event_id", at.alias("at"))
    return J.interval_join(points, spans, ["user_id"], F.col("at"), "a", "b", 86400).select("event_id", "span_id")


@BOOK.query("band_pairs", f"SELECT a.event_id AS a_id, b.event_id AS b_id FROM (SELECT *, {_SEC} AS s FROM events WHERE event_type = 'purchase') a JOIN (SELECT *, {_SEC} AS s FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND abs(a.s - b.s) <= 43200")
def band_pairs(t):
    at = T.whole_seconds(F.col("ts"))
    a = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), at.alias("a"))
    b = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), at.alias("b"))
    return J.band_join(a, b, ["user_id"], "a", "b", 43200).select("a_id", "b_id")


@BOOK.query("neighbour_vote", f"""WITH p AS (SELECT a.event_id, b.event_type FROM (SELECT *, {_SEC} AS s FROM events WHERE event_type = 'purchase') a JOIN (SELECT *, {_SEC} AS s FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND abs(a.s - b.s) <= 43200),
c AS (SELECT event_id, event_type, count(*) AS votes FROM p GROUP BY ALL) SELECT event_id, event_type AS top, votes, n, round(votes / n, 3) AS agreement FROM (SELECT *, CAST(sum(votes) OVER (PARTITION BY event_id) AS BIGINT) AS n, row_number() OVER (PARTITION BY event_id ORDER BY votes DESC, event_type) AS r FROM c) WHERE r = 1""")
def neighbour_vote(t):
    at = T.whole_seconds(F.col("ts"))
    a = t.events.where("event_type = 'purchase'").select("user_id", "event_id", at.alias("a"))
    b = t.events.where("event_type <> 'purchase'").select("user_id", "event_type", at.alias("b"))
    return A.majority(J.band_join(a, b, ["user_id"], "a", "b", 43200), ["event_id"], "event_type")


@BOOK.query("tiered_match", "SELECT s_suppkey, c_custkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY tier, c_custkey) AS r FROM (SELECT s_suppkey, c_custkey, '1 key' AS tier FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey UNION ALL SELECT s_suppkey, c_custkey, '2 nation' FROM supplier JOIN customer ON s_nationkey = c_nationkey)) WHERE r = 1")
def tiered_match(t):
    left = t.supplier.select("s_suppkey", F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    right = t.customer.select("c_custkey", F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return J.tiered_join(left, [(right, ["key", "nation"], "1 key"), (right.drop("key"), ["nation"], "2 nation")], ["s_suppkey"], ["c_custkey"]).select("s_suppkey", "c_custkey", "tier")


@BOOK.query("exact_else_contains", "WITH v AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size < 5 UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part), m AS (SELECT p_partkey, label, 0 AS tier FROM part JOIN v ON lower(p_name) = lower(label) UNION ALL SELECT p_partkey, label, 1 FROM part JOIN v ON contains(lower(p_name), lower(label))) SELECT p_partkey, label, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, length(label), label) AS r FROM m) WHERE r = 1")
def exact_else_contains(t):
    """Equality first, else the shortest label that a name contains."""
    labels = t.part.where("p_size < 5").select(F.col("p_name").alias("label")).unionAll(t.part.select(F.get(F.split("p_name", " "), F.lit(1)))).where("label is not null").distinct()
    names = t.part.select("p_name").distinct()  # equal names are asked once
    exact = names.join(labels, F.lower("p_name") == F.lower("label")).select("p_name", "label", F.lit(0).alias("tier"))
    near = J.contains_join(names, labels, "p_name", "p_name", "label", ignore_case=True).select("p_name", "label", F.lit(1).alias("tier"))
    order = ["tier", F.length("label"), "label"]
    best = X.first_of(exact.unionAll(near), ["p_name"], order)
    return X.first_of(t.part.select("p_partkey", "p_name").join(best, "p_name").drop("p_name"), ["p_partkey"], order)


@BOOK.query("prefix_key_join", r"""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS form FROM documents), h AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS head FROM benchmark)
SELECT form, head FROM f LEFT JOIN (SELECT left(head, 6) AS stem, min(head) AS head FROM h WHERE length(head) >= 6 GROUP BY 1) ON left(form, 6) = stem WHERE length(form) >= 6""")
def prefix_key_join(t):
    """Forms with the first lexicon word of their stem, cut after six letters; the lexicon comes with one row a stem."""
    word = lambda df, name: df.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias(name)).distinct().where(F.length(name) >= 6).withColumn("stem", F.substring(name, 1, 6))
    heads = word(t.benchmark, "head").groupBy("stem").agg(F.min("head").alias("head"))
    return word(t.documents, "form").join(heads, "stem", "left").select("form", "head")


@BOOK.query("title_fallback", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) END, y) AS year FROM orders LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) USING (o_custkey)")
def title_fallback(t):
    year = F.when(F.col("o_orderstatus") != "O", F.year("o_orderdate"))
    fallback = t.orders.where("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"))
    return t.orders.join(fallback, "o_custkey", "left").select("o_orderkey", F.coalesce(year, "y").cast("long").alias("year"))


@BOOK.query("crosswalk_join", "SELECT DISTINCT o_custkey, g FROM orders JOIN (SELECT unnest(['1-URGENT', '1-URGENT', '2-HIGH', '5-LOW']) AS o_orderpriority, unnest(['fast', 'air', 'fast', 'slow']) AS g, unnest([true, true, true, false]) AS approved) USING (o_orderpriority) WHERE approved")
def crosswalk_join(t):
    walk = t.spark.createDataFrame([("1-URGENT", "fast", True), ("1-URGENT", "air", True), ("2-HIGH", "fast", True), ("5-LOW", "slow", False)], "o_orderpriority string, g string, approved boolean")
    return t.orders.join(walk.where("approved"), "o_orderpriority").select("o_custkey", "g").dropDuplicates()


@BOOK.query("crosswalk_rank", "SELECT p_partkey, g, CAST(rank AS INTEGER) AS rank FROM (SELECT p_partkey, g, min(rank) AS rank FROM (SELECT p_partkey, g, 1 AS rank FROM part, (SELECT unnest(['A', 'B']) AS g) WHERE p_type = g UNION ALL SELECT p_partkey, g, 2 FROM part, (SELECT unnest(['ECONOMY', 'SMALL', 'LARGE']) AS g) WHERE contains(p_type, g)) GROUP BY ALL)")
def crosswalk_rank(t):
    """Vocabulary matches by kind: equality before substring (a small parameter table)."""
    exact = t.part.where(F.col("p_type").isin("A", "B")).select("p_partkey", F.col("p_type").alias("g"), F.lit(1).alias("rank"))
    near = t.part.select("p_partkey", F.explode(F.array_compact(F.array(*(F.when(F.col("p_type").contains(g), g) for g in ("ECONOMY", "SMALL", "LARGE"))))).alias("g"), F.lit(2).alias("rank"))
    return exact.unionAll(near).groupBy("p_partkey", "g").agg(F.min("rank").alias("rank"))


@BOOK.query("full_outer_compare", "SELECT coalesce(a.k, b.k) AS nationkey, coalesce(x, 0) AS customers, coalesce(y, 0) AS suppliers, coalesce(x, 0) - coalesce(y, 0) AS diff FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def full_outer_compare(t):
    a = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    out = a.join(b, "nationkey", "full_outer").fillna(0, ["customers", "suppliers"])
    return out.withColumn("diff", F.col("customers") - F.col("suppliers"))


@BOOK.query("overlay_fix", "SELECT o_orderkey, CASE WHEN f.o_orderkey IS NOT NULL THEN 'F' ELSE o.o_orderstatus END AS o_orderstatus, f.o_orderkey IS NOT NULL AS fixed FROM orders o LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderkey % 2 = 0) f USING (o_orderkey)")
def overlay_fix(t):
    fixes = t.orders.where("o_totalprice > 300000").select("o_orderkey", F.lit("F").alias("o_orderstatus"))
    return J.overlay(t.orders, fixes, "o_orderkey", ["o_orderstatus"], F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_orderstatus", "fixed")


@BOOK.query("seed_from_run", "SELECT a.o_orderkey FROM orders a JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey AND a.o_totalprice = b.o_totalprice")
def seed_from_run(t):
    earlier = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice")
    return t.orders.join(earlier, ["o_orderkey", "o_totalprice"]).select("o_orderkey")


# -- sets and merges ------------------------------------------------------------------------------


@BOOK.query("union_sources", "SELECT name, nationkey, source_name FROM (SELECT c_name AS name, c_nationkey AS nationkey, 'customer' AS source_name FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier)")
def union_sources(t):
    return M.union_sources([("customer", t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))), ("supplier", t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey")))])


@BOOK.query("dedupe_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(t):
    """The least id of each text: the aggregate meets equal texts in every task before it shuffles, under a digest."""
    return t.documents.groupBy(F.sha2("text", 256).alias("k"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@BOOK.query("collapse_duplicates", "SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, array_to_string(list_sort(list_distinct(list(lower(p_type)))), '|') AS tags FROM part GROUP BY 1")
def collapse_duplicates(t):
    return M.collapse_duplicates(t.part, ["p_brand"], ["p_name"], F.col("p_partkey"), T.tag_set(F.col("p_type")))[0]


@BOOK.query("dedupe_report", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dedupe_report(t):
    return M.collapse_duplicates(t.part, ["p_brand"], ["p_name"], F.col("p_partkey"), T.tag_set(F.col("p_type")))[1]


@BOOK.query("append_unseen", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_orderkey % 2 <> 0")
def append_unseen(t):
    return M.append_unseen(t.orders.where("o_orderkey % 2 = 0").select("o_orderkey"), t.orders.select("o_orderkey"), ["o_orderkey"], ["o_orderkey"], 100)


@BOOK.query("upsert_locked", """SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL AND NOT coalesce(a.locked, false) THEN b.seg ELSE a.seg END AS seg, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NOT NULL AND NOT a.locked THEN 'updated' ELSE 'kept' END AS action
FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal > 5000 AS locked FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey, 'NEW' AS seg FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""")
def upsert_locked(t):
    base = t.customer.where("c_custkey % 3 <> 0").withColumn("seg", F.col("c_mktsegment"))
    update = t.customer.where("c_custkey % 2 = 0").withColumn("seg", F.lit("NEW"))
    return M.upsert_locked(base, update, "c_custkey", ["seg"], F.col("c_acctbal") > 5000)


@BOOK.query("disagreement_sheet", "SELECT doc_id, array_to_string(list_sort(list_distinct(list(issue))), '; ') AS issues FROM (SELECT doc_id, 'toxic' AS issue FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 0) GROUP BY 1")
def disagreement_sheet(t):
    issues = t.labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("issue")).unionAll(t.labels.where("quality = 0").select("doc_id", F.lit("quality")))
    return issues.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("issues"))


@BOOK.query("intersect_keys", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def intersect_keys(t):
    return M.in_all_groups(t.events, "user_id", "event_type")


@BOOK.query("promote_agreed", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE '' END AS l_linestatus, array_to_string(list_sort(list_distinct(list(CAST(l_linenumber AS VARCHAR)))), '+') AS who FROM lineitem WHERE NOT l_quantity < 5 GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2 AND count(DISTINCT l_returnflag) = 1")
def promote_agreed(t):
    return M.promoted(t.lineitem, "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity") < 5, ["l_linestatus"])


@BOOK.query("fine_over_coarse", "SELECT doc_id, quality, fine FROM (SELECT doc_id, quality, true AS fine FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality, false FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0))")
def fine_over_coarse(t):
    fine = t.labels.where("doc_id % 2 = 0").select("doc_id", "quality", F.lit(True).alias("fine"))
    return M.prefer_first([fine, t.labels.select("doc_id", "quality", F.lit(False).alias("fine"))], ["doc_id"], ["quality"])


@BOOK.query("content_changes", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'gone' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS state FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0) b ON a.o_orderkey = b.o_orderkey")
def content_changes(t):
    old = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    new = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return M.changed_rows(old, new, "o_orderkey", ["s"])


# -- samples --------------------------------------------------------------------------------------


@BOOK.query("sorted_mixed", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def sorted_mixed(t):
    return t.orders.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority")


@BOOK.query("hash_sample", f"SELECT o_orderkey FROM orders ORDER BY {_h('o_orderkey')}, o_orderkey LIMIT 100")
def hash_sample(t):
    return S.hash_sample(t.orders.select("o_orderkey"), T.hash_order(F.col("o_orderkey")), "o_orderkey", 100)


@BOOK.query("per_work_cap", f"SELECT o_orderkey, CAST(turn AS INTEGER) AS turn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_h('o_orderkey')}, o_orderkey) AS turn FROM orders) WHERE turn <= 3 ORDER BY turn, {_h('o_custkey')}, o_orderkey LIMIT 300")
def per_work_cap(t):
    return S.rotating_sample(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", T.hash_order(F.col("o_orderkey")), "o_orderkey", T.hash_order(F.col("o_custkey")), 3, 300).select("o_orderkey", "turn")


@BOOK.query("quota_sample", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}, o_orderkey) AS r FROM orders) JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS o_orderpriority, unnest([50, 20, 5]) AS quota) USING (o_orderpriority) WHERE r <= quota")
def quota_sample(t):
    quotas = t.spark.createDataFrame([("1-URGENT", 50), ("2-HIGH", 20), ("5-LOW", 5)], "o_orderpriority string, quota int")
    return S.quota_sample(t.orders, "o_orderpriority", quotas, [T.hash_order(F.col("o_orderkey")), "o_orderkey"]).select("o_orderkey")


@BOOK.query("pinned_bucket", f"SELECT o_orderkey, pinned, pool FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS pool, row_number() OVER (PARTITION BY o_orderpriority ORDER BY pinned DESC, {_h('o_orderkey')}, o_orderkey) AS r FROM (SELECT *, o_totalprice > 400000 AS pinned FROM orders)) WHERE pinned OR r <= 10")
def pinned_bucket(t):
    return S.pinned_buckets(t.orders, "o_orderpriority", F.col("o_totalprice") > 400000, [T.hash_order(F.col("o_orderkey")), "o_orderkey"], 10).select("o_orderkey", "pinned", "pool")


@BOOK.query("group_split", f"SELECT doc_id, CASE WHEN {_h('source')} < 858993459 THEN 'dev' ELSE 'train' END AS split FROM documents")
def group_split(t):
    return S.group_split(t.documents.select("doc_id", "source"), "source", T.hash_order(F.col("source")), 0.2).select("doc_id", "split")


@BOOK.query("stratified_split", f"SELECT doc_id, CASE WHEN NOT out AND r <= 20 THEN 'dev' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY out, {_h('doc_id')}, doc_id) AS r FROM (SELECT *, n_chars < 300 AS out FROM documents))")
def stratified_split(t):
    return S.stratified_split(t.documents, "lang", [T.hash_order(F.col("doc_id")), "doc_id"], 20, F.col("n_chars") < 300).select("doc_id", "split")


@BOOK.query("kfold", f"SELECT doc_id, CAST({_h('source')} % 5 AS INTEGER) AS fold FROM documents")
def kfold(t):
    return S.folds(t.documents, T.hash_order(F.col("source")), 5).select("doc_id", "fold")


@BOOK.query("oversample", "SELECT doc_id, CAST(unnest(range(1, CASE WHEN toxic = 1 THEN 4 ELSE 2 END)) AS INTEGER) AS copy FROM labels")
def oversample(t):
    return S.oversample(t.labels, F.col("toxic") == 1, 3).select("doc_id", "copy")


@BOOK.query("series_pick", f"SELECT doc_id, series, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY {_h('doc_id')}, doc_id) AS r FROM (SELECT *, source || lang AS series FROM documents)) WHERE r = 1) WHERE place <= 6")
def series_pick(t):
    return S.series_pick(t.documents, F.concat("source", "lang"), [T.hash_order(F.col("doc_id")), "doc_id"], "lang", 6).select("doc_id", "series", "place")


@BOOK.query("balanced_negatives", f"WITH p AS (SELECT doc_id FROM labels WHERE toxic = 1), n AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) AS q FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id) AS r FROM labels WHERE toxic = 0) WHERE r <= 40) SELECT doc_id FROM p UNION ALL SELECT doc_id FROM n WHERE q <= (SELECT count(*) FROM p)")
def balanced_negatives(t):
    return S.balanced_negatives(t.labels, F.col("toxic") == 1, ["quality"], T.hash_order(F.col("doc_id")), ["doc_id"], 40).select("doc_id")


@BOOK.query("mode_union", "WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 20) SELECT p_partkey, array_to_string(list_sort(list(m)), '|') AS modes FROM (SELECT *, 'price' AS m FROM a UNION ALL SELECT *, 'size' FROM b) GROUP BY 1")
def mode_union(t):
    rows = t.part.select("p_partkey", "p_retailprice", "p_size")
    return S.mode_union(rows, [("price", [F.desc("p_retailprice"), "p_partkey"]), ("size", [F.desc("p_size"), "p_partkey"])], 20).select("p_partkey", "modes")
