"""Segmentation, cascade, resume, stream and sampling queries that plain SQL can't express, or only in part."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import forms as M
from ..functions import text as T
from ..operators import cascade as C
from ..operators import lexicon as L
from ..operators import sampling as S
from ..operators import segmentation as G
from ..operators import vectors as V
from ..operators import windows as X
from ..streaming import events as R
from .base import Book, folder, stored

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: Cues that open a unit, in the frequent words of the tables' languages.
CUES = {"en": "the|and", "de": "der|und", "fr": "les|pour", "es": "los|que"}


#: A paradigm and spelling swaps made up for the words of these tables: name -> (ending to cut, ending to add, prefix).
WEAK = {"base": ("", "", ""), "short": ("en", "", ""), "third": ("en", "t", ""), "past": ("en", "te", ""), "participle": ("en", "t", "ge")}
SWAPS = (("sch", "sh"), ("ei", "ai"))


@BOOK.query("sentence_spans")
def sentence_spans(t):
    return G.sentences(t.documents, "text", ["doc_id"])


@BOOK.query("text_chunks")
def text_chunks(t):
    return G.chunks(t.documents, "text", ["doc_id"])


@BOOK.query("target_sentence")
def target_sentence(t):
    return G.target_sentence(t.documents.where(F.lower("text").contains(" that ")), "text", F.lit(" that "), ["doc_id"])


@BOOK.query("cue_units")
def cue_units(t):
    return G.cue_units(t.documents, "text", CUES, ["doc_id"])


@BOOK.query("trusted_units")
def trusted_units(t):
    return G.trusted_units(G.cue_units(t.documents, "text", CUES, ["doc_id"]), ["en", "de"], 2.0)


@BOOK.query("unit_profile")
def unit_profile(t):
    return G.profile(G.cue_units(t.documents, "text", CUES, ["doc_id"]), ["doc_id"])


@BOOK.query("goal_inheritance")
def goal_inheritance(t):
    """Units without a trusted kind take the last trusted one before them."""
    units = G.cue_units(t.documents, "text", CUES, ["doc_id"])
    return X.carried(units, ["doc_id"], ["ord"], F.when(F.col("kind").isin("en", "de"), F.struct("kind", "start")), "goal").select("doc_id", "ord", "kind", F.col("goal.kind").alias("goal"), F.col("goal.start").alias("goal_start"))


@BOOK.query("entry_heads")
def entry_heads(t):
    return G.markup_entries(t.pages, "html", ["page_id"])


@BOOK.query("markup_sections")
def markup_sections(t):
    return G.markup_sections(t.pages, "html", ["page_id"])


#: Forms, clitics, terms and constructions made up for the words of these tables.
TRIGGERS = (("that", "link"), ("with the", "tool"), ("und", "add"), ("pour", "aim"), ("the", "name"))
CLITICS, KNOWN_WORDS = ("ed", "s"), ("was",)
TERMS = ("one", "haus", "maison", "of", "in", "die", "les")
CONSTRUCTIONS = (G.Construction("the_of", r"\bthe \w+ of\b"), G.Construction("in_with", r"\bin \w+ with\b", r"\bthat\b"), G.Construction("zu_en", r"\bzu \w+en\b"))


def _triggers(t):
    lexicon = t.spark.createDataFrame(TRIGGERS, "form string, label string")
    return G.trigger_hits(t.documents, "text", lexicon, ["doc_id"], CLITICS, KNOWN_WORDS)


@BOOK.query("trigger_offsets")
def trigger_offsets(t):
    """Forms of one to three words, and words that are a form with a clitic at its end, with their places."""
    return _triggers(t)


@BOOK.query("trigger_scan")
def trigger_scan(t):
    """Windows around triggers that hold terms, scored, at most 3,000 of a text."""
    terms = G.trigger_hits(t.documents, "text", t.spark.createDataFrame([(w, "term") for w in TERMS], "form string, label string"), ["doc_id"], longest=1)
    return G.trigger_scan(_triggers(t), terms.select("doc_id", "start", F.col("form").alias("term")), ["doc_id"], 120, 3000)


@BOOK.query("construction_hits")
def construction_hits(t):
    return G.construction_hits(t.documents, "text", CONSTRUCTIONS, ["doc_id"])


@BOOK.query("sentences_in_sql")
def sentences_in_sql(t):
    """The table function for sentences, joined laterally in SQL."""
    from ..functions.registered import register

    register(t.spark)
    return t.spark.sql("SELECT doc_id, ord, start, `end` FROM {docs}, LATERAL lexi_sentences(text)", docs=t.documents.select("doc_id", "text"))


_KAPPA = "WITH c AS (SELECT lang AS class, toxic AS a, 1 - quality AS b, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), s AS (SELECT class, CAST(sum(n) AS DOUBLE) AS t, sum(n) FILTER (WHERE a = b) AS e FROM c GROUP BY 1), x AS (SELECT class, a, sum(n) AS n FROM c GROUP BY ALL), y AS (SELECT class, b, sum(n) AS n FROM c GROUP BY ALL), p AS (SELECT class, sum(x.n * y.n) AS p FROM x JOIN y USING (class) WHERE x.a = y.b GROUP BY 1)"


@BOOK.query("kappa_by_class", f"{_KAPPA} SELECT class, CASE WHEN coalesce(p, 0) / (t * t) = 1 THEN 1.0 ELSE round((coalesce(e, 0) / t - coalesce(p, 0) / (t * t)) / (1 - coalesce(p, 0) / (t * t)), 6) END AS kappa FROM s LEFT JOIN p USING (class)")
def kappa_by_class(t):
    """Chance-corrected agreement of two labels per class, by an aggregate function over counts."""
    from ..functions.registered import kappa

    rows = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("class"), F.col("toxic").alias("a"), (1 - F.col("quality")).alias("b"))
    counts = rows.groupBy("class", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("class").agg(kappa("a", "b", "n").alias("kappa")).withColumn("kappa", F.round("kappa", 6))


@BOOK.query("hybrid_deferred")
def hybrid_deferred(t):
    """Anchored candidates under shares per label, filled up by those put off, beside unanchored ones."""
    centres = V.centroids(t.embeddings, "label", "embedding")
    best = V.scores_against(t.embeddings, "vec_id", "embedding", centres, "label", "centroid", top=1, digits=6).withColumn("score", F.round("score", 6))
    ranked = best.withColumn("key", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 101))
    anchored, others = V.hybrid_limited(ranked, "vec_id", "key", 60, centres.count())
    return anchored.select("vec_id", "label", "turn").unionByName(others.select("vec_id", "label", F.lit(0).alias("turn")))


@BOOK.query("ground_by_span")
def ground_by_span(t):
    """The first two words of each turn, held against the turn before."""
    turns = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = turns.join(before, ["conv_id", "turn"]).withColumn("value", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " "))
    return V.ground_by_span(rows.withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", "value", "context", 0.6)


@BOOK.query("mined_by_scores")
def mined_by_scores(t):
    """Triggers whose label scores enough in the document's source, at most two of a text."""
    shares = t.documents.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)
    matrix = shares.select("source", F.col("en").alias("link"), F.col("de").alias("add"), F.col("fr").alias("aim"), F.col("es").alias("tool"))
    return L.mined(_triggers(t).join(t.documents.select("doc_id", "source"), "doc_id"), matrix, "doc_id", "source", ["link", "add", "aim", "tool"], 3.0, 2)


@BOOK.query("overlap_suppression")
def overlap_suppression(t):
    """Greedy: a span is kept if it begins at or after the end of the last one kept."""
    start = F.pmod("event_id", F.lit(1000)).cast("int")
    spans = t.events.select("user_id", start.alias("start"), (start + 60).alias("end")).distinct()
    place = F.row_number().over(W.partitionBy("user_id").orderBy("start")) - 1
    return G.suppressed(spans, ["user_id"], "start", "end").select("user_id", place.alias("ord"), "start", "end")


@BOOK.query("separated_pairs")
def separated_pairs(t):
    tok = t.documents.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return G.separated_pairs(tok, ["doc_id"], ["that", "with"], ["on", "in", "of"])


@BOOK.query("verb_forms")
def verb_forms(t):
    words = t.documents.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct().where(F.endswith("word", F.lit("en")))
    return words.select("word", F.explode(M.closed_paradigm(F.col("word"), WEAK, SWAPS)).alias("form", "name"))


@BOOK.query("cascade_run")
def cascade_run(t):
    """All documents through sieve, entity, frame and roles, with a stand-in model."""
    known = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_entity"))
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return C.cascade(rows, "text", F.length("text") > 200, C.stub(["NONE", "prepare", "store", "trade"]), stored, known)


@BOOK.query("pending_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def pending_rows(t):
    done = t.labels.withColumn("error", F.when(F.col("toxic") == 1, "again"))
    return C.pending(t.documents, done, "doc_id").select("doc_id")


@BOOK.query("pending_errors_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_errors_done(t):
    done = t.labels.withColumn("error", F.when(F.col("toxic") == 1, "again"))
    return C.pending(t.documents, done, "doc_id", retry_errors=False).select("doc_id")


@BOOK.query("batch_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS errors, round(count(quality) / count(*), 6) AS filled FROM labels")
def batch_checks(t):
    return t.labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("errors"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("filled"))


@BOOK.query("stream_resume_dedupe", "SELECT DISTINCT event_id FROM events")
def stream_resume_dedupe(t):
    path, where = f"{t.sf_dir.rstrip('/')}/events.parquet", folder(t.spark)
    return R.deduplicated_into(R.event_stream(t.spark, path).select("event_id"), "event_id", f"{where}/out", f"{where}/check").select("event_id")


@BOOK.query("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    path, where = f"{t.sf_dir.rstrip('/')}/events.parquet", folder(t.spark)
    return R.drained(R.tumbling(R.event_stream(t.spark, path), "ts", "1 day", ["event_type"]), f"{where}/out", f"{where}/check", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@BOOK.query("coupled_quota")
def coupled_quota(t):
    return S.coupled_quota(t.orders, "o_orderkey", "o_orderpriority", {"1-URGENT": 40, "2-HIGH": 20, "5-LOW": 10}, "o_custkey", 1, [T.hash_order(F.col("o_orderkey")), "o_orderkey"]).select("o_orderkey", "o_orderpriority", "o_custkey")


@BOOK.query("linear_probe")
def linear_probe(t):
    """Logistic regression on embeddings; folds by group, accuracy on the held-out fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = S.folds(t.embeddings, T.hash_order(F.col("vec_id")), 5).select("vec_id", F.col("label").cast("double").alias("label"), "fold", array_to_vector("embedding").alias("features"))
    model = LogisticRegression(maxIter=20, regParam=0.1).fit(rows.where("fold <> 0"))
    return model.transform(rows.where("fold = 0")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))


@BOOK.query("word_vectors")
def word_vectors(t):
    """Skip-gram vectors of the corpus, and the words nearest to some targets."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    sentences = t.documents.select(T.tokens(F.col("text")).alias("words"))
    # Shards that each learn and are then averaged: one a core, of a thousand documents at least. Passes are fixed, so work grows with the corpus.
    parts = max(1, min(t.spark.sparkContext.defaultParallelism, sentences.count() // 1000))
    model = Word2Vec(vectorSize=16, minCount=5, maxIter=8, numPartitions=parts, seed=7, inputCol="words", outputCol="v").fit(sentences)
    vectors = model.getVectors().select(F.col("word"), vector_to_array("vector").alias("v"))
    known = t.spark.createDataFrame([("the", 0), ("und", 1), ("les", 2), ("que", 3)], "word string, n int").join(vectors, "word")
    near = V.similarities(vectors, "word", "v", {r["word"]: list(r["v"]) for r in known.collect()}, "target").where("word <> target")  # the targets are a parameter
    return X.top_k(near, ["target"], [F.desc("score"), "word"], 5).select("target", "word", F.round("score", 4).alias("similarity"))


@BOOK.query("text_encoder")
def text_encoder(t):
    """Hashed term frequencies as vectors: a stand-in for an encoder, then unit length."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    hashed = HashingTF(numFeatures=64, inputCol="words", outputCol="v").transform(t.documents.select("doc_id", T.tokens(F.col("text")).alias("words")))
    return hashed.select("doc_id", F.transform(V.unit(vector_to_array("v")), lambda x: F.round(x, 6)).alias("vector"))


@BOOK.query("catalog_check")
def catalog_check(t):
    from ..sources.catalog import Catalog

    names = ("documents", "labels", "events", "pages")
    catalog = Catalog({"data": {"root": t.sf_dir}, "gone": {"root": "/nowhere"}}, {n: {"tier": "data", "path": f"{n}.parquet", "phase": "frozen"} for n in names} | {"lost": {"tier": "gone", "path": "x.parquet"}})
    return catalog.check(t.spark)
