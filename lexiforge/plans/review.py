"""Queries of review sheets, glosses, genres, annotated sentences and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as O
from .base import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
_NORM = r"trim(regexp_replace(replace(replace(replace(lower(x), 'ſ', 's'), 'æ', 'ae'), 'œ', 'oe'), '[^\p{L}]+', ' ', 'g'))"


@BOOK.query("review_filters", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND toxic = 0 AND n_chars >= 200 AND contains(lower(text), 'the') AND trim(coalesce(source, '')) <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def review_filters(t):
    """Conditions that are asked together, two of them left open, and the rows that a review accepts."""
    rows = t.documents.join(t.labels, "doc_id")
    some = O.review_rows(rows, equal={"toxic": 0, "quality": None}, among={"lang": ["en", "de"], "source": None}, contains={"text": "The"}, least={"n_chars": 200}, blank={"source": False})
    verdicts = t.labels.select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("verdict"))
    return O.accepted(some, verdicts, "doc_id", "verdict").select("doc_id")


_RAW = "p_name || ', ' || replace(p_name, ' ', ';') || '| ' || p_type || ' ' || p_name"


@BOOK.query("listed_forms", f"""WITH r AS (SELECT p_partkey, unnest(string_split_regex({_RAW}, '[,;|]')) AS x FROM part), n AS (SELECT p_partkey, {_NORM} AS x FROM r),
f AS (SELECT DISTINCT p_partkey, f FROM (SELECT p_partkey, x AS f FROM n UNION ALL SELECT p_partkey, replace(x, ' ', '') FROM n) WHERE f <> '')
SELECT p_partkey, count(*) AS n, string_agg(f, '|' ORDER BY f) AS forms FROM f GROUP BY 1""")
def listed_forms(t):
    """Spellings in a delimited list, with and without their blanks."""
    raw = F.concat("p_name", F.lit(", "), F.replace("p_name", F.lit(" "), F.lit(";")), F.lit("| "), "p_type", F.lit(" "), "p_name")
    forms = t.part.select("p_partkey", T.listed_forms(raw).alias("f"))
    return forms.select("p_partkey", F.size("f").cast("long").alias("n"), F.array_join(F.array_sort("f"), "|").alias("forms"))


@BOOK.query("gloss_classes", f"SELECT p_partkey, CASE WHEN string_split(x, ' ')[1] IN ('small', 'large') THEN 'size' WHEN string_split(x, ' ')[1] = 'hot' THEN 'heat' WHEN contains(x, 'bolt') OR contains(x, 'gear') THEN 'tool' WHEN contains(x, 'promo') THEN 'trade' END AS class FROM (SELECT p_partkey, {_NORM} AS x FROM (SELECT p_partkey, p_name || ' [' || p_type || ']' AS x FROM part))")
def gloss_classes(t):
    """Glosses by their head word, else by keywords."""
    gloss = F.concat("p_name", F.lit(" ["), "p_type", F.lit("]"))
    return t.part.select("p_partkey", T.gloss_class(gloss, {"small": "size", "large": "size", "hot": "heat"}, [(("bolt", "gear"), "tool"), (("promo",), "trade")]).alias("class"))


GENRES = T.GenreRules({"brand": {"Brand#1": "ALPHA", "Brand#7": "OMEGA"}}, "type", (("PROMO", "SALE"), ("ECONOMY", "CHEAP")), "name", (("TOOLS", "bolt|gear"), ("RINGS", "ring")), (("SMALL", "^small"),))


@BOOK.query("genre_ladder", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'LARGE' WHEN p_brand = 'Brand#1' THEN 'ALPHA' WHEN p_brand = 'Brand#7' THEN 'OMEGA' WHEN p_type = 'PROMO' THEN 'SALE' WHEN p_type = 'ECONOMY' THEN 'CHEAP' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'TOOLS' WHEN regexp_matches(p_name, 'ring') THEN 'RINGS' WHEN regexp_matches(p_name, '^small') THEN 'SMALL' ELSE 'UNKNOWN' END AS genre, CASE WHEN p_size > 45 THEN 'regime' WHEN p_brand IN ('Brand#1', 'Brand#7') THEN 'brand' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'type' WHEN regexp_matches(p_name, 'bolt|gear|ring') THEN 'name' WHEN regexp_matches(p_name, '^small') THEN 'title' ELSE 'none' END AS source FROM part")
def genre_ladder(t):
    """The genre of each record by the first rule of the ladder that fits, and where it came from."""
    claim = lambda scheme, c: F.struct(F.lit(scheme).alias("scheme"), F.col(c).alias("value"))
    claims = F.array(claim("name", "p_name"), claim("type", "p_type"), claim("brand", "p_brand"))
    found = T.genre(F.when(F.col("p_size") > 45, "LARGE").otherwise("UNKNOWN"), claims, F.col("p_name"), GENRES)
    return t.part.select("p_partkey", found.alias("g")).select("p_partkey", "g.genre", "g.source")


#: Tags made up for the words of these tables.
TAGS = {"the": ("formal",), "of": ("food", "keep"), "in": ("store",), "der": ("formal", "cook"), "die": ("keep",), "les": ("food",), "dans": ("cook",), "los": ("formal",), "para": ("store",)}
TIERS, FRAMES = (("food",), ("formal",), ("keep", "cook", "store")), ("keep", "cook", "store")
_TAGS = ", ".join(f"('{w}', [{', '.join(repr(x) for x in tags)}])" for w, tags in TAGS.items())


@BOOK.query("annotated_targets", rf"""WITH w AS (SELECT conv_id, turn, w, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM conversations)),
t AS (SELECT conv_id, turn, i, tags FROM (SELECT conv_id, turn, i, w[i + 1] AS word FROM w) JOIN (VALUES {_TAGS}) AS g(word, tags) USING (word)),
l AS (SELECT *, CASE WHEN list_contains(tags, 'food') THEN 0 WHEN list_contains(tags, 'formal') THEN 1 WHEN list_has_any(tags, ['keep', 'cook', 'store']) THEN 2 END AS tier, CASE WHEN list_contains(tags, 'keep') THEN 1 WHEN list_contains(tags, 'cook') THEN 2 WHEN list_contains(tags, 'store') THEN 3 END AS f FROM t),
s AS (SELECT conv_id, turn, min(tier) AS best, min(f) AS f0 FROM l GROUP BY ALL)
SELECT conv_id, turn, CAST(i AS INTEGER) AS place, tier, CASE coalesce(f, f0) WHEN 1 THEN 'keep' WHEN 2 THEN 'cook' WHEN 3 THEN 'store' ELSE 'NONE' END AS frame FROM l JOIN s USING (conv_id, turn) WHERE tier = best""")
def annotated_targets(t):
    """Targets of annotated turns by tier, each with its frame: its own, the turn's only one, or the first by priority."""
    words = t.conversations.select("conv_id", "turn", F.posexplode_outer(T.tokens(F.col("text"))).alias("place", "word"))
    tags = F.create_map(*(x for w, tags in TAGS.items() for x in (F.lit(w), F.array(*map(F.lit, tags)))))
    tokens = words.withColumn("tags", F.try_element_at(tags, F.col("word"))).where("tags is not null")
    return O.sentence_targets(tokens, ["conv_id", "turn"], "place", "tags", TIERS, FRAMES)


_GUESS = "list_filter([CASE WHEN contains(t, ' the ') THEN 'en' END, CASE WHEN contains(t, ' und ') THEN 'de' END, CASE WHEN contains(t, ' les ') THEN 'fr' END, CASE WHEN contains(t, ' los ') THEN 'es' END], lambda x: x IS NOT NULL)"


@BOOK.query("baseline_lead", f"""WITH r AS (SELECT source, lang AS gold, c, CASE WHEN len(c) > 0 THEN c[len(c)] ELSE 'en' END AS pred FROM (SELECT source, lang, {_GUESS} AS c FROM (SELECT source, lang, lower(text) AS t FROM documents)) WHERE lang IS NOT NULL),
m AS (SELECT source, max(n) AS most FROM (SELECT source, gold, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
s AS (SELECT source, count(*) AS n, avg(CAST(pred = gold AS INTEGER)) AS a, avg(CAST(coalesce(list_contains(c, gold), false) AS INTEGER)) AS i, avg(CAST(coalesce(c[1] = gold, false) AS INTEGER)) AS f, avg(CASE WHEN coalesce(list_contains(c, gold), false) THEN 1.0::DOUBLE / len(c) ELSE 0 END) AS h FROM r GROUP BY 1)
SELECT source, n, round(a, 6) AS accuracy, round(i, 6) AS reachable, round(f, 6) AS first_candidate, round(h, 6) AS chance, round(most::DOUBLE / n, 6) AS majority, round(a - greatest(f, most::DOUBLE / n, h), 6) AS lead FROM s JOIN m USING (source)""")
def baseline_lead(t):
    """A guess of each text's language from candidates, against candidates alone, the commonest language and chance."""
    low = F.lower("text")
    guesses = F.array_compact(F.array(*(F.when(low.contains(f" {w} "), lang) for w, lang in (("the", "en"), ("und", "de"), ("les", "fr"), ("los", "es")))))
    rows = t.documents.select("source", "lang", F.coalesce(guesses, F.array().cast("array<string>")).alias("c")).withColumn("pred", F.coalesce(F.try_element_at("c", F.lit(-1)), F.lit("en")))
    return O.against_baselines(rows, "lang", "pred", "c", ["source"])
