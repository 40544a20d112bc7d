"""Semantics that are easy to get wrong, on small literal tables."""


import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiforge.functions import forms, text as T
from lexiforge.operators import aggregates as A, cascade as C, joins as J, lexicon as L, merge as M, metrics as E, sampling as S, segmentation as G, vectors as V, windows as X


def column(df, name):
    return [r[name] for r in df.collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_normal_and_keys(spark):
    assert one(spark, T.normal(F.lit("  Daſ Œuvre—42 x"))) == "das oeuvre x"
    assert one(spark, T.slug(F.lit("  A b!! C "))) == "a_b_c"
    assert one(spark, T.loose_key(F.lit("Ballen"))) == "balen"
    rules = (T.Rule("f", "ph", "f"), T.Rule("tail", "(?<=o)h$", ""), T.Rule("twice", r"(n)\1", "$1"))
    assert one(spark, T.spelling_key(F.lit("Phannoh"), rules)) == "fano"
    assert one(spark, T.spelling_key(F.lit("Phannoh"), rules, ("twice",))) == "fanno"
    assert one(spark, T.fired_rules(F.lit("phanah"), rules)) == ["f"]
    assert one(spark, T.loose_key(F.lit("gegessen"), ("ge",))) == "gesen"
    assert one(spark, T.sound_key(F.lit("Schouh"), (("sch", "x"), ("ou", "u")), ("h", "x"))) == "xux"
    assert [tuple(x) for x in one(spark, T.swapped(F.lit("rnarn"), (("rn", "m"),)))] == [("marn", "rn>m"), ("rnam", "rn>m")]
    assert one(spark, T.swapped(F.lit("a"), (("rn", "m"),))) == []
    assert [one(spark, T.eligible(F.lit(w))) for w in ("ab", "abc", "a b c")] == [False, True, False]


def test_split_at_middle(spark):
    texts = ["the end", "other words", "a the b The ", "xthexx the", "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: (r.before, r.keyword, r.after) for r in T.split_at_middle(df, "text", "the").collect()}
    for i, text in enumerate(texts):
        places = [k for k in range(len(text)) if text.lower().startswith("the", k)]
        if places:
            at = min(places, key=lambda k: (abs(k - len(text) // 2), k))
            a, b = at, at + 3
            while a and text[a - 1].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha():
                b += 1
            assert got[i] == (text[:a], text[a:b], text[b:])
    assert set(got) == {0, 1, 2, 3}


def test_bools(spark):
    assert one(spark, T.tolerant_bool(F.lit(" Ja "))) is True
    assert one(spark, T.tolerant_bool(F.lit("huh"))) is None
    assert one(spark, T.strict_bool(F.lit(" "))) is None
    with pytest.raises(PySparkException):
        one(spark, T.strict_bool(F.lit("huh")))


def test_soft_match_blanks(spark):
    assert one(spark, T.soft_match(F.lit(""), F.lit(None).cast("string"))) is True
    assert one(spark, T.soft_match(F.lit("a"), F.lit(""))) is False
    assert one(spark, T.soft_match(F.lit("the salt"), F.lit("Salt"))) is True


def test_list_and_tags(spark):
    assert one(spark, T.parse_list(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, T.parse_list(F.lit("not a list"))) == []
    assert one(spark, T.tag_set(F.lit(" B|a||b "))) == ["a", "b"]
    assert one(spark, T.tag_set(F.lit(None).cast("string"))) == []


def test_token_f1(spark):
    assert one(spark, T.token_f1(F.split(F.lit("a a b"), " "), F.split(F.lit("a b b"), " "))) == pytest.approx(2 / 3)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 40])
def test_evenly_spaced(spark, n):
    df = spark.range(n).withColumn("k", F.lit(1))
    got = sorted(column(X.evenly_spaced(df, ["k"], ["id"], 4), "id"))
    assert got == (list(range(n)) if n <= 4 else [k * n // 4 for k in range(4)])


def test_carried_scope_resets(spark):
    rows = [(1, "a", False), (2, None, False), (3, None, True), (4, None, False), (5, "b", False)]
    df = spark.createDataFrame(rows, "n int, v string, divider boolean").withColumn("k", F.lit(1))
    out = X.carried_scope(df, ["k"], ["n"], F.col("v"), F.col("divider"), "scope").orderBy("n")
    assert column(out, "scope") == ["a", "a", None, None, "b"]


def test_asof(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 7), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "k int, start int, v string")
    got = {(r.k, r.at): r.v for r in J.asof_join(left, right, ["k"], "at", "start", ["v"]).collect()}
    assert got == {(1, 0): None, (1, 5): "x", (1, 7): "y", (2, 9): None}


def test_interval_and_band(spark):
    points = spark.createDataFrame([(1, i) for i in range(0, 30, 5)], "k int, p int")
    spans = spark.createDataFrame([(1, 5, 20, "s"), (1, 9, 9, "empty")], "k int, a int, b int, name string")
    assert sorted(column(J.interval_join(points, spans, ["k"], F.col("p"), "a", "b", 4), "p")) == [5, 10, 15]
    left = spark.createDataFrame([(1, 10)], "k int, a int")
    right = spark.createDataFrame([(1, b) for b in (6, 7, 10, 13, 14)], "k int, b int")
    assert sorted(column(J.band_join(left, right, ["k"], "a", "b", 3), "b")) == [7, 10, 13]


def test_upsert_locked(spark):
    base = spark.createDataFrame([("a", "old", True), ("b", "old", False), ("c", "old", False)], "id string, v string, locked boolean")
    update = spark.createDataFrame([("a", "new"), ("b", "new"), ("d", "new")], "id string, v string")
    got = {r.id: (r.v, r.action) for r in M.upsert_locked(base, update, "id", ["v"], F.col("locked")).collect()}
    assert got == {"a": ("old", "kept"), "b": ("new", "updated"), "c": ("old", "kept"), "d": ("new", "added")}


def test_limit_before_dedupe(spark):
    base, more = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(column(M.append_unseen(base, more, ["id"], ["id"], 2), "id")) == [1, 2]


def test_per_class(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "C")], "gold string, pred string")
    got = {r.label: (r.precision, r.recall) for r in E.per_class(pairs).collect()}
    assert got == {"A": (1.0, 0.5), "B": (0.5, 0.5), "C": (0.0, 0.0)}


def test_agreement_states(spark):
    rows = [("a", "x", True), ("a", "y", True), ("b", "x", True), ("b", "x", False), ("c", "x", False), ("c", "x", False), ("d", "x", False), ("d", "y", False), ("e", "x", False)]
    df = spark.createDataFrame(rows, "k string, label string, dropped boolean")
    got = {r.k: r.state for r in E.agreement(df, "k", "label", F.col("dropped")).collect()}
    assert got == {"a": "all_dropped", "b": "dropped_split", "c": "agree", "d": "disagree"}


def test_sentences_and_chunks():
    text = "Wee in zout. Kook het!  En dan?"
    assert [text[a:b] for a, b in G.sentence_bounds(text)] == ["Wee in zout.", "Kook het!", "En dan?"]
    assert G.sentence_bounds("") == [] and G.chunk_bounds("") == []
    long = "word " * 200
    bounds = G.chunk_bounds(long, 300, 50)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(long) and all(b - a <= 300 for a, b in bounds)
    assert all(y[0] < x[1] for x, y in zip(bounds, bounds[1:]))
    with pytest.raises(ValueError):
        G.chunk_bounds("x", 10, 10)


def test_rendered_offsets():
    text, marks = G.rendered("<h1>Head</h1><script>no</script><p>one &amp; two<li>three")
    assert text == "Head one & two three "
    assert [(text[a:].split()[0], t) for a, t in marks] == [("Head", "h1"), ("one", "p"), ("three", "li")]


def test_greedy_overlaps(spark):
    r = __import__("random").Random(2)
    rows = [(k, a, a + r.randint(1, 9), i) for i, (k, a) in enumerate((r.choice([None, "x", "y"]), r.randint(0, 4000)) for _ in range(3000))]
    got = G.suppressed(spark.createDataFrame(rows, "k string, a int, b int, i int").repartition(5), ["k"], "a", "b", ["i"])
    want, last = set(), {}
    for k, a, b, i in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2], x[3])):
        if a >= last.get(k, -1):
            last[k] = b
            want.add((k, a, b, i))
    assert {tuple(x) for x in got.collect()} == want
    assert G.suppressed(spark.createDataFrame([], "k string, a int, b int"), ["k"], "a", "b").count() == 0


def test_units_and_profile(spark):
    df = spark.createDataFrame([(1, "Take salt. Neem water. Take more."), (2, None), (3, "")], "id int, text string")
    units = G.cue_units(df, "text", {"en": "take", "nl": "neem"}, ["id"])
    assert [(r.start, r.end, r.kind) for r in units.orderBy("ord").collect()] == [(0, 11, "en"), (11, 23, "nl"), (23, 33, "en")]
    assert G.profile(units, ["id"]).first()["dominant"] == "en"


def test_cascade_and_breaker(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 40)], "id int, text string")
    out = C.cascade(rows, "text", F.length("text") > 5, C.stub(["NONE", "xa"]), lambda df, name: df.cache())
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert sum(counts.values()) == 39 and counts["sieved"] == 5 and counts["metaphor"] > 0
    results = spark.createDataFrame([(i, "e" if 3 <= i < 13 or i in (20, 21) else None) for i in range(30)], "i int, error string").withColumn("worker", F.lit(1))
    assert [(r["first"], r["length"]) for r in C.broken_at(results, ["worker"], ["i"]).collect()] == [(4, 10)]


def test_batches_held_and_flushed(spark):
    bad, good = spark.createDataFrame([("e",)], "error string"), spark.createDataFrame([(None,)], "error string")
    seen = []
    assert C.run_batches(iter([bad, bad, good, bad]), lambda df: df, seen.append, limit=3) == 4 and len(seen) == 4
    seen = []
    with pytest.raises(RuntimeError):
        C.run_batches(iter([good, bad, bad, bad]), lambda df: df, seen.append, limit=3)
    assert len(seen) == 1


def test_coupled_quota(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i // 4) for i in range(24)], "id int, s string, t int")
    out = S.coupled_quota(df, "id", "s", {"a": 4, "b": 4}, "t", 1, ["id"]).collect()
    assert sorted(r.id for r in out if r.s == "a") == [0, 4, 8, 12] and len({r.t for r in out}) == len(out) == 6


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 0), (2, [0.0, 0.0], 0), (3, [0.0, 2.0], 1)], "id long, v array<float>, label int")
    assert column(df.orderBy("id").select(F.round(V.norm(V.unit(F.col("v"))), 6).alias("n")), "n") == [1.0, 0.0, 1.0]
    near = V.nearest_exemplar(df, "id", "v", df.where("id in (1, 3)"))
    assert {r.id: r.exemplar for r in near.collect()}[1] == 3


def test_paradigm(spark):
    df = spark.createDataFrame([("koken",)], "w string")
    rules = {"base": ("", "", ""), "third": ("en", "t", ""), "past": ("en", "te", ""), "participle": ("en", "t", "ge"), "same": ("en", "t", "")}
    plain = {"koken": "base", "kokt": "third", "kokte": "past", "gekokt": "participle"}
    assert df.select(forms.paradigm(F.col("w"), rules).alias("m")).first()["m"] == plain
    closed = df.select(forms.closed_paradigm(F.col("w"), rules, (("k", "c"),)).alias("m")).first()["m"]
    assert closed == plain | {"cocen": "base", "coct": "third", "cocte": "past", "gecoct": "participle"}


def test_cooccurrence_of_later_uses(spark):
    text = "the a x x x x x x x x x x x b the c".split()
    long = ["x"] * 998 + ["y", "the", "z", "the"]
    docs = spark.createDataFrame([(1, text), (2, []), (3, long)], "doc_id long, w array<string>")
    for piece in (3, 1000):
        got = {tuple(r) for r in A.cooccurrence(docs, "doc_id", "w", ["the"], 2, piece).select("doc_id", "target", "collocate").collect()}
        assert got == {(1, "the", c) for c in "axbc"} | {(3, "the", c) for c in "xyz"}


def test_collocates_are_counted_before_they_move(spark, tmp_path):
    """One row for a pair of words however many documents have it, null words and blank rows left out."""
    docs = spark.createDataFrame([(i, "en" if i < 60 else None, ["a", "the", None, "b", "the"]) for i in range(90)] + [(90, "de", []), (91, "de", None)], "doc_id long, lang string, w array<string>").coalesce(1)
    want = {("the", "a"): 90, ("the", "b"): 90, ("the", None): 90}
    assert {(r.target, r.collocate): r.n for r in A.collocate_counts(docs, "w", ["the", "und"], 2).collect()} == want
    by = [tuple(r) for r in A.collocate_counts(docs, "w", ["the", "und"], 2, "lang").collect()]
    assert sorted(by, key=str) == sorted([(lang, *k, n) for lang, n in (("en", 60), (None, 30)) for k in want], key=str)
    assert A.single(docs, "doc_id") and not A.single(docs.unionAll(docs.limit(1)), "doc_id") and not A.single(docs, "lang")


@pytest.mark.parametrize("name", ["cooc_pmi", "collocates_by_class", "collocates_compare"])
def test_collocates_of_repeated_ids(spark, tmp_path, name):
    """Documents that share an id count once for a pair, as in the SQL."""
    import duckdb
    from compare import same

    from lexiforge import registry

    rows = [(i % 30, "en" if i % 3 else "de", "s", "we saw the old mill and the new one " + "by the river " * (i % 2)) for i in range(40)]
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])


def test_first_runs(spark):
    """the longest, then leftmost run, not over the end of a row; one row a document leaves the batch for each length found first."""
    rows = [(1, "a of the end united arab emirates".split()), (2, "the of".split()), (3, ["united"]), (4, ["arab", None, "the"]), (5, None), (6, [])]
    docs = spark.createDataFrame(rows, "id long, w array<string>").coalesce(1)
    got = G.first_runs(docs, "id", "w", ["of the", "the of", "united arab emirates", "the", "no  such", "a b c d"], 3).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 5, "united arab emirates"), (2, 2, 1, "the of"), (4, 1, 3, "the")]


def test_near_spans_lose_none():
    """every run that reaches the threshold is kept, most of the others are not scored."""
    import random

    from lexiforge.operators.vectors import _near_spans

    cut = lambda text: {text[i : i + 3] for i in range(max(1, len(text) - 2))}
    r, kept, every = random.Random(5), 0, 0
    for _ in range(200):
        words = ["".join(r.choice("aabc") for _ in range(r.randint(1, 5))) for _ in range(12)]
        value = " ".join(words[3:5])[: r.randint(1, 9)]
        got = set(_near_spans(value, words, 1, 3, 0.6))
        for k in (1, 2, 3):
            for at in range(len(words) - k + 1):
                a, b = cut(f" {value} "), cut(f" {' '.join(words[at : at + k])} ")
                assert ((at, k) in got) == (len(a & b) >= 0.6 * (len(a) * len(b)) ** 0.5)
                every += 1
        kept += len(got)
    assert 0 < kept < every / 2


def test_few_windows_are_searched_for(monkeypatch):
    """a text that is asked for few windows is not hashed, and gives the places that hashes give."""
    from lexiforge.operators import localise as O

    text = "one two three one two four five " * 2 + "six seven"
    windows = ["three", "six seven", "eight", "", "one two", "five s"]
    monkeypatch.setattr(O, "FEW", 0)
    want = O.unique_places(text, windows)
    monkeypatch.setattr(O, "FEW", 8)
    monkeypatch.setattr(O, "_window_hashes", None)
    assert O.unique_places(text, windows) == want == [None, text.index("six"), None, None, None, text.index("five s")]


def test_most_similar_over_blocks(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(99, 7, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, field int, v array<float>")
    unit = {i: np.float32(v) / np.linalg.norm(np.float32(v)) for i, _, v in rows}
    got = {(x["id"], x["exemplar"]) for x in V.nearest_exemplar(df, "id", "v", df, "field").collect()}
    assert got == {(i, max((j for j, g, _ in rows if g == f and j != i), key=lambda j: unit[i] @ unit[j])) for i, f, _ in rows[:-1]}
    many = V.most_similar(df, df, "id", "v", 3, 5, None, 7).groupBy("query").agg(F.collect_list("id").alias("ids")).collect()
    assert {x["query"]: set(x["ids"]) for x in many} == {i: set(sorted((j for j in unit if j != i), key=lambda j: -unit[i] @ unit[j])[:3]) for i in unit}


def test_nearest_exemplar_of_many(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<float>")
    many = spark.range(1, 10_002).select("id", F.array((F.col("id") / 10_001).cast("float"), F.lit(1.0).cast("float")).alias("v"))
    assert V.nearest_exemplar(few, "id", "v", many).first()["exemplar"] == 10_001


def test_found_values_are_whole(spark):
    docs = spark.createDataFrame([(1, "x ONE two three four fivesix end"), (2, "one two other"), (3, "a bc"), (None, "one two three four five"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(41, " e two Three four Five "), (42, "one two three four nine"), (43, "B"), (44, " ")], "item_id int, item string")
    got = {tuple(r) for r in J.found_values(docs, items, "doc_id", "text", "item").select("doc_id", "item_id").collect()}
    assert got == {(1, 41), (None, 41), (3, 43)}


def test_contains_finds_every_needle(spark):
    import random

    r = random.Random(2)
    texts = [" ".join(r.choice(["ab", "abc", "b", "ca", "Cab"]) for _ in range(12)) for _ in range(40)] + ["", None, "tail"]
    needles = ["a", "ab", "bc a", "b ca", "abc b c", "ca ab abc b", " ab", "ab  b", "Cab ca b ab", "tail", "zz", "", "b abc ca ab b"]
    needles += [t[a : a + n] for t in texts[:10] for a, n in ((0, 9), (2, 14), (5, 30))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    values = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")
    for fold in (False, True):
        low = (lambda x: x.lower()) if fold else (lambda x: x)
        want = sorted((i, n) for i, t in enumerate(texts) for n, v in enumerate(needles) if t is not None and v and low(v) in low(t))
        assert sorted(tuple(x) for x in J.contains_join(df, values, "id", "text", "needle", fold).select("id", "n").collect()) == want


def test_shingle_pairs(spark):
    docs = {1: "a b c d e f", 2: "a b c d x", 3: "c d e f", 4: "a b", 5: "q r s t u"}
    df = spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "id int, w array<string>")
    got = {(x.a, x.b): (x.shared, round(x.share, 4)) for x in J.shingle_pairs(df, "id", "w", 3, 2, 9, 0.1).collect()}
    assert got == {(1, 2): (2, 0.6667), (1, 3): (2, 1.0)}


def test_samples_by_thresholds(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"), T.hash_order(F.col("id")).alias("h"))
    rows = {x.id: (x.s, x.h) for x in df.collect()}
    first = sorted(rows, key=lambda i: (rows[i][1], i))
    for n in (0, 1, 700, 1999, 2000, 5000):
        assert sorted(column(S.first_by_hash(df, F.col("h"), ["id"], n), "id")) == sorted(first[:n])
    split = {x.id: x.split for x in S.stratified_split(df, "s", ["h", "id"], 20, F.col("id") < 100).collect()}
    want = {i for s in range(3) for i in [i for i in first if rows[i][0] == s and i >= 100][:20]}
    assert len(split) == 2000 and {i for i, x in split.items() if x == "dev"} == want
    pinned = {x.id: x.pool for x in S.pinned_buckets(df, "s", F.col("id").isin(0, 3, 6, 1), ["h", "id"], 2).collect()}
    others = [i for i in first if i not in (0, 3, 6, 1)]
    want = {0, 3, 6, 1} | {next(i for i in others if rows[i][0] == 1)} | set([i for i in others if rows[i][0] == 2][:2])
    assert set(pinned) == want and pinned[0] == 667


def test_compounds_of_any_length(spark):
    known = "ei brot suppe rundfunkanstalt haupt tee er eisuppe hauptrundfunkanstalt brottee xybrot eier".split()
    got = {tuple(r) for r in A.compounds(spark.createDataFrame([(w,) for w in known], "form string"), "form").select("form", "head", "modifier").collect()}
    assert got == {("eisuppe", "suppe", "ei"), ("hauptrundfunkanstalt", "rundfunkanstalt", "haupt"), ("brottee", "tee", "brot")}


def test_asof_in_buckets_equals_asof(spark):
    import random

    r = random.Random(5)
    left = spark.createDataFrame([(r.randrange(3), r.randrange(400), i) for i in range(200)], "k int, at long, i int")
    marks = {(r.randrange(3), r.randrange(400)): r.randrange(9) for _ in range(25)}
    right = spark.createDataFrame([(k, a, v) for (k, a), v in marks.items()], "k int, start long, v int")
    plain = sorted(map(str, J.asof_join(left, right, ["k"], "at", "start", ["v"]).collect()))
    for width in (1, 30, 1000):
        assert sorted(map(str, J.bucketed_asof_join(left, right, ["k"], "at", "start", ["v"], width).collect())) == plain


def test_trigger_hits_with_places(spark):
    text = "Zout's in de kook't. Kookte het, In De pot kookt"
    lexicon = spark.createDataFrame([("kook", "cook"), ("kookt", "cook"), ("in de", "where"), ("zout", "food"), ("de pot", "thing")], "form string, label string")
    df = spark.createDataFrame([(1, text), (2, None), (3, "kooks pots")], "id int, text string")
    got = {(x.id, text[x.start : x.end] if x.id == 1 else "", x.surface, x.form, x.clitic) for x in G.trigger_hits(df, "text", lexicon, ["id"], ("te", "t", "s"), ("kooks",)).collect()}
    assert got == {(1, "Zout's", "Zout", "zout", "s"), (1, "in de", "in de", "in de", ""), (1, "kook't", "kook", "kook", "t"), (1, "Kookte", "Kook", "kook", "te"), (1, "In De", "In De", "in de", ""), (1, "De pot", "De pot", "de pot", ""), (1, "kookt", "kookt", "kookt", "")}


def test_trigger_scan(spark):
    hits = spark.createDataFrame([(1, 10, "a"), (1, 15, "b"), (1, 40, "c"), (1, 90, "d")], "id int, start int, label string")
    terms = spark.createDataFrame([(1, 12, "x"), (1, 18, "y"), (1, 19, "y"), (1, 45, "x"), (2, 90, "x")], "id int, start int, term string")
    got = [tuple(x) for x in G.trigger_scan(hits, terms, ["id"], 10, 5).orderBy("start").collect()]
    assert got == [(1, 10, "a", 2, 2), (1, 40, "c", 1, 1)]
    assert [x.start for x in G.trigger_scan(hits, terms, ["id"], 10, 1).collect()] == [10]


def test_constructions_need_their_cue(spark):
    df = spark.createDataFrame([(1, "salt of the sea, cure for cough"), (2, "cure for nothing" + " " * 150 + "sick"), (3, None)], "id int, text string")
    rules = [G.Construction("of", r"\w+ of the \w+"), G.Construction("cure", r"cure for \w+", r"cough|sick")]
    assert [(x.id, x.name, x.part) for x in G.construction_hits(df, "text", rules, ["id"]).orderBy("id", "ord").collect()] == [(1, "of", "salt of the sea"), (1, "cure", "cure for cough")]


def test_sections_of_markup(spark):
    page = "<h1>Book</h1><p>intro</p><h2>Salt</h2><p><b>Zout</b> is <i>Use.</i> good <i>Use</i></p><ul><li>one <b>late</b></li></ul><h3>Deep</h3><p>x</p><h2>Pepper</h2><h1>End</h1><td><b>Tail</b></td>"
    rows = G.markup_sections(spark.createDataFrame([(1, page), (2, None), (3, "<p>no head</p>")], "id int, html string"), "html", ["id"]).orderBy("ord").collect()
    assert [(x.head, x.level, x.path, x.carriers, x.anchors, x.rubrics) for x in rows] == [
        ("Book", 1, "Book", "p=1", [], []),
        ("Salt", 2, "Book / Salt", "p=1,li=1", ["Zout"], ["Use"]),
        ("Deep", 3, "Book / Salt / Deep", "p=1", [], []),
        ("Pepper", 2, "Book / Pepper", "", [], []),
        ("End", 1, "End", "td=1", ["Tail"], []),
    ]
    starts = {x.head: (x.start, x.end) for x in rows}
    assert starts["Book"] == (0, starts["End"][0]) and starts["Salt"][1] == starts["Pepper"][0] == starts["Deep"][1]


def test_span_scores(spark):
    df = spark.createDataFrame([("f", "the red pot", "red pot"), ("f", None, ""), ("f", "", "pot"), ("f", "salt", "Salt!")], "k string, g string, p string")
    x = E.span_scores(df, "g", "p", "k").first()
    assert (x.n, x.n_positive, x.exact, x.f1, x.soft) == (4, 2, 0.5, 0.7, 0.75) and (x.positive_exact, x.positive_f1, x.positive_soft) == (0.5, 0.9, 1.0)


def test_grounding_by_span(spark):
    rows = [(1, "red pot", "a Red Pot here"), (2, "red pots", "the reds and the red pot"), (3, "zebra", "nothing alike"), (4, " ", "x"), (5, "word", None)]
    df = spark.createDataFrame(rows, "id int, v string, c string")
    got = {x.id: (x.v, x.grounded, x.replaced) for x in V.ground_by_span(df, "id", "v", "c", 0.6).collect()}
    assert got == {1: ("red pot", True, False), 2: ("red pot", True, True), 3: ("zebra", False, False), 4: (" ", True, False), 5: ("word", False, False)}


def test_hybrid_equals_one_by_one(spark):
    import random

    r = random.Random(9)
    rows = [(i, r.choice("abc"), round(r.random(), 3), r.choice([None, *range(12)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string, score double, key long")
    for limit in (6, 10, 40):
        seen, count, kept, later = set(), {}, [], []
        order = sorted((x for x in rows if x[3] is not None), key=lambda x: (-x[2], x[0]))
        for turn, part in ((1, order), (2, later)):
            for x in part:
                if x[3] in seen or len(kept) >= limit:
                    continue
                if turn == 1 and count.get(x[1], 0) >= max(1, limit // 3):
                    later.append(x)
                    continue
                seen.add(x[3])
                count[x[1]] = count.get(x[1], 0) + 1
                kept.append((x[0], turn))
        anchored, others = V.hybrid_limited(df, "id", "key", limit, 3)
        assert sorted((x.id, x.turn) for x in anchored.collect()) == sorted(kept)
        assert others.count() == min(limit, sum(x[3] is None for x in rows))


def test_masked_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], True), (1, [3.0, 6.0], True), (1, [9.0, 9.0], False), (2, [5.0, 5.0], False)], "k int, v array<double>, m boolean")
    assert {x.k: (x.n, x.pooled) for x in V.mean_pool(df, "k", "v", "m").collect()} == {1: (2, [2.0, 4.0]), 2: (0, [0.0, 0.0])}


def test_mined_by_scores(spark):
    hits = spark.createDataFrame([(1, "k", 5, "a", "x"), (1, "k", 9, "b", "y"), (1, "k", 12, "a", "z"), (2, "q", 1, "a", "x")], "id int, key string, start int, label string, form string")
    matrix = spark.createDataFrame([("k", 4, 1), ("q", 0, 9)], "key string, a long, b long")
    assert [tuple(x) for x in L.mined(hits, matrix, "id", "key", ["a", "b"], 2.0, 2).collect()] == [(1, "k", 5, "a", "x", 4.0)]


def test_functions_in_sql(spark):
    from lexiforge.functions.registered import register

    register(spark)
    df = spark.createDataFrame([(1, "One. Two!"), (2, None)], "id int, text string")
    got = spark.sql("SELECT id, ord, part FROM {t}, LATERAL lexi_sentences(text)", t=df).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "One."), (1, 1, "Two!")]
    counts = spark.createDataFrame([("x", "x", 20), ("x", "y", 5), ("y", "x", 10), ("y", "y", 15)], "a string, b string, n long")
    assert spark.sql("SELECT lexi_kappa(a, b, n) AS k FROM {t}", t=counts).first().k == pytest.approx(0.4)


def test_capped_collocates(spark):
    pairs = spark.createDataFrame([(i, "t", c) for i in range(6) for c in ("a", "b")] + [(0, "t", "rare")], "doc int, target string, collocate string")
    works = spark.createDataFrame([(i, "t", "w" if i < 5 else "v") for i in range(6)], "doc int, target string, work string")
    counts = pairs.groupBy("collocate").count()
    got = A.capped_collocates(pairs, counts, "count", works, "work", F.col("doc"), 2, 2, 1).collect()
    assert [tuple(x) for x in got] == [("t", "a", 3, 6, round(14 + __import__("math").log2(6 / 9), 6))]


def test_numbers_over_buckets(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"))
    got = X.numbered(df, ["k"], F.floor(F.col("id") / 40), ["id"], "i", "n").collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.id)
    assert sorted((r.id, r.i, r.n) for r in got) == sorted((v, i, len(g)) for g in groups.values() for i, v in enumerate(sorted(g)))
    even = X.evenly_spaced(df, ["k"], ["id"], 4, F.floor(F.col("id") / 40))
    assert sorted(map(tuple, even.collect())) == sorted(map(tuple, X.evenly_spaced(df, ["k"], ["id"], 4).collect()))


def test_list_literals_with_apostrophes(spark):
    read = lambda s: one(spark, T.parse_list(F.lit(s)))
    assert read("""["l'eau", 'zout']""") == ["l'eau", "zout"]
    assert read(r"""['it\'s', "say \"yes\"", 'back\\slash']""") == ["it's", 'say "yes"', "back\\slash"]
    assert read("[]") == [] and read("[ 1, two , 'three' ]") == ["1", "two", "three"] and read("['a, b', ']']") == ["a, b", "]"]
    assert read("['open") == [] and read("['a' 'b']") == [] and read("['a'], x") == []
    assert read("['" + "x" * 200_000 + "']") == ["x" * 200_000]


def test_long_headings_stay_whole(spark):
    long = "word " * 100
    page = f"<h1>{long}one</h1><p>a<i>First.</i> <i>First.</i> b <i>Second:</i></p><h1>{long}two</h1><p><b>{long}</b> x</p>"
    rows = G.markup_sections(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).orderBy("ord").collect()
    assert [r["path"] for r in rows] == [f"{long}one", f"{long}two"]
    assert rows[0]["rubrics"] == ["First", "Second"] and rows[1]["anchors"] == [long.strip()]
    entries = G.markup_entries(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).collect()
    assert max(len(r["head"]) for r in entries) >= 500


def test_shingle_pairs_of_a_long_text(spark):
    import time

    from lexiforge.operators import joins

    base = [f"w{i % 9973}x{i % 31}" for i in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[5000:12_000])), (3, "nothing shared here at all"), (4, "too short"), (5, None)], "id int, text string")
    tokens = df.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    pairs = joins.shingle_pairs(tokens, "id", "w", 5, 2, 29, 0.3)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    began = time.time()
    assert [(r["a"], r["b"], r["shared"]) for r in pairs.collect()] == [(1, 2, 6996)]
    assert time.time() - began < 30


def test_unique_windows_and_places(spark):
    from lexiforge.operators import localise as O

    r = __import__("random").Random(3)
    text = "".join(r.choice("ab c") for _ in range(3000)) + "needle in the hay " * 2
    some = [text[i : i + w] for i in range(0, 2900, 97) for w in (5, 15, 25)] + ["", "zzz", "needle in the hay", text]
    want = [text.find(w) if w and text.find(w) >= 0 and text.find(w, text.find(w) + 1) < 0 else None for w in some]
    assert O.unique_places(text, some) == want and None in want and any(want)
    assert O.unique_places("ab", ["abc"]) == [None] and O.unique_places("", ["a"]) == [None]
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    assert O.unique_places(tm, [tm[100:2148], tm[:2048]]) == [tm.find(tm[100:2148]) if tm.count(tm[100:2148]) == 1 else None, 0]

    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    twice = "one two three four five six seven eight nine ten target eleven twelve " * 2
    asked = [
        ("w", "epsilon zeta eta theta", "eta", 34, "exact"), ("w", "XX" + line[2:], "iota", line.find("iota"), "60"), ("w", line[:60] + "##" + line[62:70], "theta", line.find("theta"), "25"),
        ("w", "nothing alike here", "alike", None, None), ("w", "#" * 20 + " lambda mu nu " + "#" * 20, "lambda", None, None), ("w", "gone", "absent", None, None),
        ("d", "#x# " + twice[20:68] + " #y#", "target", None, None), ("lost", "alpha", "alpha", None, None), (None, "alpha", "alpha", None, None), ("w", None, None, 0, "exact"),
    ]
    texts = spark.createDataFrame([("w", line), ("d", twice), ("n", None)], "work string, t string")
    df = spark.createDataFrame([(*a[:3], i, 1) for i, a in enumerate(asked)], "work string, c string, target string, n int, _chunk int")
    got = {r["n"]: (r["place"], r["found"]) for r in O.localised(df, texts, "work", "c", "target", "t").collect()}
    assert [got[i] for i in range(len(asked))] == [a[3:] for a in asked]
    again = spark.createDataFrame([("w", "a"), ("w", "b")], "work string, t string")
    with pytest.raises(Exception, match="several texts"):
        O.localised(df, again, "work", "c", "target", "t").collect()


def test_matched_contexts_in_three_tiers(spark):
    from lexiforge.operators import localise as O

    long = "the quick brown fox jumps over the lazy dog while many other animals look on from a safe distance behind the old fence"
    left = [("a", "fox", long), ("b", "fox", "The  QUICK brown " + long[16:]), ("c", "fox", "lead in " + long), ("d", "fox", long[8:100]), ("e", "cat", long), ("f", "fox", ""), ("g", None, long), ("h", "fox", None)]
    right = [("a", "owl", "else", 9), ("r1", "fox", long, 2), ("r0", "fox", long, 1), ("r2", "fox", "", 0), ("r3", "fox", "x " + long[6:], 3), ("r4", None, long, 0)]
    got = O.matched_contexts(spark.createDataFrame(left, "id string, term string, context string"), spark.createDataFrame(right, "id string, term string, context string, n int"), "id", "term", "context", "n")
    assert {r["id"]: (r["other"], r["tier"]) for r in got.collect()} == {"a": ("a", 1), "b": ("r0", 2), "c": ("r0", 3), "d": ("r0", 3), "e": (None, None), "f": (None, None), "g": (None, None), "h": (None, None)}


def plain_closure(words, rules):
    import re

    known = list(dict.fromkeys(words))
    while True:
        more = [f for w in known for f in (re.sub(p, r, w) for p, r in rules) if f not in known]
        if not more:
            return set(known)
        known += list(dict.fromkeys(more))


def test_forms_to_a_fixed_point(spark):
    from lexiforge.functions import forms as W

    chain = [("aa", "ae"), ("ae", "e"), ("ck", "kk"), ("kk", "x"), ("^x", "sh"), ("sh", "sj")]
    rules = [T.Rule(f"r{i}", p, r) for i, (p, r) in enumerate(chain)]
    for word in ("baacken", "ckaa", "plain", ""):
        got = one(spark, W.closure(F.array(F.lit(word)), rules))
        assert set(got) == plain_closure([word], chain) and len(got) == len(set(got)) and got[0] == word
    assert len(one(spark, W.closure(F.array(F.lit("ckaa")), rules))) > 8  # forms that only two or more steps reach
    with pytest.raises(Exception, match="no end"):
        one(spark, W.closure(F.array(F.lit("a")), [T.Rule("grow", "a$", "aa")]))

    table = W.FormRules("en", (T.Rule("double", "([bk])[bk]$", "$1"), T.Rule("open", "(o)(k)$", "$1$1$2")), (T.Rule("v", "v$", "f"),), {"stem": ("", ""), "past": ("", "te"), "participle": ("ge", "t")}, (T.Rule("oo", "oo", "oe"),), {"gaan": ("ging", "gaat")})
    forms = lambda w: {r["form"]: r["kind"] for r in one(spark, W.all_forms(F.lit(w), table))}
    assert forms("koken") == {"koken": "lemma", "kook": "stem", "koek": "stem", "kookte": "past", "koekte": "past", "gekookt": "participle", "gekoekt": "participle"}
    assert forms("bakken")["bak"] == "stem" and forms("leven")["gelef" + "t"] == "participle"
    assert forms("gaan") == {"gaan": "lemma", "ging": "irregular", "gaat": "irregular"}


def test_scores_reasons_and_strictly_greater_best(spark):
    from lexiforge.functions import scoring as K

    rules = [K.Points("hit", 4, "t", "a"), K.Points("many", -1, "t", "b", each=True), K.Points("bare", 2, "t", "z", absent=True), K.Points("bad", 0, "t", "x")]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "abb"), (2, 1, "zb"), (3, 1, "ax"), (4, 1, None)], "k int, n int, t string")
    rows = K.scored(df, rules, {"t": F.col("t")}, [("high", 6, ("bad",)), ("medium", 4, ())])
    got = {(r["k"], r["n"]): (r["score"], ",".join(r["reasons"]), r["tier"]) for r in rows.collect()}
    assert got == {(1, 1): (6, "hit,bare", "high"), (1, 2): (6, "hit,bare", "high"), (1, 3): (4, "hit,many,bare", "medium"), (2, 1): (-1, "many", "low"), (3, 1): (6, "hit,bare,bad", "medium"), (4, 1): (2, "bare", "low")}
    assert {(r["k"], r["n"]) for r in K.best_scored(rows, ["k"], ["n"]).collect()} == {(1, 1), (3, 1)}


def test_goal_rules_and_table_function(spark):
    from lexiforge.operators import goals as O

    rules = O.GoalRules({"make": "to make", "om": "om", "again": "another"}, {"make": O.GoalRule(after=r"\bto make\b", skip=("a", "the")), "om": O.GoalRule(after=r"\bom\b", before=r"\bte\b"), "again": O.GoalRule(inherits=True)}, r"[,.;]|\bwith\b", 3)
    text = "To make a Good onion soup now, take. Boil.\nAnother with salt. Om de pijn van het hoofd te stillen neemt men. Om niets."
    df = spark.createDataFrame([(1, text), (2, None), (3, "to make. ")], "id int, t string")
    got = O.inherited(O.unit_goals(df, "t", rules, ["id"]), ["id"]).orderBy("id", "ord").collect()
    assert [(r["id"], r["kind"], r["goal"], r["goal_from"]) for r in got] == [(1, "make", "Good onion soup", 0), (1, "again", "Good onion soup", 0), (1, "om", "de pijn van het hoofd", 2), (1, "om", None, None), (3, "make", None, None)]
    O.register_goals(spark, "own_goals", rules)
    assert [r[0] for r in spark.sql("SELECT goal FROM own_goals('To make the best Pie. x')").collect()] == ["best Pie"]


def test_nearest_in_clusters_skips_far_clusters(spark):
    import numpy as np

    r = np.random.default_rng(5)
    spots = r.normal(size=(12, 8)) * 4
    v = np.float32(spots[r.integers(0, 12, 900)] + r.normal(size=(900, 8)) * 0.05)
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in v[i]]) for i in range(900)] + [(2000, 7, [1.0] * 8)], "id long, field long, v array<float>")
    visits: list = []
    asked = rows.select(F.col("id").alias("query"), F.col("id").alias("own"), "field", "v")
    store = lambda df, name: df.cache()
    near = V.nearest_in_clusters(asked, rows, store, 3, pivots=32, block=64, visits=visits)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = set()
    for i in range(900):
        others = [j for j in range(900) if j != i and j % 2 == i % 2]
        want |= {(i, j, n + 1) for n, j in enumerate(sorted(others, key=lambda j: (-scores[i, j], j))[:3])}
    assert {(x["query"], x["id"], x["rank"]) for x in near.collect()} == want
    assert visits[0] < visits[1] / 2  # most (query, cluster) visits are ruled out
    assert V.nearest_in_clusters(asked.limit(0), rows.limit(0), store).count() == 0


def test_queries_of_small_fields_visit_one_cluster(spark):
    """F16: without pivots given, a query is not sent to many clusters of a few rows each."""
    rows = spark.createDataFrame([(i, i % 2, [float(i % 5), float(i % 7), 1.0]) for i in range(200)], "id long, field long, v array<double>")
    visits: list = []
    asked = rows.select(F.col("id").alias("query"), F.col("id").alias("own"), "field", "v")
    near = V.nearest_in_clusters(asked, rows, lambda df, name: df.cache(), visits=visits)
    assert near.count() == 200 and visits == [200, 200]


def test_candidates_with_a_penalty(spark):
    ex = spark.createDataFrame([(1, "f", [1.0, 0.0]), (2, "f", [0.0, 1.0]), (3, "g", [1.0, 1.0])], "id int, field string, v array<double>")
    c = spark.createDataFrame([(1, 0, "f", [1.0, 0.0], False), (1, 1, "f", [0.1, 1.0], True), (1, 2, "f", [0.2, 1.0], False), (2, 0, "f", [0.0, 1.0], False), (2, 1, "f", [0.0, 1.0], False), (3, 0, "g", [1.0, 1.0], False)], "row int, candidate int, field string, v array<double>, part boolean")
    got = {r["row"]: (r["candidate"], r["exemplar"]) for r in V.best_candidates(c, ex, lambda df, n: df.cache(), 0.05).collect()}
    assert got == {1: (2, 2), 2: (0, 1)}


def test_listed_forms_glosses_and_genres(spark):
    assert one(spark, T.listed_forms(F.lit("Af snyden, afsnijden;AF snyden|  | x"))) == ["af snyden", "afsnyden", "afsnijden", "x"]
    assert one(spark, T.listed_forms(F.lit(None).cast("string"))) == []
    assert [tuple(p) for p in one(spark, T.gloss_pairs(F.lit("neemt sop [broth] en 't zap [ juice ] [no]")))] == [("sop", "broth"), ("zap", "juice")]
    by = lambda g: one(spark, T.gloss_class(F.lit(g), {"koken": "heat"}, [(("zout", "azijn"), "keep"), (("ei",), "food")]))
    assert [by(g) for g in ("Koken in zout", "in Azijn leggen", "eieren", "niets", "", None)] == ["heat", "keep", "food", None, None, None]

    rules = T.GenreRules({"ggc": {"poem": "VERSE"}}, "code", (("02", "LAW"), ("01", "BOOK")), "subject", (("FOOD", "(?i)cook"),), (("PERIODICAL", "(?i)courant"),))
    claims = lambda *pairs: F.array(*(F.struct(F.lit(s).alias("scheme"), F.lit(v).alias("value")) for s, v in pairs)) if pairs else F.array().cast("array<struct<scheme:string,value:string>>")
    find = lambda regime, title, *pairs: tuple(one(spark, T.genre(F.lit(regime), claims(*pairs), F.lit(title), rules)))
    assert find("RECIPE", "Courant", ("ggc", "poem")) == ("RECIPE", "regime")
    assert find("UNKNOWN", None, ("ggc", "odd"), ("ggc", "poem"), ("code", "01")) == ("VERSE", "ggc")
    assert find(None, None, ("code", "01"), ("code", "02")) == ("LAW", "code")
    assert find(None, "De Courant", ("subject", "x"), ("subject", "Cookery")) == ("FOOD", "subject")
    assert find(None, "De Courant") == ("PERIODICAL", "title") and find(None, None) == ("UNKNOWN", "none")


def test_review_rows_targets_and_baselines(spark):
    from lexiforge.operators import review as O

    df = spark.createDataFrame([(1, "a", "Salt fish", 5), (2, "b", None, 9), (3, "a", "fish", None)], "id int, k string, t string, n int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(O.review_rows(df)) == [1, 2, 3] and ids(O.review_rows(df, equal={"k": "a"}, contains={"t": "FISH"}, least={"n": 5}, among={"id": None})) == [1]
    assert ids(O.review_rows(df, blank={"t": True})) == [2] and ids(O.review_rows(df, among={"id": [2, 3]}, blank={"n": False})) == [2]
    assert ids(O.accepted(df, spark.createDataFrame([(1, " YES"), (1, "no"), (2, "no"), (3, None)], "id int, v string"), "id", "v")) == [1]

    tokens = spark.createDataFrame([(1, 0, ["formal"]), (1, 1, ["food"]), (1, 2, ["cook"]), (2, 0, ["formal", "store"]), (2, 1, ["cook"]), (3, 0, ["store"]), (3, 1, ["cook"]), (4, 0, ["food"]), (5, 0, [])], "s int, p int, tags array<string>")
    got = {(r["s"], r["p"]): (r["tier"], r["frame"]) for r in O.sentence_targets(tokens, ["s"], "p", "tags", (("food",), ("formal",), ("cook", "store")), ("cook", "store")).collect()}
    assert got == {(1, 1): (0, "cook"), (2, 0): (1, "store"), (3, 0): (2, "store"), (3, 1): (2, "cook"), (4, 0): (0, "NONE")}

    rows = spark.createDataFrame([("x", "x", ["x", "y"]), ("y", "y", ["x"]), ("x", "y", None), (None, "x", ["x"])], "g string, p string, c array<string>")
    r = O.against_baselines(rows, "g", "p", "c").first()
    assert (r["n"], r["accuracy"], r["reachable"], r["first_candidate"], r["chance"], r["majority"], r["lead"]) == pytest.approx((3, 2 / 3, 1 / 3, 1 / 3, 1 / 6, 2 / 3, 0), abs=1e-6)


def test_scores_against_blocks_of_labels(spark):
    import numpy as np

    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 5)]) for i in range(70)]
    named = {f"l{i:02}": [float(x) for x in r.integers(-3, 4, 5)] for i in range(23)}
    df = spark.createDataFrame(rows, "id long, v array<double>")
    labels = spark.createDataFrame(list(named.items()), "name string, c array<double>")
    for top in (None, 3):
        got = {(x["id"], x["label"]): x["score"] for x in V.scores_against(df, "id", "v", labels, "name", "c", top=top, digits=6, block=4).collect()}
        want = {(x["id"], x["label"]): x["score"] for x in V.similarities(df, "id", "v", named, top=top, digits=6).collect()}
        assert got.keys() == want.keys() and len(want) == 70 * (top or 23) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_token_f1_of_long_texts(spark):
    import time
    from collections import Counter

    r = __import__("random").Random(1)
    a, b = ([f"w{r.randint(0, 3000)}" for _ in range(n)] for n in (20_000, 15_000))
    df = spark.createDataFrame([(a, b), ([], []), (["x"], []), (["x", "x", None], ["x", None, None])], "a array<string>, b array<string>")
    began = time.time()
    got = [x[0] for x in df.select(T.token_f1(F.col("a"), F.col("b"))).collect()]
    shared = sum((Counter(a) & Counter(b)).values())
    assert got == pytest.approx([2 * shared / 35_000, 1.0, 0.0, 2 * 2 / 6]) and time.time() - began < 30


def test_shingle_pairs_deals_runs_once_unsorted(spark, small):
    """runs are dealt before they are sorted, so that nothing is sorted (and spilled) on the reading side."""
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("w"))
    plan = J.shingle_pairs(df, "doc_id", "w", 5, 2, 29, 0.3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL") :]
    assert "Sort" not in below and "Window" not in below
    # The runs, the pairs, and no more.
    assert plan.count("Exchange hashpartitioning") == 2
