"""Queries and operators on rows that the driver's small tables lack."""

import duckdb
import pytest
from compare import same

from lexiforge import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def fractions(tmp_path_factory):
    """Events whose distances lie at the edge of the band when fractions of a second are cut, and beyond it (or the reverse) when they are rounded."""
    where = str(tmp_path_factory.mktemp("fractions"))
    duckdb.sql(f"""COPY (SELECT CAST(row_number() OVER () AS BIGINT) AS event_id, TIMESTAMP '2024-01-02 00:00:00' + to_microseconds(CAST(us AS BIGINT)) AS ts, CAST(u AS BIGINT) AS user_id, kind AS event_type, 1.5 AS value, '' AS props
        FROM (VALUES (0.2e6, 1, 'purchase'), (43200.7e6, 1, 'click'), (0.7e6, 2, 'purchase'), (43201.2e6, 2, 'click'), (0.5e6, 3, 'purchase'), (43200.5e6, 3, 'click'), (1.5e6, 4, 'purchase'), (43202.5e6, 4, 'click'),
        (0.2e6, 5, 'signup'), (43200.7e6, 5, 'purchase'), (0.7e6, 6, 'signup'), (43201.2e6, 6, 'purchase'), (86400.4e6, 6, 'click'), (86400.9e6, 6, 'click'), (0.2e6, 8, 'signup'), (43200.7e6, 8, 'purchase'), (0.2e6, 7, 'signup'), (86399.9e6, 7, 'click'), (-0.4e6, 7, 'click')) AS v(us, u, kind)) TO '{where}/events.parquet'""")
    return where


@pytest.mark.parametrize("name", ["band_pairs", "boundary_score", "interval_contains", "neighbour_vote"])
def test_fractions_of_seconds_round_as_in_sql(spark, fractions, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{fractions}/events.parquet'")
    same(QUERIES[name](spark, fractions), con, ORACLES[name])


def test_walks_hand_on_rows_as_they_come(spark, monkeypatch):
    """A worker that is given many texts at once never holds the rows of them all."""
    from lexiforge.operators import segmentation as G

    monkeypatch.setattr(G, "FLUSH", 7)
    held = []

    class Frame:
        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def mapInArrow(self, walk, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pylist([{"id": i, "_text": text} for i, text in enumerate(texts)], pa.schema([("id", pa.int64()), ("_text", pa.string())]))
            held.extend(out.num_rows for out in walk(iter([batch])))
            return self.df.mapInArrow(walk, schema)

    texts = ["<h1>one und</h1><p>the way with the one und und die</p>" * 9, None, "the und"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1)
    plain = lambda f: [(i, *r) for i, t in enumerate(texts) for r in f(t or "")]
    select = type(df).select
    monkeypatch.setattr(type(df), "select", lambda self, *c: Frame(select(self, *c)) if c and "_text" in str(c[-1]) else select(self, *c))
    got = G.candidates(df, "text", ["id"]).collect()
    monkeypatch.undo()
    want = plain(lambda t: [(k, a, b, t[a:b], x) for k, (a, b, x) in enumerate(G.candidate_places(t, 6, 7, range(4, 11)))])
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000 and max(held) <= 7 and sum(held) == len(want)


def test_only_hits_of_a_small_lexicon_leave_the_walk(spark):
    from lexiforge.operators import segmentation as G

    text = "With the und, the und's was thes"
    known = frozenset(["und", "with the", "the"])
    every = list(G.trigger_candidates(text, 3, ("s",), frozenset(["was"])))
    assert list(G.trigger_candidates(text, 3, ("s",), frozenset(["was"]), known)) == [r for r in every if r[4] in known] != every


def test_equal_contexts_are_asked_once(spark, monkeypatch):
    """Copies of a context on either side meet as one, and a needle meets only contexts of its own term."""
    from lexiforge.operators import localise as O

    sizes = []
    plain = O.contains_join

    def counted(texts, needles, *more, **named):
        sizes.append((texts.count(), needles.count(), named.get("within")))
        return plain(texts, needles, *more, **named)

    monkeypatch.setattr(O, "contains_join", counted)
    head = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    left = spark.createDataFrame([(i, "t", "before " + head) for i in range(30)] + [(90, "u", "before " + head), (91, "t", "a b"), (92, "v", "x")], "id int, term string, context string")
    right = spark.createDataFrame([(100 + i, "t", head, i) for i in range(20)] + [(200, "t", "z a b z", 9), (201, "v", "y x", 3), (202, "v", "yx", 2)], "id int, term string, context string, place int")
    got = {r["id"]: (r["other"], r["tier"]) for r in O.matched_contexts(left, right, "id", "term", "context", "place").collect()}
    assert got == {i: (100, 3) for i in range(30)} | {90: (None, None), 91: (200, 3), 92: (202, 3)}
    assert sizes == [(4, 4, ("_term", "_t")), (4, 4, ("_term", "_t"))]


def test_equal_names_are_asked_once(spark, tmp_path, monkeypatch):
    from lexiforge.operators import joins as J

    duckdb.sql(f"COPY (SELECT i AS p_partkey, ['blue gear', 'Blue Gear', 'ring', NULL, 'red ring x'][1 + i % 5] AS p_name, CAST(i % 7 AS INTEGER) AS p_size FROM range(100) r(i)) TO '{tmp_path}/part.parquet'")
    seen, plain = [], J.contains_join
    monkeypatch.setattr(J, "contains_join", lambda texts, *more, **named: seen.append(texts.count()) or plain(texts, *more, **named))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    same(QUERIES["exact_else_contains"](spark, str(tmp_path)), con, ORACLES["exact_else_contains"])
    assert seen and seen[0] <= 5


def test_agreement_takes_each_row_once(spark, capsys):
    from pyspark.sql import functions as F

    from lexiforge.operators import merge as M

    rows = [(1, 7, "A", "x", 9), (1, 8, "A", "x", 9), (2, 7, "A", "x", 9), (2, 7, "A", "x", 9), (3, 7, "A", "x", 9), (3, 8, "B", "x", 9), (4, 7, "A", "x", 9), (4, 9, "A", "y", 9), (4, 5, "B", "z", 1), (5, 7, None, "x", 9), (5, 8, None, "x", 9), (6, 7, "A", None, 9), (6, 8, None, None, 9), (6, None, "A", None, 9)]
    got = M.promoted(spark.createDataFrame(rows, "k int, who_ int, l string, f string, q int"), "k", "who_", "l", F.col("q") < 5, ["f"])
    assert sorted(map(tuple, got.collect())) == [(1, "A", "x", "7+8"), (4, "A", "", "7+9"), (6, "A", "", "7+8")]
    got.explain()
    assert "Expand" not in capsys.readouterr().out


def test_needles_meet_the_texts_that_hold_them(monkeypatch):
    """every needle is found in each text that holds it, across pieces too; a text makes rows for needles only, and needles that begin alike stay apart."""
    import random

    import numpy as np
    import pyarrow as pa

    from lexiforge.operators import joins as J

    monkeypatch.setattr(J, "PIECE", 400)
    r = random.Random(5)
    texts = ["".join(r.choice("aaab é€") for _ in range(r.choice((0, 3, 30, 300, 900)))) for _ in range(60)] + [""]
    needles = [t[a : a + n] for t in texts for n in (1, 2, 3, 4, 5, 9, 10, 19, 20, 40, 79, 80, 200, 640, 700) for a in (r.randrange(len(t) + 1),) if t[a : a + n]]
    zeros = lambda x: pa.array([7] * len(x), pa.int64())
    kinds, grams = J.needle_grams(pa.array(needles), zeros(needles))
    bits = {k: np.zeros(1 << J.BITS - 3, np.uint8) for k in set(kinds.tolist())}
    for k, g in zip(kinds.tolist(), grams.tolist()):
        at = g & (1 << J.BITS) - 1
        bits[k][at >> 3] |= 1 << (at & 7)
    got = {(int(row), int(g)) for rows, hashes in J.text_grams(pa.array(["-", *texts]).slice(1), zeros(texts), bits) for row, g in zip(rows, hashes)}
    assert {(i, int(g)) for i, t in enumerate(texts) for n, g in zip(needles, grams) if n in t} <= got
    none = {k: np.zeros(1 << J.BITS - 3, np.uint8) for k in J.STRETCHES}
    assert not list(J.text_grams(pa.array(texts), zeros(texts), none))
    alike = ["x" * 70 + str(i) for i in range(10_000_000_000, 10_000_000_500)]
    assert len(set(J.needle_grams(pa.array(alike), zeros(alike))[1].tolist())) == 500


def test_contexts_do_not_go_whole_to_the_driver(spark):
    """no side of the lookup is broadcast by a guessed size: both are dealt by hash."""
    from lexiforge.operators import joins as J

    texts = spark.createDataFrame([(i, "t", f"one two {i} three four") for i in range(50)], "id int, term string, text string")
    needles = spark.createDataFrame([(f"{i} three", "t") for i in range(50)], "needle string, t string")
    found = J.contains_join(texts, needles, "id", "text", "needle", within=("term", "t"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert {tuple(r) for r in found.select("id", "needle").collect()} == {(i, f"{j} three") for i in range(50) for j in range(50) if f"{j} three" in f"one two {i} three four"}
