"""Goals that units state in their headers, and how far the bodies bear them out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .segmentation import _listed, compiled_cues, cue_places, word_places
from .windows import carried

_END = re.compile(r"[.!?]")


@dataclass(frozen=True)
class GoalRule:
    """Where a kind of cue states its goal within the unit's header.

    The goal begins behind the pattern `after` (its last occurrence with
    `last`), or at the header's start; it ends before the pattern `before`,
    which must then be there, or at a stop and after so many words. `skip` lists
    lower-cased words that can't open it. A rule that inherits states no goal of
    its own.
    """

    after: str | None = None
    last: bool = False
    before: str | None = None
    skip: tuple[str, ...] = ()
    inherits: bool = False


@dataclass(frozen=True)
class GoalRules:
    """Cues and rules by kind, the stops (a pattern) that end a goal, its most words, and a header's most characters without a sentence end."""

    cues: dict[str, str]
    rules: dict[str, GoalRule]
    stop: str
    most: int = 5
    reach: int = 160


def goal_place(header: str, rule: GoalRule, stop: re.Pattern, most: int) -> tuple[int, int] | None:
    """Bounds of the goal that a header states, if any."""
    start, end = 0, len(header)
    if rule.after is not None:
        hits = [m.end() for m in re.finditer(rule.after, header, re.I)]
        if not hits:
            return None
        start = hits[-1] if rule.last else hits[0]
    if rule.before is not None:
        closing = re.compile(rule.before, re.I).search(header, start)
        if closing is None:
            return None
        end = closing.start()
    elif (halt := stop.search(header, start)) is not None:
        end = halt.start()
    words = [(start + a, start + b) for a, b in word_places(header[start:end])]
    while words and header[words[0][0] : words[0][1]].lower() in rule.skip:
        words.pop(0)
    if not words:
        return None
    return words[0][0], words[-1 if rule.before is not None else min(most, len(words)) - 1][1]


def goals_of(text: str, rules: GoalRules, cues, stop: re.Pattern) -> Iterator[tuple]:
    """start, end, header_end, kind, inherits, goal, goal_start, goal_end of each unit of a text."""
    found = cue_places(text, cues)
    for (start, cue_end, kind), (end, *_) in zip(found, [*found[1:], (len(text),)]):
        closing = _END.search(text, cue_end, end)
        header_end = closing.end() if closing else min(end, cue_end + rules.reach)
        rule = rules.rules.get(kind, GoalRule())
        place = None if rule.inherits else goal_place(text[start:header_end], rule, stop, rules.most)
        goal = (text[start + place[0] : start + place[1]], start + place[0], start + place[1]) if place else (None, None, None)
        yield start, end, header_end, kind, rule.inherits, *goal


_KINDS = {"start": "int", "end": "int", "header_end": "int", "kind": "string", "inherits": "boolean", "goal": "string", "goal_start": "int", "goal_end": "int"}
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def unit_goals(df: DataFrame, text: str, rules: GoalRules, keep: Sequence[str]) -> DataFrame:
    """keep, ord, the units' bounds and kinds, their goals, and body: the text behind the header."""
    cues, stop = compiled_cues(rules.cues), re.compile(rules.stop, re.I)

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:{k}" for n, k in _KINDS.items()) + ",body:string>>")
    def find(texts: pa.Array) -> pa.Array:
        flat, counts = [], [0]
        for t in texts.to_pylist():
            flat += [(*u, t[u[2] : u[1]]) for u in goals_of(t or "", rules, cues, stop)]
            counts.append(len(flat))
        columns = list(zip(*flat)) if flat else [()] * (len(_KINDS) + 1)
        return _listed(counts, **{n: pa.array(c, _ARROW[k]) for (n, k), c in zip([*_KINDS.items(), ("body", "string")], columns)})

    rows = df.select(*keep, F.posexplode(find(F.col(text))).alias("ord", "u"))
    return rows.select(*keep, "ord", *(f"u.{n}" for n in _KINDS), "u.body")


def inherited(units: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Units with goal_from (ord of the unit whose goal it is): units that inherit take the last goal stated before them."""
    stated = F.when(F.col("goal").isNotNull(), F.struct("goal", "ord"))
    last = carried(units, keep, ["ord"], stated, "_last")
    mine = F.when(F.col("inherits"), F.col("_last")).otherwise(stated)
    return last.withColumn("goal_from", mine["ord"]).withColumn("goal", mine["goal"]).drop("_last")


def register_goals(spark: SparkSession, name: str, rules: GoalRules) -> None:
    """The goals of a text as a table function for SQL: name(text) gives ord and what unit_goals() gives, without the body."""
    cues, stop = compiled_cues(rules.cues), re.compile(rules.stop, re.I)

    class Goals:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, unit in enumerate(goals_of(text or "", rules, cues, stop)):
                yield i, *unit

    spark.udtf.register(name, F.udtf(Goals, returnType="ord int, " + ", ".join(f"`{n}` {k}" for n, k in _KINDS.items())))


def reach(units: DataFrame, by: Sequence[str], head: int = 200, prefix: int = 4) -> DataFrame:
    """Per group: units, those with a goal and those that inherit; whether the goal's first and last word stand in the body.

    first_at_head: within the body's first characters; head_part: a last word
    that is absent, but whose first letters are there. lost is the share of goals
    whose first word is absent, with its Wilson bounds.
    """
    words = F.split(T.normal(F.col("goal")), " ")
    body = T.normal(F.col("body"))
    rows = units.select(*by, "inherits", F.col("goal").isNotNull().alias("g"), F.element_at(words, 1).alias("first"), F.element_at(words, -1).alias("last"), body.alias("b"), T.normal(F.substring("body", 1, head)).alias("h"))
    has = lambda c, where="b": F.coalesce(F.col(where).contains(F.col(c)), F.lit(False))
    part = F.coalesce((F.char_length("last") >= prefix) & F.col("b").contains(F.substring("last", 1, prefix)), F.lit(False))
    g, count = F.col("g"), F.count_if
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"), count("inherits").alias("inherited"), count(g).alias("with_goal"),
        count(g & has("first", "h")).alias("first_at_head"), count(g & has("first") & ~has("first", "h")).alias("first_later"), count(g & ~has("first")).alias("first_absent"),
        count(g & has("last")).alias("last_in_body"), count(g & ~has("last") & part).alias("last_part"), count(g & ~has("last") & ~part).alias("last_absent"),
    )
    return _share(out, F.col("first_absent"), F.col("with_goal"), "lost")


def segmentability(texts: DataFrame, units: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Per group of texts: texts, those with units, the median of their units (lower of two), and the share with units with its Wilson bounds."""
    counted = units.groupBy(key).agg(F.count(F.lit(1)).alias("units"))
    rows = texts.select(key, *by).join(counted, key, "left").groupBy(*by, "units").agg(F.count(F.lit(1)).alias("n"))
    some = F.col("units").isNotNull()
    out = rows.groupBy(*by).agg(F.sum("n").alias("texts"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("with_units"), F.sort_array(F.collect_list(F.when(some, F.struct("units", "n")))).alias("_sizes"))
    # The sizes are as many as there are different numbers of units.
    half = F.floor((F.col("with_units") + 1) / 2)
    running = F.aggregate("_sizes", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("median")), lambda a, s: F.struct((a["seen"] + s["n"]).alias("seen"), F.when(a["median"].isNull() & (a["seen"] + s["n"] >= half), s["units"]).otherwise(a["median"]).alias("median")))
    return _share(out.select(*by, "texts", "with_units", running["median"].alias("median_units")), F.col("with_units"), F.col("texts"), "rate")


def _share(df: DataFrame, hits: Column, n: Column, name: str) -> DataFrame:
    low, high = T.wilson(hits, n)
    return df.withColumn(name, F.when(n > 0, F.round(hits / n, 6))).withColumn(f"{name}_low", F.round(low, 6)).withColumn(f"{name}_high", F.round(high, 6))
