"""Finding where a quoted context stands: in its text, and in another table of contexts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import contains_join

#: Contexts that are looked up in a text at once.
CHUNK = 2048
#: So many windows of one width are searched for one by one, more by hashes of the text.
FEW = 8
#: An odd number and its inverse modulo 2^64, for hashes of windows.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """One hash for each stretch of `width` code points."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    power = np.concatenate([np.ones(1, np.uint64), np.full(len(points) - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    n = len(points) - width + 1
    back = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK, np.uint64)]).cumprod(dtype=np.uint64)
    return (upto[width : width + n] - upto[:n]) * back


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def unique_places(text: str, windows: Sequence[str]) -> list[int | None]:
    """The place of each window that stands exactly once in a text, else None.

    Few windows are searched for. For more, all stretches of the text are hashed
    once for each width there is; those that agree with a window's hash are
    compared with it and counted.
    """
    out: list[int | None] = [None] * len(windows)
    points = None
    for width in sorted({len(w) for w in windows} - {0}):
        asked = [i for i, w in enumerate(windows) if len(w) == width]
        if len(asked) <= FEW:
            for i in asked:
                first = text.find(windows[i])
                if first >= 0 and text.find(windows[i], first + 1) < 0:
                    out[i] = first
            continue
        points = _points(text) if points is None else points
        wanted = np.array([_window_hashes(_points(windows[i]), width)[0] for i in asked])
        kinds, kind = np.unique(wanted, return_inverse=True)
        hashes = _window_hashes(points, width)
        at = np.minimum(np.searchsorted(kinds, hashes), len(kinds) - 1)
        places: dict[int, list[int]] = {}
        for place in np.flatnonzero(kinds[at] == hashes).tolist():
            places.setdefault(int(at[place]), []).append(place)
        for i, k in zip(asked, kind.tolist()):
            true = [p for p in places.get(k, ()) if text[p : p + width] == windows[i]]
            if len(true) == 1:
                out[i] = true[0]
    return out


def place_contexts(text: str, asked: Sequence[tuple[str, str]], widths: Sequence[int], shortest: int) -> list[tuple[int | None, str | None]]:
    """For each (context, target) where the target stands in the text, and how that was found."""
    out: list[tuple[int | None, str | None]] = []
    offsets = [context.find(target) for context, target in asked]
    for (context, _), offset in zip(asked, offsets):
        found = text.find(context)
        out.append((found + max(offset, 0), "exact") if found >= 0 else (None, None))
    for width in widths:
        open_ = [i for i, (place, _) in enumerate(out) if place is None and offsets[i] >= 0]
        cut = [max(0, offsets[i] - width // 2) for i in open_]
        windows = [asked[i][0][a : a + width] for i, a in zip(open_, cut)]
        windows = [w if len(w) >= shortest else "" for w in windows]
        for i, a, place in zip(open_, cut, unique_places(text, windows)):
            if place is not None:
                out[i] = (place + offsets[i] - a, str(width))
    return out


def localised(contexts: DataFrame, texts: DataFrame, on: str, context: str, target: str, text: str, widths: Sequence[int] = (60, 40, 25), shortest: int = 15) -> DataFrame:
    """contexts with place (from 0) and found: where the target of a context stands in the text of the same key.

    The whole context counts first (its first place); then, from the longest
    width down, the stretch around the target's first place in the context, where
    it stands exactly once in the text. `found` is "exact" or the width; both are
    null where nothing is accepted. Texts have one row per key and, like
    contexts, are in a normal form already. A text meets its contexts in chunks,
    so many contexts of one text are many tasks.
    """
    key = F.col(on)
    rows = contexts.where(key.isNotNull()).select(key.alias("_key"), F.struct(*(F.col(f"`{c}`") for c in contexts.columns)).alias("_row"), F.coalesce(context, F.lit("")).alias("_context"), F.coalesce(target, F.lit("")).alias("_target"))
    many = rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"))
    asked = rows.join(many, "_key").withColumn("_chunk", F.pmod(F.xxhash64("_context", "_target"), F.col("_chunks"))).drop("_chunks")
    given = texts.select(F.col(on).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).join(many, "_key")
    given = given.select("_key", "_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))

    kind = asked.schema["_row"].dataType.simpleString()
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    asked = asked.select("_key", "_chunk", F.struct("_row", "_context", "_target").alias("_ask"))
    both = asked.select("_key", "_chunk", "_ask", none(given, "_text")).unionAll(given.select("_key", "_chunk", none(asked, "_ask"), "_text"))
    met = both.groupBy("_key", "_chunk").agg(F.collect_list("_ask").alias("_asks"), F.max("_text").alias("_text"), F.count("_text").alias("_texts"))
    several = F.raise_error(F.concat(F.lit("several texts of key "), F.col("_key").cast("string")))
    met = met.select("_asks", F.when(F.col("_texts") > 1, several.cast("string")).otherwise(F.col("_text")).alias("_text"))

    def place(batches):
        for batch in batches:
            lists = batch.column("_asks")
            asks = lists.flatten()
            rows, context, target = asks.flatten()
            pairs, found, at = list(zip(context.to_pylist(), target.to_pylist())), [], 0
            for text, many in zip(batch.column("_text").to_pylist(), pa.compute.list_value_length(lists).to_pylist()):
                own = pairs[at : at + many]
                found += place_contexts(text, own, widths, shortest) if text is not None else [(None, None)] * many
                at += many
            yield pa.RecordBatch.from_arrays([rows, pa.array([p for p, _ in found], pa.int32()), pa.array([f for _, f in found], pa.string())], names=["_row", "place", "found"])

    found = met.mapInArrow(place, f"_row {kind}, place int, found string")
    lost = contexts.where(key.isNull()).select(*contexts.columns, F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("found"))
    return found.select("_row.*", "place", "found").unionAll(lost)


def context_key(text: Column, width: int = 120) -> Column:
    """The first characters of a text in lower case with single blanks."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, width)


def matched_contexts(left: DataFrame, right: DataFrame, id_col: str, term: str, context: str, order: str, width: int = 120, head: int = 80, kept: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """left with other (an id of right) and tier: the same id; else equal term and context key; else equal
    term and one context that holds the first `head` characters of the other.

    Of several rows of right in one tier the first in `order` counts; a row
    without a match has nulls. Ids of left are unique. A blank context matches
    no other, and a null term none. Containment is asked once for all equal
    contexts of a term. kept stores rows that are read several times.
    """
    others = kept(right.select(F.col(id_col).alias("other"), F.col(term).alias("_term"), F.col(context).alias("_context"), F.col(order).alias("_order")), "others")
    first = lambda df, keys: df.groupBy(*keys).agg(F.min_by("other", "_order").alias("other"))
    rows = kept(left.select(F.col(id_col).alias("_id"), F.col(term).alias("_term"), F.col(context).alias("_context")), "rows")

    same = first(others.withColumn("_id", F.col("other")), ["_id"]).select("_id", "other", F.lit(1).alias("tier"))
    by_id = rows.join(same, "_id", "left")
    keyed = lambda df: df.where(F.trim("_context") != "").withColumn("_key", context_key(F.col("_context"), width))
    by_key = keyed(by_id.where("tier is null").drop("other", "tier")).join(first(keyed(others), ["_term", "_key"]), ["_term", "_key"]).select("_id", "other", F.lit(2).alias("tier"))
    decided = by_id.where("tier is not null").select("_id", "other", "tier").unionAll(by_key)

    rest = kept(rows.join(decided.select("_id"), "_id", "left_anti"), "rest")
    begins = lambda c: F.when(F.trim(c) != "", F.substring(c, 1, head))
    best = lambda df, keys: df.groupBy(*keys).agg(F.min_by("other", "_order").alias("other"), F.min("_order").alias("_order"))
    met = lambda texts, needles, id_: contains_join(texts, needles, id_, "_context", "_needle_text", within=("_term", "_t")).where("_term = _t")
    needles = best(others.select("other", "_order", F.col("_term").alias("_t"), begins("_context").alias("_needle_text")), ["_t", "_needle_text"])
    texts = rest.groupBy("_term", "_context").agg(F.min("_id").alias("_id"))
    held = rest.join(best(met(texts, needles, "_id"), ["_term", "_context"]), ["_term", "_context"]).select("_id", "other", "_order")
    asked = rest.select("_id", F.col("_term").alias("_t"), begins("_context").alias("_needle_text"))
    found = best(met(best(others, ["_term", "_context"]), asked.select("_t", "_needle_text").distinct(), "other"), ["_t", "_needle_text"])
    holding = asked.join(found, ["_t", "_needle_text"]).select("_id", "other", "_order")
    either = held.unionAll(holding).groupBy("_id").agg(F.min_by("other", "_order").alias("other")).select("_id", "other", F.lit(3).alias("tier"))
    return left.join(decided.unionAll(either).withColumnRenamed("_id", id_col), id_col, "left")
