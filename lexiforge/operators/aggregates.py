"""Counts, crosstabs, association measures, votes and priors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import floor_to, normal, wilson
from .windows import first_of, top_k


def term_counts(tokens: DataFrame, keys: Sequence[str], term: str = "token") -> DataFrame:
    return tokens.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n"))


def single(df: DataFrame, key: str) -> bool:
    """Whether no key is null or stands in two rows: only the keys are read."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


def _found(batch: pa.RecordBatch, words: str, targets: pa.Array, radius: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row and target of each use (once a row), and keys of (row, target, word) for the words beside it, once a row, with the words they number."""
    lists = batch.column(words)
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.fill_null(-1).to_numpy()
    owner = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
    kind = np.append(pa.compute.fill_null(pa.compute.index_in(names, value_set=targets), -1).to_numpy(), -1)[codes]  # no word: the last
    every = np.flatnonzero(kind >= 0)
    uses = np.unique(owner[every] * len(targets) + kind[every])
    many, keys = max(1, len(names)), [np.zeros(0, np.int64)]
    for hits in (every[at : at + piece] for at in range(0, len(every), piece)):
        for step in (o for o in range(-radius, radius + 1) if o):
            own = hits[(hits + step >= 0) & (hits + step < len(codes))]
            own = own[(owner[own + step] == owner[own]) & (codes[own + step] >= 0) & (codes[own + step] != codes[own])]
            keys.append(np.unique((owner[own] * len(targets) + kind[own]) * many + codes[own + step]))
    keys = np.unique(np.concatenate(keys))
    return uses // len(targets), uses % len(targets), keys // many, keys % many, names


def cooccurrence(docs: DataFrame, doc: str, words: str, targets: Sequence[str], radius: int, piece: int = 100_000, once: bool = False) -> DataFrame:
    """(target, collocate, doc) once each: words within radius of any use of a target in a document.

    Uses are looked around a piece at a time. Each row's pairs leave it once;
    once says that no document has two rows, so that they need no further look.
    """
    asked = list(targets)

    def rows(batches):
        for batch in batches:
            _, _, use, word, names = _found(batch, words, pa.array(asked, pa.string()), radius, piece)
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array(use // len(asked))), pa.array(asked, pa.string()).take(pa.array(use % len(asked))), names.take(pa.array(word))], names=[doc, "target", "collocate"])

    found = docs.select(doc, words).mapInArrow(rows, f"{doc} {docs.schema[doc].dataType.simpleString()}, target string, collocate string")
    return found if once else found.distinct()


def collocate_counts(docs: DataFrame, words: str, targets: Sequence[str], radius: int, by: str | None = None, piece: int = 100_000) -> DataFrame:
    """[by], target, collocate, n: rows in which the words stand within radius of each other, to be summed.

    Each Arrow batch is counted by itself, so rows of a pair are summed up
    before they move. The rows that use a target stand beside a null collocate.
    """
    asked = list(targets)
    kind = f"{by} {docs.schema[by].dataType.simpleString()}, " if by else ""

    def count(batches):
        for batch in batches:
            row, target, use, word, names = _found(batch, words, pa.array(asked, pa.string()), radius, piece)
            groups = batch.column(by).dictionary_encode("encode") if by else None
            group = groups.indices.to_numpy() if by else np.zeros(batch.num_rows, np.int64)
            words_and_none = pa.concat_arrays([names, pa.nulls(1, pa.string())])
            key = lambda r, t, w: (group[r].astype(np.int64) * len(asked) + t) * len(words_and_none) + w
            keys, n = np.unique(np.concatenate([key(use // len(asked), use % len(asked), word), key(row, target, len(names))]), return_counts=True)
            left = keys // len(words_and_none)
            columns = [pa.array(asked, pa.string()).take(pa.array(left % len(asked))), words_and_none.take(pa.array(keys % len(words_and_none))), pa.array(n)]
            own = [groups.dictionary.take(pa.array(left // len(asked)))] if by else []
            yield pa.RecordBatch.from_arrays(own + columns, names=([by] if by else []) + ["target", "collocate", "n"])

    return docs.select(words, *([by] if by else [])).mapInArrow(count, f"{kind}target string, collocate string, n long")


def pmi(pairs: DataFrame, rows: DataFrame, doc: str, smoothing: float = 0.5, least: int = 2) -> DataFrame:
    """Smoothed log2 association of pairs (target, collocate), counted over rows (doc, target)."""
    joint = pairs.groupBy("target", "collocate").agg(F.count(F.lit(1)).alias("n_pair"))
    return pmi_of_counts(joint, rows.groupBy("target").agg(F.count(F.lit(1)).alias("n_target")), smoothing, least)


def pmi_of_counts(joint: DataFrame, by_target: DataFrame, smoothing: float = 0.5, least: int = 2) -> DataFrame:
    """As pmi, from n_pair of each pair and n_target of each target."""
    by_collocate = joint.groupBy("collocate").agg(F.sum("n_pair").alias("n_collocate"))
    total = by_target.agg(F.coalesce(F.sum("n_target"), F.lit(0)).alias("n_rows"))
    joined = joint.where(F.col("n_pair") >= least).join(F.broadcast(by_target), "target").join(by_collocate, "collocate").join(F.broadcast(total))  # one row per target; one row
    score = F.log2((F.col("n_pair") + smoothing) * F.col("n_rows") / ((F.col("n_target") + smoothing) * (F.col("n_collocate") + smoothing)))
    return joined.withColumn("pmi", F.round(score, 6))


def log_dice(pair: Column, a: Column, b: Column) -> Column:
    return F.round(14 + F.log2(2 * pair / (a + b)), 6)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with one column per value; 0 where there is none."""
    out = df.groupBy(row).pivot(column, list(values)).count()
    return out.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values))


def crosstab_margins(df: DataFrame, row: str, column: str, every: str = "ALL") -> DataFrame:
    """Counts of the cube with margins named."""
    cubed = df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit(every)).otherwise(F.col(c).cast("string")).alias(c)
    return cubed.select(name(row, "_r"), name(column, "_c"), "n")


def key_plus_all(df: DataFrame, key: str, aggregates: Sequence[Column], every: str = "ALL") -> DataFrame:
    """Aggregates per key and over everything."""
    rolled = df.rollup(key).agg(*aggregates, F.grouping(key).alias("_all"))
    return rolled.withColumn(key, F.when(F.col("_all") == 1, F.lit(every)).otherwise(F.col(key).cast("string"))).drop("_all")


def shares(counts: DataFrame, row: str, n: str, least: int = 1) -> DataFrame:
    """Each cell's share of its row, rows with enough support only."""
    out = counts.withColumn("row_total", F.sum(n).over(W.partitionBy(row)))
    return out.where(F.col("row_total") >= least).withColumn("share", F.round(F.col(n) / F.col("row_total"), 6))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-blank values per column, in one pass."""
    filled = lambda c: F.avg((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int"))
    wide = df.agg(*(F.round(filled(c), 6).alias(c) for c in columns))
    return wide.unpivot([], list(columns), "column_name", "fill_rate")


def majority(votes: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Winning label per key (ties: smallest label), its share and the number of votes."""
    counts = votes.groupBy(*key, label).agg(F.count(F.lit(1)).alias("votes"))
    total = counts.withColumn("n", F.sum("votes").over(W.partitionBy(*key)))
    top = first_of(total, key, [F.desc("votes"), F.asc(label)])
    return top.select(*key, F.col(label).alias("top"), "votes", "n", F.round(F.col("votes") / F.col("n"), 3).alias("agreement"))


def priors(df: DataFrame, key: str, passed: Column, dropped: Column, least: int = 3) -> DataFrame:
    """Per key: rows, pass and drop rates, and whether the key is blocked, unsure or fine."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(passed.cast("int")).alias("passed"), F.sum(dropped.cast("int")).alias("dropped"))
    out = out.withColumn("pass_rate", F.round(F.col("passed") / F.col("n"), 4)).withColumn("drop_rate", F.round(F.col("dropped") / F.col("n"), 4))
    flag = F.when(F.col("n") < least, "few").when(F.col("drop_rate") >= 0.5, "blocked").when((F.col("pass_rate") < 0.7) & (F.col("drop_rate") >= 0.1), "unsure").otherwise("fine")
    return out.withColumn("flag", flag)


def tag_histogram(df: DataFrame, tags: Column, missing: str = "(missing)") -> DataFrame:
    listed = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(missing)))
    return df.select(F.explode(listed).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_union(df: DataFrame, keys: Sequence[str], tags: Column, separator: str = "|") -> DataFrame:
    """Sorted union of the groups' tag sets; each tag of a group is gathered once."""
    single = df.select(*keys, F.explode_outer(tags).alias("_tag")).distinct()
    return single.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_tag")), separator).alias("tags"))


def first_values(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str, separator: str = "|") -> DataFrame:
    """The first k distinct values of each key in order, joined; no key's values are gathered beyond k."""
    few = top_k(df.select(*keys, value).distinct(), keys, [F.asc(value)], k)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias(name))


def weighted_collapse(df: DataFrame, key: str, value: str, weight: str, variant: str) -> DataFrame:
    """Weights summed, weighted mean of the value, sorted distinct variants."""
    return df.groupBy(key).agg(
        F.sum(weight).alias("weight"),
        F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("mean"),
        F.array_join(F.array_sort(F.collect_set(variant)), "|").alias("variants"),
    )


def before_after(df: DataFrame, key: str, after: Column, hit: Column, least: int) -> DataFrame:
    """Share of hits before and after, for keys with enough rows on both sides."""
    count = lambda c: F.sum(c.cast("int"))
    out = df.groupBy(key).agg(count(~after).alias("n_before"), count(after).alias("n_after"), count(~after & hit).alias("hits_before"), count(after & hit).alias("hits_after"))
    out = out.where((F.col("n_before") >= least) & (F.col("n_after") >= least))
    before, later = F.col("hits_before") / F.col("n_before"), F.col("hits_after") / F.col("n_after")
    return out.select(key, "n_before", "n_after", F.round(before, 6).alias("before"), F.round(later, 6).alias("after"), F.round(later - before, 6).alias("shift"))


def stratum_estimate(population: DataFrame, sample: DataFrame, stratum: str, value: str) -> DataFrame:
    """Population totals estimated from a sample: stratum mean times stratum size."""
    sizes = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    means = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return sizes.join(means, stratum).select(stratum, "size", "sampled", F.round(F.col("size") / F.col("sampled"), 6).alias("weight"), F.round(F.col("mean") * F.col("size"), 2).alias("estimate"), F.round("median", 2).alias("median"))


def top_collocates(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["target"], [F.desc("pmi"), F.desc("n_pair"), F.asc("collocate")], k)


def capped_collocates(pairs: DataFrame, counts: DataFrame, total: str, works: DataFrame, work: str, order: Column, cap: int, least: int, k: int) -> DataFrame:
    """target, collocate, n_pair, n_all, log_dice: the k strongest collocates of each target.

    pairs are (doc, target, collocate), works (doc, target, <work>): of each work
    and target at most cap documents count, by a seeded order. counts are the
    collocates' counts over all pairs, `total` its column. Collocates of fewer
    than `least` documents don't count.
    """
    return collocates_of(pairs, counts, total, capped_works(works, work, order, cap), least, k)


def capped_works(works: DataFrame, work: str, order: Column, cap: int) -> DataFrame:
    """(doc, target): of each work and target at most cap documents, by a seeded order."""
    doc = [c for c in works.columns if c not in ("target", work)]
    return top_k(works, [work, "target"], [order, *doc], cap, "_turn").drop("_turn", work)


def collocates_of(pairs: DataFrame, counts: DataFrame, total: str, some: DataFrame, least: int, k: int) -> DataFrame:
    """As capped_collocates, of the documents and targets in some."""
    sizes = some.groupBy("target").agg(F.count(F.lit(1)).alias("n_target"))
    joint = pairs.join(some, some.columns, "left_semi").groupBy("target", "collocate").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= least)
    scored = joint.join(sizes, "target").join(counts, "collocate").withColumn("log_dice", log_dice(F.col("n_pair"), F.col("n_target"), F.col(total)))
    return top_k(scored, ["target"], [F.desc("log_dice"), F.desc("n_pair"), F.asc("collocate")], k).select("target", "collocate", "n_pair", total, "log_dice")


def compounds(vocabulary: DataFrame, form: str) -> DataFrame:
    """form, head, modifier of distinct forms that end in another after a known stem: the longest such head."""
    size = F.length(form)
    cut = vocabulary.where(size >= 5).select(form, F.explode(F.sequence(F.lit(3), size - 2)).alias("n"))
    split = cut.select(form, "n", F.expr(f"right({form}, n)").alias("head"), F.expr(f"left({form}, length({form}) - n)").alias("modifier"))
    known = split.join(vocabulary.select(F.col(form).alias("head")), "head", "left_semi").join(vocabulary.select(F.col(form).alias("modifier")), "modifier", "left_semi")
    return known.groupBy(form).agg(F.max_by(F.struct("head", "modifier"), "n").alias("x")).select(form, "x.head", "x.modifier")


def level_reach(df: DataFrame, key: str, members: str, levels: DataFrame, sets: Sequence[tuple[str, Sequence[str]]], separator: str = ";") -> DataFrame:
    """name, n, reached, unreached, share, low, high: how many keys each set of levels reaches, with Wilson bounds of the share it does not.

    members is a delimited list; levels (member, level) gives a member's level,
    and members without one reach nothing. Sets grow or shrink as they like; a
    key is reached by a set where any of its members has one of its levels.
    """
    named = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda m: F.trim(m)), lambda m: m != ""))
    keys = df.select(key).distinct()
    single = df.select(key, F.explode(named(F.col(members))).alias("member")).distinct().join(levels.select("member", "level"), "member")
    known = [(name, sorted(set(own))) for name, own in sets]
    reached = single.groupBy(key).agg(*(F.bool_or(F.col("level").isin(*own)).alias(f"s{i}") for i, (_, own) in enumerate(known)))
    counts = keys.join(reached, key, "left").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(F.col(f"s{i}"), F.lit(False))).alias(f"s{i}") for i in range(len(known))))
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"s{i}").alias("reached")) for i, (name, _) in enumerate(known)))).alias("x"))
    missed = F.col("n") - F.col("x.reached")
    low, high = wilson(missed, F.col("n"))
    return rows.select("x.name", "n", "x.reached", missed.alias("unreached"), F.when(F.col("n") > 0, F.round(missed / F.col("n"), 6)).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def names_by_span(df: DataFrame, text: str, year: str, work: str, pairs: Sequence[tuple[str, str, str]], span: int = 10) -> DataFrame:
    """concept, since, left, right, works, texts, words: uses of two names of a concept (patterns) per span of years.

    works counts the distinct works that use either name, texts and words all
    texts of the span and their words. A text without a year is left out.
    """
    rows = df.where(F.col(year).isNotNull()).select(F.col(work).alias("_work"), floor_to(F.col(year), span).alias("since"), F.coalesce(text, F.lit("")).alias("_t"))
    whole = rows.groupBy("since").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.regexp_count("_t", F.lit(r"\S+"))).alias("words"))
    uses = F.array(*(F.struct(F.lit(c).alias("concept"), F.regexp_count("_t", F.lit(a)).alias("left"), F.regexp_count("_t", F.lit(b)).alias("right")) for c, a, b in pairs))
    found = rows.select("_work", "since", F.explode(uses).alias("x")).where("x.left + x.right > 0")
    per_work = found.groupBy("since", F.col("x.concept").alias("concept"), "_work").agg(F.sum("x.left").alias("left"), F.sum("x.right").alias("right"))
    summed = per_work.groupBy("since", "concept").agg(F.sum("left").alias("left"), F.sum("right").alias("right"), F.count(F.lit(1)).alias("works"))
    return summed.join(whole, "since").select("concept", "since", "left", "right", "works", "texts", "words")


def pool_overlap(pools: DataFrame, gold: DataFrame, pool: str, term: str, context: str, positive: str, score: str, width: int = 240) -> DataFrame:
    """Per pool: rows, distinct keys, keys that the gold table has as positive and as negative, and the mean score.

    A key is a term and the first `width` characters of its context, both in
    their normal form. gold has term, context and positive (boolean); a key that
    stands there in both ways counts in both.
    """
    key = (normal(F.col(term)).alias("_term"), F.substring(normal(F.col(context)), 1, width).alias("_context"))
    known = gold.select(*key, F.col(positive).alias("_p")).groupBy("_term", "_context").agg(F.bool_or("_p").alias("_yes"), F.bool_or(~F.col("_p")).alias("_no"))
    rows = pools.select(F.col(pool).alias("pool"), *key, F.col(score).alias("_score"))
    per_key = rows.groupBy("pool", "_term", "_context").agg(F.count(F.lit(1)).alias("n"), F.sum("_score").alias("total"), F.count("_score").alias("scored"))
    met = per_key.join(known, ["_term", "_context"], "left").groupBy("pool").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.count_if(F.coalesce("_yes", F.lit(False))).alias("in_positive"), F.count_if(F.coalesce("_no", F.lit(False))).alias("in_negative"), F.sum("total").alias("_t"), F.sum("scored").alias("_s")
    )
    return met.select("pool", "n", "keys", "in_positive", "in_negative", F.round((F.col("in_positive") + F.col("in_negative")) / F.col("keys"), 6).alias("known"), F.round(F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")), 6).alias("mean_score"))
