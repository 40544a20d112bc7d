"""Embeddings as array columns: norms, centroids, retrieval by similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_of, top_k

EPS = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length (at least EPS)."""
    size = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x.cast("double") / size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label."""
    flat = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def mean_pool(df: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key, n, pooled: the mean of a key's vectors where the mask holds; zeros where it holds for none."""
    flat = df.select(key, F.col(mask).cast("boolean").alias("_m"), F.posexplode(vector).alias("i", "x")).groupBy(key, "i")
    kept = F.col("_m")
    means = flat.agg(F.coalesce(F.avg(F.when(kept, F.col("x").cast("double"))), F.lit(0.0)).alias("x"), F.count(F.when(kept, 1)).alias("n"))
    return means.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("pooled"))


def similarities(df: DataFrame, id_col: str, vector: str, against: dict, name: str = "label", top: int | None = None, digits: int = 9) -> DataFrame:
    """Cosine of every row with each of some named vectors (a bounded parameter), by matrix products per Arrow batch.

    With top only a row's best that many leave the batch; scores equal to so many digits go by the order of names.
    """
    names = sorted(against)
    matrix = np.array([against[k] for k in names], dtype=np.float64).reshape(len(names), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), EPS)
    kept = df.sparkSession.sparkContext.broadcast((names, matrix))

    def score(batches):
        labels, m = kept.value
        for batch in batches:
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, m.shape[1]))
            sims = (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), EPS)) @ m.T
            if top is None:
                which = np.broadcast_to(np.arange(len(labels)), sims.shape)
            else:
                which = np.argsort(-np.round(sims, digits), axis=1, kind="stable")[:, :top]
                sims = np.take_along_axis(sims, which, 1)
            rows = np.repeat(np.arange(batch.num_rows), which.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array(labels).take(pa.array(which.ravel())), pa.array(sims.ravel())], names=[id_col, name, "score"])

    kind = "string" if names and isinstance(names[0], str) else "long"
    return df.select(id_col, vector).mapInArrow(score, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {name} {kind}, score double")


def retrieve(scored: DataFrame, id_col: str, none_label, margin: float, k: int) -> DataFrame:
    """Per label the k best rows whose score beats the row's NONE score by a margin.

    A label with fewer than k / 4 such rows falls back on its best by (score - none).
    """
    none = scored.where(F.col("label") == none_label).select(id_col, F.col("score").alias("none_score"))
    rows = scored.where(F.col("label") != none_label).join(none, id_col).withColumn("gap", F.col("score") - F.col("none_score"))
    rows = rows.withColumn("passed", F.col("gap") >= margin)
    starved = rows.groupBy("label").agg((F.sum(F.col("passed").cast("int")) < k / 4).alias("starved"))
    open_rows = rows.join(F.broadcast(starved), "label").where("passed or starved")  # one row per label
    return top_k(open_rows, ["label"], [F.desc("passed"), F.desc("gap"), F.asc(id_col)], k)


def collected(df: DataFrame, id_col: str, vector: str, most: int = 10_000) -> dict:
    """A small set of named vectors on the driver; more than `most` are refused: scores_against() takes any number."""
    rows = df.select(id_col, vector).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} vectors")
    return {r[0]: list(r[1]) for r in sorted(rows, key=lambda r: r[0])}


def scores_against(df: DataFrame, id_col: str, vector: str, labels: DataFrame, label: str, centre: str, name: str = "label", top: int | None = None, digits: int = 9, block: int = 1024) -> DataFrame:
    """As similarities(), against a table of named vectors of any size: rows meet blocks of labels in products.

    With top, a row's best that many labels are merged over the blocks (equal rounded scores by label).
    """
    kinds = df.schema[id_col].dataType.simpleString(), labels.schema[label].dataType.simpleString()
    count = labels.count()
    blocks = max(1, -(-count // block))
    parts = max(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).alias("_id"), F.lit(None).cast(kinds[1]).alias("_label"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    named = labels.select(F.lit(None).cast(kinds[0]).alias("_id"), F.col(label).alias("_label"), F.col(centre).cast("array<double>").alias("_v"))
    named = named.withColumn("_block", F.pmod(F.xxhash64("_label"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def score(cell: pa.Table) -> pa.Table:
        asks = cell.column("_label").is_null()
        q, o = cell.filter(asks), cell.filter(pa.compute.invert(asks)).sort_by("_label")
        if not q.num_rows or not o.num_rows:
            return pa.table({id_col: q.column("_id").slice(0, 0), name: o.column("_label").slice(0, 0), "score": pa.array([], pa.float64())})
        side = lambda t: _unit_rows(t.combine_chunks().to_batches()[0], "_v")
        sims = side(q) @ side(o).T
        which = np.broadcast_to(np.arange(o.num_rows), sims.shape) if top is None else np.argsort(-np.round(sims, digits), axis=1, kind="stable")[:, :top]
        rows = np.repeat(np.arange(q.num_rows), which.shape[1])
        return pa.table({id_col: q.column("_id").take(pa.array(rows)), name: o.column("_label").take(pa.array(which.ravel())), "score": np.take_along_axis(sims, which, 1).ravel()})

    found = rows.select("_part", "_block", "_id", "_label", "_v").unionAll(named.select("_part", "_block", "_id", "_label", "_v")).groupBy("_part", "_block").applyInArrow(score, f"{id_col} {kinds[0]}, {name} {kinds[1]}, score double")
    if top is None or blocks == 1:
        return found
    return top_k(found, [id_col], [F.desc(F.round("score", digits)), F.asc(name)], top, "_place").drop("_place")


def most_similar(queries: DataFrame, others: DataFrame, id_col: str, vector: str, k: int, digits: int, field: str | None = None, block: int = 1024) -> DataFrame:
    """query, id_col, score, rank: for every query its k most similar others with another id (and the same field).

    Both sides are dealt to blocks by a hash of the id, every two blocks of a
    field are one task with one matrix product, and their best are merged; no
    set of vectors comes to the driver. Equal rounded scores go by id.
    """
    kind = others.schema[id_col].dataType.simpleString()
    side = lambda df: df.select((F.col(field) if field else F.lit(0)).alias("_field"), F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    blocks = lambda df, name: df.groupBy("_field").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    left, right = side(queries), side(others)
    sizes = blocks(left, "_left").join(blocks(right, "_right"), "_field")
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = left.join(sizes, "_field").select("_field", own("_left").alias("_i"), every("_right").alias("_j"), F.lit(True).alias("_asks"), "_id", "_v")
    given = right.join(sizes, "_field").select("_field", every("_left").alias("_i"), own("_right").alias("_j"), F.lit(False).alias("_asks"), "_id", "_v")

    def best(pair: pa.Table) -> pa.Table:
        asks, ids = pair.column("_asks").to_numpy(), pair.column("_id").to_numpy()
        flat = pair.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), EPS)
        q, o = np.flatnonzero(asks), np.flatnonzero(~asks)
        o = o[np.argsort(ids[o], kind="stable")]  # the first of equal scores has the smallest id
        scores = np.round(flat[q] @ flat[o].T, digits)
        scores[ids[q][:, None] == ids[o][None, :]] = -np.inf
        if k == 1 and len(o):
            top = scores.argmax(1)[:, None]
        else:
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows, value = np.repeat(q, top.shape[1]), np.take_along_axis(scores, top, 1).ravel()
        good = np.isfinite(value)
        return pa.table({"query": ids[rows[good]], id_col: ids[o[top.ravel()[good]]], "score": value[good]})

    found = asked.unionAll(given).groupBy("_field", "_i", "_j").applyInArrow(best, f"query {kind}, {id_col} {kind}, score double")
    return top_k(found, ["query"], [F.desc("score"), F.asc(id_col)], k)


def nearest_exemplar(df: DataFrame, id_col: str, vector: str, exemplars: DataFrame, field: str | None = None) -> DataFrame:
    """For every row its most similar exemplar other than itself (and of its field)."""
    found = most_similar(df, exemplars, id_col, vector, 1, 6, field)
    return found.select(F.col("query").alias("_row"), F.col(id_col).alias("exemplar"), "score").withColumnRenamed("_row", id_col)


def hybrid(scored: DataFrame, id_col: str, anchored: DataFrame, margin: float, quota: int) -> DataFrame:
    """Per label up to quota rows: anchored ones that pass the margin, then others that pass, then the deferred rest.

    scored has id, label, gap; each row stands for its best label only. anchored
    has the ids with a literal hit.
    """
    best = first_of(scored, [id_col], [F.desc("gap"), F.asc("label")])
    known = best.join(anchored.select(id_col, F.lit(True).alias("anchored")).distinct(), id_col, "left")
    tier = F.when((F.col("gap") >= margin) & F.col("anchored"), 0).when(F.col("gap") >= margin, 1).otherwise(2)
    return top_k(known.withColumn("tier", tier), ["label"], [F.asc("tier"), F.desc("gap"), F.asc(id_col)], quota)


def hybrid_limited(ranked: DataFrame, id_col: str, key: str, limit: int, labels: int) -> tuple[DataFrame, DataFrame]:
    """Anchored and other rows of a ranking, each at most limit.

    ranked has id_col, label, score and key, which is null where a row holds no
    anchor. Anchored rows are taken in the order of their scores, one per key,
    and of each label at most its share of the limit; then those put off by
    their label's share fill what is left. Others are the best by score. The
    order decides one row at a time, but only over the first rows of each label:
    a label can lose at most `limit` keys to others, so twice that many suffice.
    """
    share = max(1, limit // max(1, labels))
    order = [F.desc("score"), F.asc(id_col)]
    first = first_of(ranked.where(F.col(key).isNotNull()), ["label", key], order)
    few = top_k(first, ["label"], order, 2 * limit, "_place").drop("_place")

    def choose(rows):
        rows = rows.drop(columns="_all").sort_values(["score", id_col], ascending=[False, True])
        seen, count, kept, later = set(), {}, [], []
        for turn, part in ((1, rows.itertuples()), (2, later)):
            for row in part:
                label, name = row.label, getattr(row, key)
                if name in seen or len(kept) >= limit:
                    continue
                if turn == 1 and count.get(label, 0) >= share:
                    later.append(row)
                    continue
                seen.add(name)
                count[label] = count.get(label, 0) + 1
                kept.append((row.Index, turn))
        out = rows.loc[[i for i, _ in kept]]
        return out.assign(turn=[t for _, t in kept])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema.fields) + ", turn int"
    anchored = few.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, kinds)  # at most labels * 2 * limit rows
    return anchored, ranked.where(F.col(key).isNull()).orderBy(*order).limit(limit)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a padded lower-cased text: a stand-in for an encoder."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3))))


def _near_spans(value: str, words: list[str], least: int, most: int, threshold: float) -> list[tuple[int, int]]:
    """(place, length) of the runs of words whose trigrams can reach the threshold against the value's.

    All but the trigrams over a blank lie in one padded word, so the words' own
    hits and one for each blank are as many as a run can have in common.
    """
    cut = lambda text: {text[i : i + 3] for i in range(max(1, len(text) - 2))}
    wanted = cut(f" {value} ")
    hits = {w: sum(f" {w} "[i : i + 3] in wanted for i in range(len(w))) for w in set(words)}
    upto = [0]
    for w in words:
        upto.append(upto[-1] + hits[w])
    out = []
    for size in range(least, min(most, len(words)) + 1):
        for at in range(len(words) - size + 1):
            if upto[at + size] - upto[at] + size - 1 >= threshold * threshold * len(wanted):
                own = cut(f" {' '.join(words[at : at + size])} ")
                if len(wanted & own) >= threshold * (len(wanted) * len(own)) ** 0.5:
                    out.append((at, size))
    return out


def ground_by_span(df: DataFrame, id_col: str, value: str, context: str, threshold: float, more: int = 1) -> DataFrame:
    """id_col, value, grounded, replaced: a value that its context holds stays; else the most similar
    run of words (of up to `more` words more or less) takes its place where it reaches the threshold.

    Similarity is the cosine of trigram sets; the leftmost of equal runs wins. A blank value is grounded.
    """
    held = (F.trim(value) == "") | F.lower(context).contains(F.lower(F.trim(value)))
    rows = df.select(id_col, F.col(value).alias("_v"), F.col(context).alias("_c"), F.coalesce(held, F.col(value).isNull()).alias("_held"))
    words = F.filter(F.split(F.coalesce("_c", F.lit("")), r"\s+"), lambda w: w != "")
    open_rows = rows.where(~F.col("_held")).withColumn("_w", words).withColumn("_n", F.size(F.split(F.trim("_v"), r"\s+")))
    asked = open_rows.select(id_col, "_v", "_w", F.lower("_v").alias("_low"), F.transform("_w", F.lower).alias("_lows"), "_n")

    def near(batches):
        for batch in batches:
            values, words, sizes = (batch.column(c).to_pylist() for c in ("_low", "_lows", "_n"))
            found = [_near_spans(v, w, max(1, n - more), n + more, threshold - 1e-6) for v, w, n in zip(values, words, sizes)]  # scores are rounded
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            place = [pa.array([x[i] for f in found for x in f], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(row), batch.column("_v").take(row), pa.array([" ".join(w[at : at + k]) for w, f in zip(batch.column("_w").to_pylist(), found) for at, k in f], pa.string()), *place], names=[id_col, "_v", "_span", "_at", "_k"])

    # Runs below the threshold replace nothing, whichever is the best of them.
    spans = asked.mapInArrow(near, f"{id_col} {df.schema[id_col].dataType.simpleString()}, _v string, _span string, _at int, _k int")
    a, b = trigrams(F.col("_v")), trigrams(F.col("_span"))
    score = F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)), 6)
    best = spans.groupBy(id_col).agg(F.min_by(F.struct("_span", score.alias("_score")), F.struct(-score, "_at", "_k")).alias("_b"))
    found = rows.join(best, id_col, "left")
    good = F.coalesce(F.col("_b._score") >= threshold, F.lit(False)) & ~F.col("_held")
    return found.select(id_col, F.when(good, F.col("_b._span")).otherwise(F.col("_v")).alias(value), (F.col("_held") | good).alias("grounded"), good.alias("replaced"))


def _unit_rows(batch: pa.RecordBatch, vector: str) -> np.ndarray:
    flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), EPS)


#: Others of a block for each query of one, in searches by clusters.
WIDE = 8
#: Added to bounds of distances, for rounding.
SLACK = 1e-6


def nearest_in_clusters(queries: DataFrame, others: DataFrame, store, k: int = 1, digits: int = 6, pivots: int | None = None, block: int = 1024, visits: list | None = None) -> DataFrame:
    """query, id, score, rank: for every query its k most similar others of its field, exactly, without meeting all of them.

    queries has query, own, field, v and others id, field, v; a query doesn't
    find the other whose id is its own. Others are dealt to clusters by the
    nearest of a bounded number of pivots (drawn by hash over all fields), and
    each cluster of a field keeps its radius. A query first searches its nearest
    cluster; another one is searched only where the distance of its pivot less
    its radius does not exceed the distance of the k-th best found so far (the
    triangle inequality on unit vectors), which loses nothing. Both rounds are
    products of blocks, of `block` queries and WIDE times as many others: a query
    is sent to each block of each cluster that it visits, so unless pivots are
    given there are so many (64 at most) that a cluster of a field fills a block
    of others on average. store(df, name) writes a table and gives it back; visits,
    where given, receives the numbers of (query, cluster) visits made and possible.
    """
    spark = others.sparkSession
    if pivots is None:
        many, fields = others.agg(F.count(F.lit(1)), F.count_distinct("field")).first()
        pivots = max(1, min(64, many // (max(1, fields) * WIDE * block)))
    drawn = others.orderBy(F.xxhash64("id", "field"), "id").limit(pivots).select("v").collect()  # at most `pivots` vectors
    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("query", "own", "field")} | {"id": others.schema["id"].dataType.simpleString()}
    if not drawn:
        return spark.createDataFrame([], f"query {kinds['query']}, id {kinds['id']}, score double, rank int")
    centres = np.array([r["v"] for r in drawn], np.float64)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), EPS)
    held = spark.sparkContext.broadcast(centres)

    def away(batches):
        for batch in batches:
            unit_rows = _unit_rows(batch, "v")
            gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * unit_rows @ held.value.T))
            columns = [*batch.columns, pa.array(gaps.argmin(1).astype(np.int32)), pa.array(list(gaps), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "near", "gaps"])

    more = "near int, gaps array<double>"
    placed = others.select("id", "field", F.col("v").cast("array<double>").alias("v")).mapInArrow(away, f"id {kinds['id']}, field {kinds['field']}, v array<double>, {more}")
    placed = store(placed.select("id", "field", F.col("near").alias("cluster"), F.col("gaps")[F.col("near")].alias("gap"), "v"), "clusters")
    radii = placed.groupBy("field", "cluster").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    listed = radii.groupBy("field").agg(F.collect_list(F.struct("cluster", "radius", "n")).alias("clusters"))  # at most `pivots` a field
    asked = queries.select("query", "own", "field", F.col("v").cast("array<double>").alias("v")).mapInArrow(away, f"query {kinds['query']}, own {kinds['own']}, field {kinds['field']}, v array<double>, {more}")
    near = lambda c: F.struct(F.col("gaps")[c["cluster"]].alias("gap"), c["cluster"].alias("cluster"), c["radius"].alias("radius"), c["n"].alias("n"))
    asked = store(asked.join(listed, "field").select("query", "own", "field", "v", F.array_sort(F.transform("clusters", near)).alias("c")), "asked")
    home = _in_cells(asked.withColumn("x", F.col("c")[0]), placed, kinds, k, digits, block)
    first = store(home, "home")
    reached = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # The score was rounded: half a unit of its last digit less is below the true one.
    limit = F.when(F.col("least").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.col("least") - 0.5 * 10.0**-digits))) + SLACK)
    open_ = asked.join(reached, "query", "left").withColumn("limit", F.coalesce(limit, F.lit(4.0)))
    rest = F.filter(F.slice("c", 2, pivots), lambda c: c["gap"] - c["radius"] <= F.col("limit"))
    again = store(open_.select("query", "own", "field", "v", F.explode(rest).alias("x")), "visits")
    if visits is not None:
        visits += [asked.count() + again.count(), asked.agg(F.sum(F.size("c"))).first()[0] or 0]
    found = first.unionAll(_in_cells(again, placed, kinds, k, digits, block))
    return top_k(found, ["query"], [F.desc("score"), F.asc("id")], k)


def _in_cells(asked: DataFrame, placed: DataFrame, kinds: dict, k: int, digits: int, block: int) -> DataFrame:
    """query, id, score: each query's k best of the cluster x it visits, by blocks of both sides."""
    asked = asked.select("query", "own", "field", "v", "x.cluster", "x.n")
    sides = asked.groupBy("field", "cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("_q"), F.ceil(F.max("n") / (WIDE * block)).alias("_o"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.drop("n").join(sides, ["field", "cluster"]).select("field", "cluster", own("query", "_q").alias("_i"), every("_o").alias("_j"), "query", "own", none(kinds["id"]).alias("id"), "v")
    right = placed.join(sides, ["field", "cluster"]).select("field", "cluster", every("_q").alias("_i"), own("id", "_o").alias("_j"), none(kinds["query"]).alias("query"), none(kinds["own"]).alias("own"), "id", "v")

    def best(cell: pa.Table) -> pa.Table:
        asks = cell.column("id").is_null()
        q, o = cell.filter(asks), cell.filter(pa.compute.invert(asks)).sort_by("id")
        if not q.num_rows or not o.num_rows:
            return pa.table({"query": q.column("query").slice(0, 0), "id": o.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        side = lambda t: _unit_rows(t.combine_chunks().to_batches()[0], "v")
        scores = np.round(side(q) @ side(o).T, digits)
        owners, ids = np.array(q.column("own").to_pylist(), object), np.array(o.column("id").to_pylist(), object)
        scores[owners[:, None] == ids[None, :]] = -np.inf
        top = scores.argmax(1)[:, None] if k == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(scores, top, 1).ravel()
        rows, good = np.repeat(np.arange(q.num_rows), top.shape[1]), np.isfinite(value)
        return pa.table({"query": q.column("query").take(pa.array(rows[good])), "id": o.column("id").take(pa.array(top.ravel()[good])), "score": value[good]})

    return left.unionAll(right).groupBy("field", "cluster", "_i", "_j").applyInArrow(best, f"query {kinds['query']}, id {kinds['id']}, score double")


def best_candidates(candidates: DataFrame, exemplars: DataFrame, store, penalty: float, digits: int = 6, **bounds) -> DataFrame:
    """row, candidate, exemplar, score: for each row the candidate most like any exemplar of its field other than the row itself.

    candidates has row, candidate (its place), field, v, part (whether it is a
    part of a word, which costs the penalty); exemplars id, field, v. The first
    of equal candidates counts; a row whose field has no other exemplar has none.
    """
    named = candidates.withColumn("query", F.struct("row", "candidate"))
    near = nearest_in_clusters(named.select("query", F.col("row").alias("own"), "field", "v"), exemplars, store, 1, digits, **bounds)
    scored = near.select("query.row", "query.candidate", F.col("id").alias("exemplar"), "score").join(candidates.select("row", "candidate", "part"), ["row", "candidate"])
    final = F.round(F.col("score") - F.when(F.col("part"), F.lit(penalty)).otherwise(0.0), digits)
    return first_of(scored.withColumn("score", final), ["row"], [F.desc("score"), F.asc("candidate")]).select("row", "candidate", "exemplar", "score")


def reranked(scored: DataFrame, id_col: str, none_label, margin: float, k: int) -> DataFrame:
    """id_col, label, score, none_score, fallback, rank: rows per label that beat the row's NONE score by a margin, best first.

    scored has a row's score for every label. A label that no row passes takes
    all rows by score - none instead. At most k rows of a label are kept.
    """
    none = scored.where(F.col("label") == F.lit(none_label)).select(id_col, F.col("score").alias("none_score"))
    rows = scored.where(F.col("label") != F.lit(none_label)).join(none, id_col, "left").withColumn("_passed", F.coalesce(F.col("score") >= F.col("none_score") + margin, F.lit(True)))
    empty = rows.groupBy("label").agg((~F.bool_or("_passed")).alias("fallback"))
    open_ = rows.join(F.broadcast(empty), "label").where(F.col("_passed") | F.col("fallback"))  # one row per label
    order = F.when(F.col("fallback"), F.round(F.col("score") - F.col("none_score"), 9)).otherwise(F.col("score"))
    ranked = top_k(open_.withColumn("_order", order), ["label"], [F.desc("_order"), F.asc(id_col)], k)
    return ranked.select(id_col, "label", "score", "none_score", "fallback", "rank")
