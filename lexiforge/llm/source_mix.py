"""Mixing sources to target weights by minimum-cost flow.

Documents are summed by membership pattern (the set of sources a document
belongs to). A small network then routes each pattern's tokens to the sources'
quotas; a pattern may be repeated, each further repetition at a higher cost, so
that documents are repeated only where fresh text has run out. The routed
tokens of a pattern say how often all its documents are taken and how many
tokens of them once more; those are chosen in the order of a seeded hash.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, word_count, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Cost of a token's first, second and third use; convex, so earlier uses fill first.
REPEAT_COSTS = (0, 1, 3)
#: The network is solved on the driver; more patterns than this are refused.
MAX_PATTERNS = 200_000
#: Hash buckets a pattern's documents are summed by.
BUCKET_BITS = 12
#: Times the hash order is gone through for what is left of the quotas, and then
#: single documents that may fill the rest.
PASSES, FILLS = 3, 2


def targets(sizes: Mapping, order: Sequence, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> dict:
    """Shares of the whole size by weight, none above most times its source's size.

    What a capped source can't take is shared again among the others by weight.
    """
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def route(capacity: Mapping[str, int], members: Mapping[str, Sequence], quota: Mapping, costs: Sequence[int] = REPEAT_COSTS) -> dict[str, int]:
    """Tokens taken of each pattern: a maximum flow of minimum cost.

    Every pattern has one arc per use, with capacity the pattern's tokens and
    that use's cost; all other arcs are free. A shortest path costs as much as
    the use it begins with, and such costs never fall again. So the uses are
    opened one after another, cheapest first, and each time the flow is made
    maximal by blocking flows.
    """
    patterns, sources = [p for p, n in capacity.items() if n > 0], list(quota)
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, sink = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    to, room, leaving = [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, n: int) -> int:
        """The reverse arc is the neighbour by xor 1."""
        for x, y, r in ((a, b, n), (b, a, 0)):
            leaving[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    uses = [arc(start, i, 0) for i in range(len(patterns))]
    for i, p in enumerate(patterns):
        for s in members[p]:
            arc(i, place[s], sum(quota.values()) + 1)
    for s, n in quota.items():
        arc(place[s], sink, n)
    order = sorted(costs)
    for _ in order:
        for i, p in enumerate(patterns):
            room[uses[i]] += capacity[p]
        while True:
            level, queue = [-1] * (sink + 1), deque([start])
            level[start] = 0
            while queue:
                node = queue.popleft()
                for e in leaving[node]:
                    if room[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[node] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                break
            nth, path, node = [0] * (sink + 1), [], start
            while True:  # one blocking flow: walk on, and step back from dead ends
                if node == sink:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, node = [], start
                elif nth[node] < len(leaving[node]):
                    e = leaving[node][nth[node]]
                    if room[e] > 0 and level[to[e]] == level[node] + 1:
                        path.append(e)
                        node = to[e]
                    else:
                        nth[node] += 1
                elif path:
                    node = to[path.pop() ^ 1]
                    nth[node] += 1
                else:
                    break
    return {p: room[uses[i] ^ 1] for i, p in enumerate(patterns)}


def _left(chosen: DataFrame) -> DataFrame:
    """Tokens still wanted per pattern (one row each)."""
    return chosen.groupBy("pattern", "quota").agg(F.sum(F.col("extra") * F.col("usable")).alias("got")).select("pattern", (F.col("quota") - F.col("got")).alias("left"))


def _next_pass(chosen: DataFrame) -> DataFrame:
    """Takes documents that fit what is left, in hash order, until the next one doesn't.

    Buckets of the hash order are summed first; only the bucket in which a
    pattern's quota ends is gone through document by document.
    """
    bucket = F.shiftrightunsigned(F.col("draw"), 64 - BUCKET_BITS)
    rows = chosen.join(F.broadcast(_left(chosen)), "pattern").withColumn("bucket", bucket)
    fits = F.when((F.col("extra") == 0) & (F.col("usable") <= F.col("left")), F.col("usable")).otherwise(0)
    rows = rows.withColumn("fits", fits)
    sums = rows.groupBy("pattern", "left", "bucket").agg(F.sum("fits").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy("pattern").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).where("tokens > 0 and upto > left and upto - tokens <= left").select("pattern", F.col("bucket").alias("last"), (F.col("left") - F.col("upto") + F.col("tokens")).alias("room"))
    rows = rows.join(F.broadcast(ends), "pattern", "left")
    running = F.sum("fits").over(W.partitionBy("pattern").orderBy("draw", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, 0))
    at_end = rows.where("bucket = last").withColumn("take", (F.col("fits") > 0) & (running <= F.col("room")))
    others = rows.where("last is null or bucket <> last").withColumn("take", (F.col("fits") > 0) & (F.col("last").isNull() | (F.col("bucket") < F.col("last"))))
    both = at_end.unionByName(others)
    return both.select("pattern", "doc_id", "text_key", "size", "draw", "usable", "base", "quota", F.when(F.col("take"), 1).otherwise(F.col("extra")).alias("extra"))


def mix_sources(docs: DataFrame, sources, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = WEIGHTS, costs: Sequence[int] = REPEAT_COSTS, seed: int = 17, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, sources, size, copies, taken) per row of docs, and (source, source_size, target).

    text_key is xxhash64 of the text: with doc_id it tells rows apart.

    sources is a column: the array of sources of a document (null elements are a
    source of their own, ordered last). Whole documents are taken, each at most
    len(costs) times. A source's tokens are those of all its documents.

    * null and empty texts have size 0, are never chosen and take nothing
    * a document larger than the target of every source it is in takes nothing
    * a null or empty array of sources belongs to no quota: nothing is taken
    * equal hashes fall back on the id; rows that repeat an id are chosen together in order
    * an empty table gives empty results; further columns of docs are ignored
    * over max_patterns different patterns raise ValueError: the network, some arcs per pattern, is solved on the driver
    """
    spark = docs.sparkSession
    listed = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1")))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = sized = written(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.to_json(listed).alias("pattern"), word_count(text).alias("size"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("draw")),
        "mix-sizes",
    )
    patterns = sized.groupBy("pattern").agg(F.sum("size").alias("tokens")).limit(max_patterns + 1).collect()
    if len(patterns) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    members = {r["pattern"]: json.loads(r["pattern"]) for r in patterns}
    capacity = {r["pattern"]: int(r["tokens"] or 0) for r in patterns}
    order = sorted({s for m in members.values() for s in m})
    total = {s: sum(n for p, n in capacity.items() if s in members[p]) for s in order}
    target = targets(total, order, weights, float(len(costs)))
    # A document larger than every quota it could fill takes no part.
    fit = spark.createDataFrame([(p, int(max((target[s] for s in m), default=0))) for p, m in members.items()], "pattern string, most long")
    sized = sized.join(F.broadcast(fit), "pattern").withColumn("usable", F.when(F.col("size") <= F.col("most"), F.col("size")).otherwise(0)).drop("most")  # at most max_patterns rows
    capacity |= {r["pattern"]: int(r["tokens"]) for r in sized.groupBy("pattern").agg(F.sum("usable").alias("tokens")).collect()}
    flow = route(capacity, members, {s: round(t) for s, t in target.items()}, costs)
    plan_rows = [(p, min(len(costs), flow.get(p, 0) // n) if n else 0, flow.get(p, 0) % n if n and flow.get(p, 0) < len(costs) * n else 0) for p, n in capacity.items()]
    plan = F.broadcast(spark.createDataFrame(plan_rows, "pattern string, base int, quota long"))  # at most max_patterns rows

    def step(rows: DataFrame, before: DataFrame) -> DataFrame:
        out = written(rows, "mix-chosen")
        drop_written(before)
        return out

    chosen = step(sized.join(plan, "pattern").withColumn("extra", F.lit(0)), sizes)
    for _ in range(PASSES):
        chosen = step(_next_pass(chosen), chosen)
    for _ in range(FILLS):
        fits = chosen.join(F.broadcast(_left(chosen)), "pattern").where("extra = 0 and usable > 0 and usable <= left")
        fill = fits.groupBy("pattern").agg(F.max(F.struct("usable", "draw", "doc_id", "text_key")).alias("best")).select("pattern", "best")
        hit = F.struct("usable", "draw", "doc_id", "text_key").eqNullSafe(F.col("best"))
        chosen = step(chosen.join(F.broadcast(fill), "pattern", "left").withColumn("extra", F.when(hit, 1).otherwise(F.col("extra"))).drop("best"), chosen)
    copies = F.when(F.col("usable") > 0, F.col("base") + F.col("extra")).otherwise(0)
    names = F.transform(F.from_json("pattern", "array<string>"), lambda s: F.when(s != "1", F.substring(s, 2, 1 << 30)))
    taken = chosen.select("doc_id", "text_key", names.alias("sources"), "size", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
    goals = spark.createDataFrame([(None if s == "1" else s[1:], total[s], float(target[s])) for s in order], "source string, source_size long, target double")
    return taken, goals
