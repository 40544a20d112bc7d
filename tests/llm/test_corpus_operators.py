"""Operators 2, 3, 6 and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from decimal import Decimal
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from messy import empty, fold, frame, rows, thue_morse, words
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import common, graph, lattice_lm, ngram_join, source_mix, substring_dedup
from lexiforge.llm.graph import components
from lexiforge.llm.words import Words, exact_shingle_sets, shingle_sets, text_buffers

ROWS = rows()
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed, n):
    """Texts with shared passages, near copies and repeats inside one text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(4)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages) * r.choice([1, 1, 2])
        if out and r.random() < 0.3:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return out


# -- 2: substrings


def want_removed(docs, size):
    seen, out = {}, {}
    for i, text in sorted(docs):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[k : k + size]), (i, k)) != (i, k):
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substrings(spark, batches):
    docs = corpus(3, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substring_dedup.substring_dedup(df, 20, batches, keep_text=True).collect()
    want = want_removed(docs, 20)
    assert len(got) == len(docs) and sum(v[1] for v in want.values()) > 500
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_substrings_awkward(spark):
    got = substring_dedup.substring_dedup(frame(spark)).collect()
    assert len(got) == len(ROWS)
    want = want_removed({r[0]: r[1] for r in ROWS}.items(), 20)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    null = spark.createDataFrame([(None, "a b " * 30), (1, "a b " * 30)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(null).collect()} == {None: 0, 1: 60 - 2}


def test_index_compacts(spark):
    docs = spark.createDataFrame(corpus(4, 40), "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    index = substring_dedup.FingerprintIndex(spark, 20, buckets=3, max_runs=2)
    for low in range(0, 40, 10):
        index.ingest(docs.where(f"doc_id >= {low} and doc_id < {low + 10}"), docs.where(f"doc_id < {low + 10}"))
    assert len(index.runs) <= 3
    index.compact()
    assert len(index.runs) == 1
    one = substring_dedup.segments(docs, 20).where("not again").count()
    assert spark.table(index.runs[0]).count() >= one


# -- 3: likelihood


class SlowLattice:
    """All segmentations of a word by plain dynamic programming over probabilities, in decimals; pieces counted word by word."""

    def __init__(self, words, ends):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        counts = Counter()
        for w, n in words.items():
            for piece in model.encode(w):
                counts[piece] += n
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = sum(counts.values()) + ends + len(usable) + 1
        chance = lambda n: Decimal(n + 1) / total
        self.byte = {int(model.id_to_piece(i)[3:5], 16): chance(counts[i]) for i in usable if model.is_byte(i)}
        self.piece = {model.id_to_piece(i): chance(counts[i]) for i in usable if not model.is_byte(i)}
        self.longest, self.end, self.known = max(map(len, self.piece)), float(chance(ends).log10()), {}

    def __call__(self, word):
        if word not in self.known:
            text = "▁" + word
            ways = [Decimal(1)]
            for j in range(1, len(text) + 1):
                raw = Decimal(1)
                for b in text[j - 1].encode():
                    raw *= self.byte.get(b, Decimal(1))
                ways.append(ways[j - 1] * raw + sum(ways[i] * self.piece[text[i:j]] for i in range(max(0, j - self.longest), j) if text[i:j] in self.piece))
            self.known[word] = float(ways[-1].log10())
        return self.known[word]


def test_scores(spark):
    got = {r["doc_id"]: r for r in lattice_lm.score_documents(frame(spark), PIECES).collect()}
    tokens = {r[0]: words(fold(r[1] or "")) for r in ROWS}
    counts, ends, n = Counter(), 0, 0
    for r in ROWS:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(words(fold(r[1] or "")))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    model = SlowLattice(counts, ends)
    for i, w in tokens.items():
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(counts[t] > 0 for t in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(sum(model(t) for t in w) + model.end, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert got[100]["score"] == got[101]["score"] > got[0]["score"]
    assert lattice_lm.score_documents(empty(spark), PIECES).count() == 0


def test_forward_sums_all_segmentations():
    lattice = lattice_lm.Lattice(PIECES, {300: 5, 400: 7}, 3)

    def every(text):
        if not text:
            return 1.0
        total = 10 ** sum(lattice.byte[b] for b in text[0].encode()) * every(text[1:])
        for k in range(1, len(text) + 1):
            if text[:k] in lattice.piece:
                total += 10 ** lattice.piece[text[:k]] * every(text[k:])
        return total

    for word in ("the", "house", "été", "中x", "a"):
        assert lattice.log10(word) == pytest.approx(math.log10(every("▁" + word)), rel=1e-9)
    mass = sum(10 ** p for p in lattice.piece.values()) + sum(10 ** p for p in lattice.byte) + 10**lattice.end
    assert mass == pytest.approx(1, abs=1e-3)


# -- 6: similar sets


def want_components(docs, size, percent):
    sets = {}
    for i, text in docs:
        w = words(fold(text or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_similar_sets(spark, size, percent, seed):
    r = random.Random(seed)
    base = [r.choice([f"v{i}" for i in range(500)]) for _ in range(140)]
    docs = corpus(seed, 120)
    for k in range(80):  # a chain of near copies, where not all are near each other
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = f"x{r.random()}"
        docs.append((1000 + k, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    want = want_components(docs, size, percent)
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_similar_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "SKETCH_DOCS", 5)
    monkeypatch.setattr(ngram_join, "PIVOT_DOCS", 4)
    docs = [(i, " ".join(f"s{(j * (1 if j % 40 else i % 3 + 1))}" for j in range(90))) for i in range(40)]
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want_components(docs, 3, 90)


def test_large_groups_meet_pivots(spark, monkeypatch):
    """Copies of one text beyond all limits, with some that no pivot reaches: equal to brute force, in linear work."""
    for name, n in (("BLOCK_DOCS", 12), ("SKETCH_DOCS", 10), ("PIVOT_DOCS", 10), ("BLOCK_SHINGLES", 1500), ("BROADCAST_KEYS", 0)):
        monkeypatch.setattr(ngram_join, name, n)
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 3):
            w[r.randrange(len(w))] = f"x{r.random()}"
        docs.append((i, " ".join(w)))
    for k in range(6):  # share a third of it
        docs.append((500 + k, " ".join(base[:50] + [f"y{k}.{j}" for j in range(100)])))
    work = []
    plain = ngram_join.split
    monkeypatch.setattr(ngram_join, "split", lambda members, *a: work.append((members.count(), plain(members, *a).count())) or plain(members, *a))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want_components(docs, 3, 90)
    assert work and all(dealt <= 3 * members for members, dealt in work)


def component_of_rows(docs, size=3, percent=90):
    """(id, set size, component) per row: rows with one id are one document."""
    near = want_components([((i, t), t) for i, t in docs], size, percent)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, t), (_, (j, u)) in near.items():
        parent[find(("row", i, t))] = find(("row", j, u))
    for i, t in docs:
        parent[find(("row", i, t))] = find(("id", i))
    least = {}
    for i, t in docs:
        root = find(("row", i, t))
        least[root] = min(i, least.get(root, i))
    return sorted((i, near[i, t][0], least[find(("row", i, t))]) for i, t in docs)


def test_repeated_ids_tie_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(3, a), (5, a), (5, b), (7, b + " more"), (9, ""), (9, "lone words here"), (9, "")]
    r = random.Random(12)
    for seed in (1, 2):
        docs += [(100 * seed + (r.randrange(20) if r.random() < 0.3 else i), t) for i, t in corpus(seed, 60)]
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == component_of_rows(docs)
    assert {x["component_id"] for x in got if x["doc_id"] in (3, 5, 7)} == {3}


def test_different_texts_of_equal_polynomials(spark):
    one, two = thue_morse(2048)
    docs = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, " ".join(one)), (4, " ".join(two))]
    docs += [(i + 10, " ".join([w, *(f"c{j}" for j in range(25))])) for i, w in enumerate((one, two))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == want_components(docs, 3, 90)
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert removed == want_removed(docs, 20)
    known = {r["doc_id"]: r["n_known"] for r in lattice_lm.score_documents(spark.createDataFrame([(7, one), (1, two)], "doc_id long, text string"), PIECES).collect()}
    folds = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in (1, 7)}
    assert folds == {1: True, 7: False} and known == {1: 1, 7: 2}


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    texts = ["one two three two", "three ONE", "", "a-word-of-many-bytes a-word-of-many-bytez two"]
    monkeypatch.setattr(Words, "hashes", lambda self, seed=1: np.zeros(self.n, np.uint64))
    found = Words(*text_buffers(pa.array(texts)), fold=True)
    first, kind = found.distinct()
    names = [w for t in texts for w in fold(t).split()]
    assert len(first) == len(set(names)) and [names[first[k]] for k in kind] == names
    values, bounds = exact_shingle_sets(found, 2)
    assert np.diff(bounds).tolist() == [3, 1, 0, 2]
    assert found.sequences() == [fold(t).encode() for t in texts]


def test_products_count_shared_shingles(monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 3)
    sets = [set(r.integers(0, 60, r.integers(0, 40)).tolist()) | ({1, 2, 3, 4, 5} if i % 2 else set()) for i in range(30)]
    values = np.concatenate([np.array(sorted(s), np.int64) for s in sets])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    left, right = np.arange(0, 20), np.arange(10, 30)
    for dense in (1, 4, 10**6):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        got = ngram_join.overlap_product(values, bounds, left, right)
        assert got.tolist() == [[len(sets[a] & sets[b]) for b in right] for a in left]
    a, b = np.repeat([0, 1, 3], 29), np.concatenate([np.delete(np.arange(30), x) for x in (0, 1, 3)])
    want = [2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y]) for x, y in zip(a, b)]
    assert ngram_join.star_links(values, bounds, a, b, 50).tolist() == want


def test_similar_sets_awkward(spark):
    got = ngram_join.jaccard_components(frame(spark)).collect()
    assert len(got) == len(ROWS)
    want = want_components({r[0]: r[1] for r in ROWS}.items(), 3, 90)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_shared_bucket_for_every_close_pair():
    """Two sets within the distance of a link always share a signature."""
    r = random.Random(9)
    for percent in (80, 90):
        classes = ngram_join.SizeClasses(percent)
        for _ in range(150):
            n = r.randint(classes.least, 300)
            x = [r.getrandbits(64) for _ in range(n)]
            y = x[: n - r.randint(0, n * (100 - percent) // (2 * percent))] + [r.getrandbits(64) for _ in range(r.randint(0, n // 20))]
            a, b = np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64)
            both = len(set(x) & set(y))
            if 100 * both < percent * len(set(x) | set(y)) or set(x) == set(y):
                continue
            sigs, owner = ngram_join.bucket_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes)
            assert set(sigs[owner == 0].tolist()) & set(sigs[owner == 1].tolist())


def test_shingle_sets_are_sets_of_sequences():
    docs = ["a b c a b c a", "", "a b", "A  B\tc", "x"]
    values, bounds = shingle_sets(Words(*text_buffers(pa.array(docs)), fold=True), 3)
    assert np.diff(bounds).tolist() == [3, 0, 1, 1, 1]
    assert values[bounds[3]] in values[: bounds[1]]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {i: i for e in edges for i in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# -- pipeline


def awkward_documents(spark):
    """The awkward rows with repeats, null ids, one id of two texts and columns that clash with the stages' own."""
    docs = frame(spark)
    more = [(None, ROWS[3][1] + " more words", "en", "src0"), (None, ROWS[4][1] + " other words", None, "src1"), (None, "x y z", "en", None), (None, "x y z", "en", None), (5, "an id of two texts", "en", "src2")]
    rows = spark.createDataFrame([(*m, 1) for m in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(rows, allowMissingColumns=True)
    for c in ("id_key", "text_key", "copies", "mix_copies", "pred", "label", "node", "size"):
        docs = docs.withColumn(c, F.lit(1))
    return docs


def test_pipeline_stages(spark):
    docs = awkward_documents(spark)
    names = docs.columns
    kept = corpus_pipeline.language(spark, docs, "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == names and not ids & {100, 101, 102, 103} and ids >= set(range(60))
    assert all(r["lang"] for r in kept.collect())
    single = corpus_pipeline.exact(spark, kept, "")
    left = single.collect()
    last = {}
    for r in kept.collect():
        last[fold(r["text"])] = max((r["doc_id"] is not None, r["doc_id"] or 0), last.get(fold(r["text"]), (False, 0)))
    want = {t: i if has else None for t, (has, i) in last.items()}
    assert single.columns == names and len(left) == len(want) and {fold(r["text"]): r["doc_id"] for r in left} == want
    near = corpus_pipeline.near(spark, single, "")
    ids = [(i, r["text"]) for i, r in enumerate(left)]
    groups = want_components(ids, 5, 80)
    stay = []
    for i, (_, group) in groups.items():
        members = [left[j]["doc_id"] for j, (_, g) in groups.items() if g == group]
        least = min((m for m in members if m is not None), default=None)
        stay += [(left[i]["doc_id"], left[i]["text"])] * (left[i]["doc_id"] == least)
    found = near.collect()
    assert near.columns == names and sorted(map(str, stay)) == sorted(str((r["doc_id"], r["text"])) for r in found)
    mixed = corpus_pipeline.mix(spark, near, "")
    taken, _ = source_mix.mix_sources(near, F.array("source"))
    counts = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert mixed.columns == names and max(counts.values()) <= 3 and sum(counts.values()) == sum(r["copies"] for r in taken.collect()) > 0
    tokens = corpus_pipeline.tokens(spark, mixed, "").collect()
    assert len(tokens) == sum(counts.values()) and all(len(r["ids"]) == r["n_tokens"] for r in tokens)


def test_pipeline_leaves_only_its_last_input(spark, tmp_path):
    awkward_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    root = Path(common.shared_dir(spark)) / "lexiforge"
    common.release()
    before = set(root.iterdir()) if root.exists() else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before] == ["stage-mix"]
    common.release()
    assert set(root.iterdir()) == before


def test_pipeline_on_empty(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]


def test_mix_keeps_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text here", "en", "src0", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    taken, _ = source_mix.mix_sources(docs, F.array("source"))
    assert corpus_pipeline.mix(spark, docs, "").count() == sum(r["copies"] for r in taken.collect()) > 0


def test_buckets_are_dealt_once(spark, monkeypatch):
    """op6_ngram_join: buckets are counted and joined from one exchange, whatever the size."""
    plans = []
    plain = ngram_join.written

    def noted(df, name, *a, **k):
        if name == "jaccard-meets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *a, **k)

    monkeypatch.setattr(ngram_join, "written", noted)
    docs = [(i, " ".join(f"w{(i // 3, j)}" for j in range(40))) for i in range(9)]
    ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(plans) == 1 and plans[0].count("Scan parquet") == 2 and plans[0].count("REPARTITION_BY_COL") == 2
    dealt = [line.split("Exchange")[1].split(", [plan_id")[0] for line in plans[0].splitlines() if "REPARTITION_BY_COL" in line]
    assert len({x.split("#")[0] for x in dealt}) == 1


def test_signatures_stay_in_place(spark, monkeypatch):
    """op6_ngram_join: the table of class nodes is picked without moving signatures, whatever the broadcast limit."""
    plans = []
    plain = ngram_join.written

    def noted(df, name, *a, **k):
        if name == "jaccard-nodes":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *a, **k)

    monkeypatch.setattr(ngram_join, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = [(i, " ".join(f"w{(i // 3, j)}" for j in range(40 + i % 2))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "one")]
        want = want_components(docs, 3, 90)
        for bits in (ngram_join.BROADCAST_BITS, 0):
            monkeypatch.setattr(ngram_join, "BROADCAST_BITS", bits)
            got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]


def test_chosen_rows_in_place(spark):
    """Rows by number, over partitions' first and last numbers and both ends of a mask."""
    rows = spark.range(0, 1000, 1, 7).select("id", F.monotonically_increasing_id().alias("row"))
    numbers = [r["row"] for r in rows.collect()]
    chosen = {n for n in numbers if n % 64 in (0, 63) or n % 3 == 1}
    got = ngram_join.in_place(rows, spark.createDataFrame([(n,) for n in chosen], "node long"), 1000)
    assert got.columns == ["id", "row"] and sorted(r["row"] for r in got.collect()) == sorted(chosen)


def test_pivots_stop_where_they_do_not_pay(spark, monkeypatch):
    """pipeline: a group in which nearly nothing links meets one pivot, not three, and all its links are found."""
    for name, n in (("BLOCK_DOCS", 12), ("SKETCH_DOCS", 10), ("PIVOT_DOCS", 10), ("APART_DOCS", 10)):
        monkeypatch.setattr(ngram_join, name, n)
    turns = []
    plain = ngram_join.starred
    monkeypatch.setattr(ngram_join, "starred", lambda pairs, *a: turns.append(pairs.count()) or plain(pairs, *a))
    common = [f"b{i}" for i in range(92)]
    docs = [(i, " ".join(common + [f"y{i}.{j}" for j in range(8)])) for i in range(40)]
    docs += [(100 + i, " ".join(common + [f"z{j}" for j in range(7)] + [f"z{i}"])) for i in range(4)]
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want_components(docs, 3, 90)
    assert len(turns) == 1
