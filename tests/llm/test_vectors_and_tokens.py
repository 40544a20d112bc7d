"""Operators 11, 12 and 13 against brute force on awkward tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from messy import empty, frame, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm import hamming_index, queries, token_links, vector_codes
from lexiforge.llm.bpe import byte_letters

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
INF, NAN = float("inf"), float("nan")


# -- 11: links between two tokenizers


def plain_links(listed):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, token by token."""
    a_side, b_side = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in byte_letters().items()}
    docs, count = [], Counter()
    for doc_id, text in listed:
        whole = b" " + (text or "").encode()
        a = a_side.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        of_a = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        of_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            a, b, of_a, of_b = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        in_a, in_b = spans(of_a), spans(of_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(in_a) for j, (u, v) in enumerate(in_b) if u < e and s < v]
        groups, before = [], 0
        for cut in sorted({e for _, e in in_a} & {e for _, e in in_b}):
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, at) if before <= s and e <= cut) for ids, at in ((a, in_a), (b, in_b))))
            before = cut
        count.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(i, n, m, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), digest(g)) for i, n, m, g, k in docs]


ODD = [(1000, "▁low \x00 line"), (1001, "<s> <|endoftext|> </s> <unk>"), (1002, "  two  blanks \n\t"), (1003, "héé 漢字 😀 ﬁ"), (1004, "▁"), (None, "no id")]


def links_of(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_links_against_plain_tokens(spark, monkeypatch):
    listed = [(r[0], r[1] if r[1] is None or len(r[1]) < 4000 else r[1][:2000]) for r in rows()] + ODD
    want = sorted(plain_links(listed), key=repr)
    assert sum(r[1] == 0 for r in want) >= 3 and any(r[3] < min(r[1], r[2]) for r in want)
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in listed], "doc_id long, text string, pair long, slice string")
    for parts in (1, 7):
        assert links_of(token_links.align_tokens(df.repartition(parts), JSON, MODEL)) == want


def test_links_of_many_parts_and_slices(spark, monkeypatch):
    texts = [t for _, t in ODD] * 3 + [r[1] for r in rows()[:20]]
    pair = token_links.TokenPair(open(JSON, "rb").read(), open(MODEL, "rb").read())
    whole, digests, links = token_links.aligned(pair, *pair.encode(texts))
    for k in range(0, len(texts), 5):
        part, some, _ = token_links.aligned(pair, *pair.encode(texts[k : k + 5]))
        assert some == digests[k : k + 5] and all((part[c] == whole[c][k : k + 5]).all() for c in part)
    assert len(links) == whole["n_links"].sum()
    monkeypatch.setattr(token_links, "FEW", 0)  # heavy pairs are salted
    want = sorted(plain_links(list(enumerate(texts))), key=repr)
    assert links_of(token_links.align_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), JSON, MODEL)) == want


def test_links_of_nothing_and_of_one_long_text(spark):
    assert token_links.align_tokens(empty(spark), JSON, MODEL).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert links_of(token_links.align_tokens(blank, JSON, MODEL)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = spark.createDataFrame([(1, "ab cd " * 400_000)], "doc_id long, text string")
    row = token_links.align_tokens(long, JSON, MODEL).first()
    assert row["n_a"] > 800_000 and row["n_links"] >= row["n_a"] and row["count_sum"] > row["n_links"]


# -- 12: product codes


def plain_codes(listed, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in listed if v and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (gap(r[1][p * width : (p + 1) * width], books[p][e]), e)) for p in range(parts)] for r in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[1][p * width : (p + 1) * width] for r, f in zip(kept, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, sums = [], Counter()
    for r, f in zip(kept, assign()):
        error = sum(gap(r[1][p * width : (p + 1) * width], books[p][f[p]]) for p in range(parts))
        sums[r[2]] += error
        out.append((r[0], "".join(f"{e:02x}" for e in f), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=repr), digest


def vector_rows(count=150, width=8, seed=3):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(6, width))
    some = [(i, [float(x) for x in np.float32(spots[i % 6] + rng.normal(size=width) * (0.3 if i % 2 else 0.01))], [None, 1, 2][i % 3]) for i in range(count)]
    same = [(1000 + i, some[4][1], 1) for i in range(60)]
    odd = [(2000, None, 1), (2001, [1.0, None] + [0.0] * (width - 2), 1), (2002, [NAN] + [1.0] * (width - 1), 2), (2003, [-INF] * width, 2), (2004, [], 1), (2005, [0.0] * width, None), (None, some[5][1], 1), some[7]]
    return some + same + odd


SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry long, _v int, mark int, held int"


def vector_frame(spark, listed):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in listed], SCHEMA)


@pytest.mark.parametrize("entries", [4, 40, 256])
def test_codes_against_plain_rounds(spark, monkeypatch, entries):
    monkeypatch.setattr(vector_codes, "FEW", 0)  # heavy labels are salted
    listed = vector_rows()
    want, digest = plain_codes(listed, entries=entries)
    df = vector_frame(spark, listed).repartition(3)
    coded, books = vector_codes.vector_codes(df, entries=entries)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()), key=repr) == want
    assert vector_codes.digest(books) == digest and len(books[0]) == min(entries, len(want))


def test_codes_of_edge_tables(spark):
    assert vector_codes.vector_codes(vector_frame(spark, []))[0].count() == 0
    assert vector_codes.vector_codes(vector_frame(spark, [(1, None, 1)]))[0].count() == 0
    one, books = vector_codes.vector_codes(vector_frame(spark, [(1, [1e30, -1e30, 0.5, -0.0004], None), (2, [1.0], 1), (3, [2.0, 0.0, 1.0, 1.0], 1)]))
    assert {r["vec_id"] for r in one.collect()} == {1, 3}  # the length most have
    assert [b.tolist() for b in books] == [[[1 << 26], [2048]], [[-(1 << 26)], [0]], [[512], [1024]], [[-1], [1024]]]
    odd, books = vector_codes.vector_codes(vector_frame(spark, [(1, [1.0] * 6, None), (2, [2.0] * 6, None)]))
    assert [b.shape[1] for b in books] == [1, 2, 1, 2] and {r["error"] for r in odd.collect()} == {0}


def test_tree_eliminates_and_keeps_ties():
    rng = np.random.default_rng(1)
    spots = rng.integers(-4000, 4000, (64, 4))
    points = spots[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, (4000, 4))
    tree = vector_codes.Tree.build(points)
    entry, sums, counts, looked = tree.assign(points, spots)
    want = ((points[:, None] - spots[None]) ** 2).sum(2).argmin(1)
    assert (entry == want).all() and counts.sum() == 4000 and (sums.sum(0) == points.sum(0)).all()
    assert looked < 4000 * 64 / 8  # most distances are never computed
    grid = rng.integers(0, 3, (3000, 3))
    book = np.concatenate([grid[:40], grid[:40] + 1, grid[:40]])  # many ties and repeated entries
    entry, _, _, _ = vector_codes.Tree.build(grid, leaf=4).assign(grid, book)
    assert (entry == ((grid[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
    far = rng.integers(-(1 << 26), 1 << 26, (500, 16))
    entry, _, _, _ = vector_codes.Tree.build(far).assign(far, far[:50])
    assert (entry == ((far[:, None] - far[None, :50]) ** 2).sum(2).argmin(1)).all()


# -- 13: nearest neighbours


def plain_nearest(listed, k, asks):
    kept = sorted({(i, tuple(np.float64(v))) for i, v, _ in listed if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for q in sorted({i for i, _ in kept if asks(i)}):
        best: dict = {}
        for i, v in kept:
            for j, w in kept:
                if i == q and j != q:
                    best[j] = max(best.get(j, -INF), float((np.array(v) * np.array(w)).sum()))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(ranked)]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_nearest_among_few_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(hamming_index, "FEW", 0)  # heavy vectors are salted
    listed = vector_rows(width=12)
    few = [r for r in listed if r[0] is None or r[0] % 7 == 0]
    assert found(hamming_index.nearest(vector_frame(spark, few), "_id % 2 = 0", k=200)) == plain_nearest(few, 200, lambda i: i % 2 == 0)
    # With a radius: what is found is ranked rightly, and copies and very near vectors aren't missed.
    got, want = found(hamming_index.nearest(vector_frame(spark, listed).repartition(4), "_id % 10 = 0", k=5)), plain_nearest(listed, 5, lambda i: i % 10 == 0)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    hot = [r for r in got if r[0] in (4, 1000, 1010)]
    assert hot and all(r in want for r in hot)


def test_nearest_of_edge_tables(spark):
    assert hamming_index.nearest(vector_frame(spark, []), "true").count() == 0
    assert hamming_index.nearest(vector_frame(spark, [(1, None, 1), (None, [1.0], 1), (3, [0.0], 1)]), "true").count() == 0
    assert hamming_index.nearest(vector_frame(spark, [(1, [1.0], 1)]), "true").count() == 0
    assert hamming_index.nearest(vector_frame(spark, [(1, [1.0], 1), (2, [2.0], 1)]), "_id > 5").count() == 0
    two = vector_frame(spark, [(1, [1.0, 0.0], 1), (2, [2.0, 1.0], 1), (2, [-3.0, 0.0], 1), (5, [9.0], 1)])
    assert found(hamming_index.nearest(two, "true")) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_shard_finds_all_within_a_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (40, 16)).astype(np.uint16)
    codes = base[rng.integers(0, 40, 3000)] ^ (1 << rng.integers(0, 16, (3000, 16))).astype(np.uint16) * (rng.random((3000, 16)) < 0.5)
    codes = codes.astype(np.uint16)
    shard, gaps = hamming_index.Shard(codes), hamming_index.distances(codes[:20], codes)
    for q in range(20):
        for radius in (0, 3, 12, 16, 40, 101, 256):
            assert np.array_equal(shard.within(codes[q], radius), np.flatnonzero(gaps[q] <= radius))


def test_nearest_recall(spark, small):
    table = pq.read_table(f"{small}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    got: dict = {}
    for r in queries.op13_hamming_index(spark, small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, listed in got.items():
        row = int(np.flatnonzero(ids == q)[0])
        score = (x * x[row]).sum(1)
        score[row] = -INF
        best = ids[np.lexsort((ids, -score))[:20]]
        assert [r[0] for r in sorted(listed)] == list(range(1, 21))
        assert all(s == score[np.flatnonzero(ids == j)[0]] for _, j, s in listed)
        hits += len(set(best.tolist()) & {j for _, j, _ in listed})
    assert hits >= 0.9 * 20 * len(got)


def test_largest_inner_product_with_unequal_norms(spark):
    rng = np.random.default_rng(4)
    listed = [(i, [float(x) for x in np.float32(rng.normal(size=16) * rng.choice([0.2, 1.0, 5.0]))], 0) for i in range(400)]
    got, want = found(hamming_index.nearest(vector_frame(spark, listed), "_id % 20 = 0", k=10)), plain_nearest(listed, 10, lambda i: i % 20 == 0)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(set(got) & set(want)) >= 0.9 * len(want)
