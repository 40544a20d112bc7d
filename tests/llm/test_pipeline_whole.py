"""The pipeline's run() over a whole table, held against plain Python from stage to stage."""

import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from messy import fold, words
from test_corpus_operators import want_components
from tokenizers import Tokenizer

import corpus_pipeline
from lexiforge.llm import queries, source_mix


def with_rejects(small, folder):
    """The table and rows that no language passes: without letters, and of another language than they are labelled with."""
    table = pq.read_table(f"{small}/documents.parquet").replace_schema_metadata()
    english = next(d["text"] for d in table.to_pylist() if d["lang"] == "en" and d["n_chars"] > 2000)
    held = (i for i in range(100_000, 200_000) if zlib.crc32(str(i).encode()) % 5 == 0)  # not learned from
    more = [(next(held), text, lang, "src1", len(text or "")) for text, lang in ((None, "en"), ("12 34", None), ("Other " + english, "de"), ("More " + english, "en"))]
    rows = pa.table(dict(zip(table.column_names, zip(*more))), schema=table.schema)
    pq.write_table(pa.concat_tables([table, rows]), f"{folder}/documents.parquet")
    return str(folder)


def test_run_over_a_whole_table(spark, small, tmp_path):
    where = with_rejects(small, tmp_path)
    table = pq.read_table(f"{where}/documents.parquet").to_pylist()
    result = corpus_pipeline.run(spark, where).collect()

    judged = {r["doc_id"]: r for r in queries.op1_language_id(spark, where).collect()}
    sure = lambda d: judged[d["doc_id"]]["score"] >= 0.99
    kept = [d for d in table if judged[d["doc_id"]]["lang_pred"] != "und" and not (d["lang"] is not None and d["lang"] != judged[d["doc_id"]]["lang_pred"] and sure(d))]
    assert len(kept) == len(table) - 3

    last = {}
    for d in kept:
        key = fold(d["text"] or "")
        if key not in last or d["doc_id"] > last[key]["doc_id"]:
            last[key] = d
    single = list(last.values())
    assert len(single) < len(kept)

    groups = want_components([(d["doc_id"], d["text"]) for d in single], 5, 80)
    near = {d["doc_id"]: d for d in single if groups[d["doc_id"]][1] in (None, d["doc_id"])}
    assert len(near) < len(single)

    counts = Counter(r["doc_id"] for r in result)
    assert set(counts) <= set(near) and max(counts.values()) <= 3
    sizes = Counter()
    for d in near.values():
        sizes[d["source"]] += len(words(d["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    goal = source_mix.targets(dict(sizes), names)
    weights = dict(zip(names, [5, 2, 1] * len(names)))
    assert sum(goal.values()) == pytest.approx(sum(sizes.values())) and all(goal[s] <= 3 * sizes[s] + 1e-6 for s in names)
    free = [s for s in names if goal[s] < 3 * sizes[s] - 1e-6]
    assert len({round(goal[s] / weights[s], 6) for s in free}) <= 1  # what isn't capped is shared by weight
    have, largest = Counter(), Counter()
    for i, n in counts.items():
        have[near[i]["source"]] += n * len(words(near[i]["text"]))
    for d in near.values():
        largest[d["source"]] = max(largest[d["source"]], len(words(d["text"])))
    assert all(abs(have[s] - goal[s]) <= largest[s] for s in names)

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = {i: plain.encode(near[i]["text"], add_special_tokens=False).ids for i in counts}
    assert all(list(r["ids"]) == coded[r["doc_id"]] and r["n_tokens"] == len(coded[r["doc_id"]]) for r in result)
