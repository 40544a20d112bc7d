"""Operator 1 over a whole table against plain cross-parsing: longest matches looked up in the labelled text itself."""

import math
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexiforge.llm import language_id, queries
from lexiforge.llm.common import documents, id_crc


def letters(text):
    """Lower-cased bytes of letters, one blank for each other ASCII byte."""
    return bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in pc.utf8_lower(pa.scalar(text)).as_py().encode())


def phrases(piece, learned):
    count = at = 0
    while at < len(piece):
        count += 1
        end, found = at + 1, learned.find(piece[at : at + 1])
        while found >= 0 and end < len(piece) and (found := learned.find(piece[at : end + 1], found)) >= 0:
            end += 1
        at = end
    return count


def test_whole_table_against_plain_parsing(spark, small):
    docs = documents(spark, small)
    learning = docs.where(F.pmod(id_crc(F.col("doc_id")), F.lit(5)) != 0)
    sample = language_id.labelled_sample(learning.select("doc_id", "text", "lang"))
    most = min(language_id.TRAIN_SYMBOLS, language_id.ALL_SYMBOLS // len(sample))
    learned = {lang: letters(text.decode())[:most] for lang, text in sorted(sample.items())}
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, small).collect()}
    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert set(got) == {d["doc_id"] for d in table} and len(learned) == 4
    for d in table:
        row, text = got[d["doc_id"]], d["text"] or ""
        assert row["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        if not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        data = letters(text)
        bits = {lang: sum(phrases(data[i : i + language_id.PIECE], own) for i in range(0, len(data), language_id.PIECE)) * math.log2(len(own)) for lang, own in learned.items()}
        best = min(bits, key=lambda lang: (bits[lang], lang))
        assert row["lang_pred"] == best
        assert math.isclose(row["score"], 1 / sum(2 ** -min(b - bits[best], 1000) for b in bits.values()), rel_tol=1e-9)
