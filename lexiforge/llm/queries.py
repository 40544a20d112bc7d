"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import documents, embeddings, scope
from .exact_dedup import exact_dedup
from .hamming_index import nearest
from .language_id import identify_languages
from .lattice_lm import score_documents
from .ngram_join import jaccard_components
from .secret_scan import scan_secrets
from .shard_tree import shard_documents
from .source_mix import mix_sources
from .substring_dedup import substring_dedup
from .telephony import read_pcm, store_audio, store_pcm
from .token_links import align_tokens
from .vector_codes import digest, vector_codes


def vocabulary() -> str:
    """The public byte-level BPE vocabulary, from where the box keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, goals = mix_sources(documents(spark, sf_dir), F.array("source"))
    goals = F.broadcast(goals)  # one row per source, at most MAX_PATTERNS
    taken = taken.withColumn("source", F.element_at("sources", 1))
    return taken.join(goals, taken["source"].eqNullSafe(goals["source"])).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pcm(store_pcm(store_audio(documents(spark, sf_dir))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(documents(spark, sf_dir), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(embeddings(spark, sf_dir))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir), "_id % 20 = 0")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM listed
), windows AS (
  SELECT doc_id, pos, word,
         string_agg(word, ' ') OVER next20 AS run, count(*) OVER next20 AS n
  FROM placed
  WINDOW next20 AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT doc_id, pos, word,
         n = 20 AND row_number() OVER (PARTITION BY run, n ORDER BY doc_id, pos) > 1 AS later
  FROM windows
), covered AS (
  SELECT doc_id, pos, word,
         bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM listed
), runs AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS shingle FROM placed
), members AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE pos = 1 OR pos <= n - 2
), sizes AS (
  SELECT doc_id, count(*) AS n_shingles FROM members GROUP BY doc_id
), sized AS (
  SELECT doc_id, shingle, n_shingles FROM members JOIN sizes USING (doc_id)
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sized a JOIN sized b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
   AND 100 * a.n_shingles >= 90 * b.n_shingles AND 100 * b.n_shingles >= 90 * a.n_shingles
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * (any_value(a.n_shingles) + any_value(b.n_shingles) - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x
)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""

def _op12_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out, over vectors of parts times width components; their sums are whole numbers, exact as doubles."""
    steps, last = [], rounds
    for k in range(last + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, part, x, unnest(best).entry AS entry, unnest(best).gap AS gap FROM (
    SELECT q.vec_id, q.part, any_value(q.x) AS x,
           [min({{'gap': q.sq - 2 * list_inner_product(q.x, b.x) + list_inner_product(b.x, b.x), 'entry': b.entry}})] AS best
    FROM parts q JOIN book{k} b ON q.part = b.part GROUP BY q.vec_id, q.part)
)""")
        if k < last:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, place, floor(sum(v) / count(*)) AS v
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM near{k}) GROUP BY part, entry, place
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (SELECT part, entry, list(v ORDER BY place) AS x FROM mean{k} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, x, list_inner_product(x, x) AS sq
  FROM (SELECT vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS x FROM kept, range({parts}) AS p(part))
), book0 AS MATERIALIZED (
  SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts) WHERE entry < {entries}
),{",".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM near{last} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM book{last})
)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id, books
"""


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
      FROM documents)
WINDOW g AS (PARTITION BY content)
"""


#: A block in which queries keep their tables; at its end they go.
tables_kept = scope


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_lattice_lm": op3_lattice_lm,
        "op4_source_mix": op4_source_mix,
        "op5_telephony": op5_telephony,
        "op6_ngram_join": op6_ngram_join,
        "op7_secret_scan": op7_secret_scan,
        "op9_bpe": op9_bpe,
        "op8_exact_dedup": op8_exact_dedup,
        "op10_shard_tree": op10_shard_tree,
        "op11_token_links": op11_token_links,
        "op12_vector_codes": op12_vector_codes,
        "op13_hamming_index": op13_hamming_index,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op6_ngram_join": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_vector_codes": _op12_sql()}
