"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import imatch, jaccard_trie, langid, licenses, mixing, ppm, quality_cnn, sentencepiece_codec, suffix_dedup, va_file
from .common import crc_mod, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ppm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"), length=400).drop("kept")


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return quality_cnn.score(docs, net).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECES)


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": op1_ppm,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_imatch": op7_imatch,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_va_file": op9_va_file,
    "op10_language_id": op10_language_id,
}

#: The cut in SQL: 24 bits of the hash give the same buckets; the running sum decides each source's last whole bucket.
OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'w' ELSE 'v' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT k, sum(size)::BIGINT AS s FROM sizes GROUP BY k),
weighted AS (SELECT k, s, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::BIGINT AS w FROM per),
run AS (
  SELECT *, sum(s) OVER ()::BIGINT AS t, sum(w) OVER ()::BIGINT AS tw,
         coalesce(sum(s) OVER (ORDER BY s::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bs,
         coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bw
  FROM weighted),
flag AS (SELECT *, (t - 3 * bs) * w > 3 * s * (tw - bw) AS over FROM run),
level AS (SELECT t - 3 * bs AS l, tw - bw AS r FROM flag WHERE NOT over ORDER BY bw LIMIT 1),
target AS (SELECT k, s, CASE WHEN over THEN (3 * s)::DOUBLE ELSE coalesce((SELECT l FROM level)::DOUBLE * w / (SELECT r FROM level), 0) END AS target FROM flag),
full_ AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS f FROM target),
bucket AS (SELECT k, h >> 36 AS b, sum(size)::BIGINT AS n FROM sizes WHERE size > 0 GROUP BY 1, 2),
cum AS (SELECT k, b, n, sum(n) OVER (PARTITION BY k ORDER BY b)::BIGINT AS c FROM bucket),
edge AS (
  SELECT k, min(CASE WHEN c > target - f * s THEN b END) AS b, coalesce(max(CASE WHEN c <= target - f * s THEN c END), 0) AS used
  FROM cum JOIN full_ USING (k) GROUP BY k),
cut AS (
  SELECT full_.*, coalesce(edge.b, CASE WHEN edge.k IS NULL THEN 0 ELSE 1::BIGINT << 24 END)
         + CASE WHEN bucket.n IS NOT NULL AND 2 * (target - f * s - used) >= bucket.n THEN 1 ELSE 0 END AS b
  FROM full_ LEFT JOIN edge USING (k) LEFT JOIN bucket ON bucket.k = full_.k AND bucket.b = edge.b)
SELECT doc_id, size, s AS source_size, target, CASE WHEN size > 0 THEN r ELSE least(r, 1) END AS repeats, r * size AS taken
FROM (SELECT doc_id, size, s, target, f + CASE WHEN (h >> 36) < b THEN 1 ELSE 0 END AS r FROM sizes JOIN cut USING (k))
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op9_va_file": OP9_SQL}
