"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, labelled, media, mixing, near_text, near_vectors, pfor, quality, suffixes, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, TOKENIZER).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        labelled.held_out("doc_id", toxicity.MODULUS, toxicity.REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select(
        "doc_id",
        labelled.held_out("doc_id", quality.MODULUS, quality.REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pfor.read_documents(pfor.write_segments(docs, TOKENIZER))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_passes": op1_embedding_passes,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_quality": op6_quality,
    "op7_minhash": op7_minhash,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_token_ids": op9_token_ids,
    "op10_suffix_array": op10_suffix_array,
}
ORACLE_SQL: dict[str, str] = {
    "op8_chat_rotation": r"""
WITH placed AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM placed WHERE speaker <> 'system'),
segments AS (
  SELECT p.conv_id, q.perspective, p.place // 64 AS part, p.place, coalesce(p.speaker = q.perspective, false) AS own,
         '<|im_start|>' || CASE WHEN p.speaker = q.perspective THEN 'assistant' WHEN p.speaker = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(p.speaker, '\s', '_', 'g') END || chr(10) AS lead,
         replace(replace(p.content, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' AS body
  FROM placed p LEFT JOIN people q ON p.conv_id = q.conv_id),
run AS (
  SELECT *, sum(length(lead) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) AS upto FROM segments)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(lead || body || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (upto - 1 - length(body))::BIGINT || '-' || (upto - 1)::BIGINT END, ',' ORDER BY place), '') AS loss_spans,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS loss_chars
FROM run GROUP BY conv_id, perspective, part
""",
    "op4_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sizes GROUP BY source),
ordered AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER below, 0) AS remaining,
         sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS weights
  FROM weighed
  WINDOW below AS (ORDER BY source_size / w, w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, remaining * w > 3 * source_size * weights AS clamped FROM ordered),
level AS (SELECT remaining AS l, weights AS lw FROM marked WHERE NOT clamped ORDER BY source_size / w, w, source NULLS FIRST LIMIT 1),
plan AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (w * l)::DOUBLE / lw::DOUBLE END AS target
  FROM marked CROSS JOIN level),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM plan),
run AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN split p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, least(whole + CASE WHEN 2 * before + size <= 2 * extra AND before < extra THEN 1 ELSE 0 END, 3)::BIGINT AS repeats FROM run)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, repeats, (repeats * size)::BIGINT AS taken FROM taken
""",
}
