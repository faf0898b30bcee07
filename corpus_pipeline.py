"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Rejected documents go, one document of every near-duplicate group stays, passages that earlier
documents have are cut, sources are mixed to their target weights, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, mixing, near_text, quality, suffixes
from orrery.llm.common import fresh, materialize, quoted
from orrery.llm.queries import TOKENIZER


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs.columns, "quality")
    scored = quality.classify(docs, model, score=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingles are 80 % alike."""
    return near_text.keep_one(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that earlier documents have."""
    return suffixes.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256`` of every copy."""
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL cannot express the trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
