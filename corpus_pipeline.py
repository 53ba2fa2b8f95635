"""A training corpus from ``documents``: five stages, each written and read again.

Every stage works on all that the one before kept. A null or empty text, a repeated row
and an empty table pass through each stage as its operator's docstring states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import bpe, mixing, quality_cnn, simhash, suffix_dedup
from keyfold.llm.common import fresh, ready, scratch_path
from keyfold.llm.queries import LEAST_SCORE, RANKS, mixed, quality_model

#: Words of a shingle and the least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores at LEAST_SCORE or more."""
    ready(spark)
    return quality_cnn.keep_good(docs, "doc_id", "text", quality_model(spark, docs, sf_dir), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of SimHash near duplicates: the one with the least id.

    Texts link by the fingerprints of their distinct runs of SHINGLE words, at a Jaccard
    similarity of SIMILAR or more as far as those tell it. Texts without words, null or
    empty, are one group. Only the texts decide: a row with a null id comes after all
    others of its group and stays if it is alone there; different texts under one id all
    stay. Among rows of one id the least hash of the whole row is kept.
    """
    ready(spark)
    return simhash.keep_one(docs, "doc_id", "text", SHINGLE, SIMILAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a text that is cut inside a character loses the rest of that character.

    Each row gets the cut of its own id and text, so rows of one id stay apart.
    """
    ready(spark)
    number, source, kept = (fresh(x, docs.columns) for x in ("_cut", "_source", "_kept"))
    own = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"), 256)
    cut = suffix_dedup.remove_repeats(docs, "doc_id", "text", sources=True, characters=True).where("n_removed > 0")
    cut = cut.select("doc_id", "source_sha256", "kept").toDF(number, source, kept).dropDuplicates([number, source])
    whole = F.col(number).isNull()
    joined = docs.join(cut, (F.col("doc_id") == F.col(number)) & (own == F.col(source)), "left")
    joined = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(F.col(kept).cast("string")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents at rates of one or more that meet the target shares of the domains; none is lost."""
    ready(spark)
    return mixing.apply_rates(docs, "doc_id", "text", mixed(spark, docs, sf_dir, 1.0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the round trip checked."""
    ready(spark)
    return bpe.encode_documents(docs, "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("encode", encode)]

#: Training, fingerprints and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``, each result written to the shared folder and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
