"""The registered queries of the text operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krylith.llm import attention_lm, language_id, oracles, quality_classifier
from krylith.llm.decontaminate import decontaminate
from krylith.llm.html_text import extract_text
from krylith.llm.mixing import md5_draw, mix
from krylith.llm.near_duplicates import near_duplicates
from krylith.llm.quality_rules import quality_rules
from krylith.llm.substring_dedup import substring_dedup
from krylith.llm.token_counts import token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs, fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), "word_bpe_49k.json", 2048)


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attention_lm.score(documents(spark, sf_dir), fold(7) != 2)
    return found.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality_classifier.fit(docs, labels, fold(4) != 2)
    return quality_classifier.classify(docs, network, 0.7).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights of labelled documents: 2 if good, 0.5 if bad."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return marks.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(documents(spark, sf_dir), weights, draw=md5_draw()).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_near_duplicates, op3_language_id, op4_quality_rules, op5_token_counts, op6_attention_lm, op7_quality_classifier, op8_html_text, op9_substring_dedup, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": oracles.DECONTAMINATE, "op2_near_duplicates": oracles.NEAR_DUPLICATES, "op9_substring_dedup": oracles.SUBSTRING_DEDUP, "op10_mixing": oracles.MIXING}
