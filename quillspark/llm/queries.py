"""Queries and SQL of the operators in this subpackage; the registry adds them if it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, html, licenses, mixing, neardup_vectors, ngram_join, pii, quality, substring
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), with_text=False)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its text after removal; ``removed`` marks those that lost sentences."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.col("n_removed") > 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.tables(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    labels = table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", "quality")
    model = classifier.train(docs, labels, "quality")
    scored = classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_quality_rules,
        op3_source_mixing,
        op4_embedding_neardup,
        op5_ngram_jaccard,
        op6_substring_dedup,
        op7_bpe,
        op8_license_scan,
        op9_quality_classifier,
        op10_pii,
    )
}

SQL: dict[str, str] = {"op2_quality_rules": quality.sql(), "op8_license_scan": licenses.sql()}
