"""Corpus pipeline: STAGES applied to documents one after another, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Rows keep their order nowhere; nulls are as in each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, ngram_join, pii, quality
from quillspark.llm.common import cut, drop, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines are removed."""
    return _counted(quality.clean(docs.select(*COLUMNS)))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by its kind."""
    return _counted(pii.mask(docs.select(*COLUMNS)))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document stands as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each text, and the hash of what they decode to."""
    import public_tokenizers

    vocabulary = bpe.tables(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("personal data", stage_pii),
    ("source mixing", stage_mix),
    ("byte-level BPE", stage_encode),
]

#: Random rounding and BPE merges have no SQL form: tests/llm compare run() with a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written, and what it read goes then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
