"""Training formats and dataset registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Registry entries of the two training files.
SFT_ENTRY = {"sft_train": {"file_name": "sft_train.json", "columns": {"prompt": "instruction", "query": "input", "response": "output"}}}
DPO_ENTRY = {
    "interview_preference_pairs": {
        "file_name": "preference_pairs_llamafactory.json",
        "ranking": True,
        "columns": {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected"},
    }
}


def sft_rows(rows: DataFrame, question: str = "question", answer: str = "answer", system: str | None = None) -> DataFrame:
    """Instruction, empty input, output; with ``system``, that constant too."""
    out = rows.select(T.strip(F.col(question)).alias("instruction"), F.lit("").alias("input"), T.strip(F.col(answer)).alias("output"))
    return out if system is None else out.withColumn("system", F.lit(system))


def dpo_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("question").alias("instruction"), F.lit("").alias("input"), "chosen", "rejected")


def messages(question: Column) -> Column:
    """One user turn as a message list."""
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")))


def upsert(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Entries of ``new`` whose key is absent are added; present ones never change."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def merge_registry(existing: dict, new: dict) -> dict:
    """The same over two small registries."""
    return new | existing
