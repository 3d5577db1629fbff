"""Entry points: a smoke chat and a three-stage demo run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation
from quillspark.sources import files

#: Stages of training, in order, and whether their adapter is there.
STAGES = (("base", "none"), ("sft", "trained"), ("rlhf", "not_trained"))
QUESTIONS = ("What is overfitting?", "How does gradient descent work?", "What does an index do in a database?", "When is recursion a bad idea?")


def stage_table(spark: SparkSession, stages=STAGES) -> DataFrame:
    return files.literal_rows(spark, [(i, *s) for i, s in enumerate(stages)], "place int, stage string, adapter string")


def smoke(spark: SparkSession, model, questions=QUESTIONS) -> DataFrame:
    """Each question's chat prompt and a model's answer; ``model`` is ``prompts -> texts``."""
    rows = files.literal_rows(spark, list(enumerate(questions)), "place int, question string").withColumn("prompt", T.chatml(F.col("question")))
    return rows.withColumn("answer", F.pandas_udf(model, "string")("prompt")).orderBy("place")


def run(spark: SparkSession, questions: DataFrame, model, judge, stages=STAGES) -> DataFrame:
    """Questions through every stage: answers, scores, buckets. ``model`` sees (stage, prompt), ``judge`` (question, answer).

    An error of a model fails its batch; blank questions and untrained stages never reach one.
    """
    rows = evaluation.staged_run(questions, stage_table(spark, stages)).withColumn("prompt", T.chatml(F.col("question")))
    ask = rows.where("to_score").withColumn("answer", F.pandas_udf(model, "string")("stage", "prompt"))
    ask = ask.withColumn("score", F.pandas_udf(judge, "double")("question", "answer"))
    rest = rows.where("NOT to_score").withColumn("score", F.lit(None).cast("double"))
    both = ask.unionByName(rest)
    return both.withColumn("bucket", T.score_bucket(F.col("score"))).withColumn("score_text", T.score_text(F.col("score"))).drop("prompt")
