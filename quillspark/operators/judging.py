"""Judging: a slot for reward models, and a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def stand_in_reward(answer: Column) -> Column:
    """A number in [0, 16) from the text's MD5; equal texts, equal numbers. It has no meaning of quality."""
    return F.conv(F.substring(F.md5(T.compact(answer)), 1, 4), 16, 10).cast("double") / 4096.0


def without_nan(reward: Column) -> Column:
    """NaN is no reward: it would sort above all numbers yet win no comparison."""
    return F.when(F.isnan(reward), F.lit(None).cast("double")).otherwise(reward)


def unscored(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates that the scored log lacks."""
    return candidates.join(scored.select("prompt_id", "candidate_id"), ["prompt_id", "candidate_id"], "left_anti")


def score(candidates: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series] | None = None, name: str = "stand-in") -> DataFrame:
    """``judge_model`` and ``judge_reward`` for each candidate; without a judge, the stand-in."""
    if judge is None:
        reward = stand_in_reward(F.col("answer"))
    else:

        def run(questions: pd.Series, answers: pd.Series) -> pd.Series:
            return judge(questions, answers).astype(float)

        reward = F.pandas_udf(run, "double")("question", "answer")
    return candidates.withColumn("judge_model", F.lit(name)).withColumn("judge_reward", without_nan(reward))
