"""Record kinds as explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _strings(names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names.split()]


QUESTION = StructType(_strings("id role category skill question_type difficulty seniority question interview_intent expected_points source_type answer"))
#: A source may name its columns either way; both are read, absent ones are null.
SOURCE = StructType(QUESTION.fields + _strings("instruction output"))
PROMPT = StructType(_strings("prompt_id question reference_answer role category skill question_type difficulty seniority source_type") + [StructField("source_row", IntegerType())])
CANDIDATE = StructType(
    PROMPT.fields
    + _strings("candidate_id candidate_source answer")
    + [StructField(n, DoubleType()) for n in ("temperature", "top_p", "repetition_penalty")]
    + [StructField("generation_seed", LongType())]
    + _strings("generation_prompt created_at_utc")
)
SCORED = StructType(CANDIDATE.fields + [StructField("judge_model", StringType()), StructField("judge_reward", DoubleType()), StructField("scored_at_utc", StringType())])
MESSAGES = ArrayType(StructType(_strings("role content")))
PAIR = StructType(
    _strings("prompt_id role category skill difficulty question_type source_type question")
    + [StructField("prompt", MESSAGES)]
    + _strings("chosen rejected chosen_source")
    + [StructField("chosen_temperature", DoubleType()), StructField("chosen_reward", DoubleType()), StructField("rejected_temperature", DoubleType())]
    + [StructField("rejected_reward", DoubleType()), StructField("judge_margin", DoubleType()), StructField("viable_candidate_count", LongType())]
    + _strings("judge_model selection_policy")
)
#: Columns of the audit sheet, in order (fixed).
AUDIT = "prompt_id role difficulty question_type source_type question chosen_source chosen_temperature chosen_reward chosen rejected_temperature rejected_reward rejected judge_margin".split()
ANSWER = StructType(_strings("key answer error"))
DPO = StructType(_strings("instruction input chosen rejected"))
SFT = StructType(_strings("instruction input output"))
EVALUATION = StructType([*_strings("id role difficulty question_type question"), StructField("expected_points", ArrayType(StringType()))])
DATASET = StructType([StructField("file_name", StringType()), StructField("ranking", BooleanType()), StructField("columns", MapType(StringType(), StringType()))])
REGISTRY = MapType(StringType(), DATASET)


def require_columns(df: DataFrame, *groups: set[str] | str) -> None:
    """Fail unless ``df`` has each column, or one of each set of alternatives."""
    for group in groups:
        options = {group} if isinstance(group, str) else group
        if not options & set(df.columns):
            raise ValueError(f"missing column: {' or '.join(sorted(options))}")
