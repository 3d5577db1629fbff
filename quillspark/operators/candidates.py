"""Candidate answers: expansion over temperatures, resumable generation, merging of logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed value: the default sampling temperatures.
TEMPERATURES = (0.3, 0.5, 0.7, 0.9, 1.1)


def parse_temperatures(text: str) -> list[float]:
    """A comma-separated list of positive numbers."""
    values = [float(x) for x in text.split(",") if x.strip()]
    if not values or min(values) <= 0:
        raise ValueError("temperatures must be positive and at least one")
    return values


def temperature_table(spark, temperatures=TEMPERATURES) -> DataFrame:
    """One row for each temperature: its place, value and candidate id; equal ids once."""
    rows = [(i, float(t), f"sample_t{t:g}_{i}") for i, t in enumerate(temperatures)]
    return spark.createDataFrame(rows, "candidate_index int, temperature double, candidate_id string")


def references(prompts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each prompt's own answer as a candidate, unless the log has it."""
    rows = prompts.select(
        "*",
        F.lit("reference").alias("candidate_id"),
        F.lit("sft_reference").alias("candidate_source"),
        F.col("reference_answer").alias("answer"),
        F.lit(None).cast("double").alias("temperature"),
        F.lit(None).cast("bigint").alias("generation_seed"),
        F.lit(None).cast("string").alias("generation_prompt"),
    )
    return rows if done is None else rows.join(done.select("prompt_id", "candidate_id"), ["prompt_id", "candidate_id"], "left_anti")


def pending(prompts: DataFrame, temperatures: DataFrame, done: DataFrame | None, seed: int) -> DataFrame:
    """Prompt x temperature pairs that the log lacks, with their derived seeds.

    The temperature table is a handful of literals, so the product is a broadcast.
    """
    rows = prompts.crossJoin(F.broadcast(temperatures))
    if done is not None:
        rows = rows.join(done.select("prompt_id", "candidate_id"), ["prompt_id", "candidate_id"], "left_anti")
    return rows.withColumn("generation_seed", F.lit(seed).cast("bigint") + F.col("source_row").cast("bigint") * 100 + F.col("candidate_index"))


def stand_in_answer(questions: pd.Series, temperature: pd.Series) -> pd.Series:
    """Deterministic text in place of a model; it says nothing about quality."""
    return questions.str.cat(temperature.map("{:g}".format), sep=" @")


def generate(rows: DataFrame, model: Callable[[pd.Series, pd.Series], pd.Series] = stand_in_answer, top_p: float = 0.9, repetition_penalty: float = 1.08) -> DataFrame:
    """Answers from a batch model ``(questions, temperatures) -> texts``; Arrow batches are its batches."""
    answer = F.pandas_udf(_typed(model), "string")
    return rows.select(
        *[c for c in rows.columns if c != "candidate_index"],
        F.lit("sft_sample").alias("candidate_source"),
        answer("question", "temperature").alias("answer"),
        F.lit(top_p).alias("top_p"),
        F.lit(repetition_penalty).alias("repetition_penalty"),
        F.col("question").alias("generation_prompt"),
    )


def _typed(model):
    def run(questions: pd.Series, temperatures: pd.Series) -> pd.Series:
        return model(questions, temperatures)

    return run


def merge_logs(*logs: DataFrame) -> DataFrame:
    """References and samples in one log; columns that one lacks are null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


#: Characters of a failed row's error that are kept.
ERROR_CHARS = 200


def complete(rows: DataFrame, client: Callable[[], Callable[[str], str]], prompt: str = "prompt", tries: int = 3, pause: float = 5.0) -> DataFrame:
    """Answers from a remote completion service, with the error where it fails ``tries`` times.

    ``client`` is called once for each partition. Repeats happen inside the call; a failed
    row keeps a null answer and the start of the error, so one bad row costs no other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            answers, errors = [], []
            for text in batch[prompt]:
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = ask(text).strip(), None
                        break
                    except Exception as e:  # noqa: BLE001 - the row carries it
                        error = str(e)[:ERROR_CHARS]
                        if k + 1 < tries:
                            time.sleep(pause)
                answers.append(answer)
                errors.append(error)
            yield batch.assign(answer=answers, error=errors)

    kept = rows.drop("answer", "error")
    schema = StructType([*kept.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    return kept.mapInPandas(run, schema)


#: Completion services by name, base address and model.
PROVIDERS = {
    "deepseek": ("https://api.deepseek.com", "deepseek-chat"),
    "qwen": ("https://dashscope.aliyuncs.com/compatible-mode", "qwen-plus"),
    "moonshot": ("https://api.moonshot.cn", "moonshot-v1-8k"),
    "ollama": ("http://localhost:11434", "llama3.1:8b"),
}
#: How answers are sampled, and seconds until a call is given up.
SAMPLING, TIMEOUT = {"temperature": 0.45, "top_p": 0.9, "max_tokens": 500}, 60


def chat_client(provider: str, key: str = "", system: str = "", timeout: float = TIMEOUT) -> Callable[[], Callable[[str], str]]:
    """A client for :func:`complete` that speaks the chat completion protocol of a service."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}; one of {', '.join(PROVIDERS)}")
    if not key and provider != "ollama":
        raise ValueError(f"{provider} needs a key")
    base, model = PROVIDERS[provider]

    def connect() -> Callable[[str], str]:
        import json
        from urllib.request import Request, urlopen

        def ask(text: str) -> str:
            turns = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": text}]
            body = json.dumps({"model": model, "messages": turns, **SAMPLING}).encode()
            request = Request(f"{base}/v1/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return ask

    return connect
