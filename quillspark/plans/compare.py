"""Entry points: comparing two models, overlap audit, filling answers, conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as T
from quillspark.operators import candidates, evaluation, formats, overlap, prompts
from quillspark.plans.options import CompareOptions
from quillspark.sources import files, scratch, sinks


def compare(spark: SparkSession, o: CompareOptions, base, tuned, judge=None) -> dict:
    """Answers of two models ``questions -> texts`` side by side, with length and reward statistics.

    The models are pandas functions; they see the prompt, which never holds the rubric.
    """
    if files.exists(spark, f"{o.output_dir}/summary.json") and not o.overwrite:
        raise ValueError(f"{o.output_dir} holds results already; pass overwrite to replace them")
    rows = files.with_position(files.read_json_array(spark, o.eval_file, schemas.EVALUATION), "pos")
    rows = evaluation.require_fields(rows, "id", "role", "difficulty", "question_type", "question", "expected_points")
    if o.limit:
        rows = rows.orderBy("pos").limit(o.limit)
    rows = evaluation.question_points(rows)
    rows = rows.withColumn("base_answer", F.pandas_udf(base, "string")("prompt")).withColumn("sft_answer", F.pandas_udf(tuned, "string")("prompt"))
    if judge is not None:
        ask = F.pandas_udf(judge, "double")
        for name, answer in (("rm_base", "base_answer"), ("rm_sft", "sft_answer")):
            rows = rows.withColumn(name, ask(T.reward_input(F.col("question"), F.col(answer), o.rm_input_format or "question_answer")))
    out = f"{o.output_dir}/comparisons.parquet"
    rows.write.mode("overwrite").parquet(out)  # models answer once
    rows = spark.read.parquet(out)
    sinks.write_csv(rows.orderBy("pos").drop("pos"), f"{o.output_dir}/comparisons.csv", single=True)
    summary = {"questions": rows.count(), "max_new_tokens": o.max_new_tokens}
    for side in ("base", "sft"):
        summary[f"{side}_length"] = evaluation.length_summary(rows, f"{side}_answer").first().asDict()
    if judge is not None:
        scored = rows.withColumn("delta", F.col("rm_sft") - F.col("rm_base"))
        summary["reward"] = evaluation.paired(rows).first().asDict() | evaluation.bootstrap(scored, "pos", "delta", o.seed).first().asDict()
    sinks.write_json_document(spark, f"{o.output_dir}/summary.json", summary)
    sinks.write_text(spark, f"{o.output_dir}/summary.md", sinks.markdown("Base and tuned answers", summary.items()))
    return summary


def audit_overlap(spark: SparkSession, evaluation_rows: DataFrame, training_rows: DataFrame, path: str) -> DataFrame:
    """The overlap report of (key, text, role) rows, written as CSV; returns the flagged count. ``role`` may be absent."""
    found = scratch.cut(overlap.matches(overlap.gram_sets(evaluation_rows, "key", "text"), overlap.gram_sets(training_rows, "key", "text")))
    sinks.write_csv(overlap_report(found, evaluation_rows, training_rows).orderBy("eval_key", "rank"), path, single=True)
    return overlap.flagged_count(found)


def overlap_report(found: DataFrame, evaluation_rows: DataFrame, training_rows: DataFrame) -> DataFrame:
    """Matches with both texts and roles; the training texts are not shuffled to meet a few matches."""
    named = [c for c in found.columns if c not in ("train_key", "eval_key")]
    found = scratch.few(found)
    for side, rows in (("train", training_rows), ("eval", evaluation_rows)):
        role = F.col("role") if "role" in rows.columns else F.lit("")
        found = rows.select(F.col("key").alias(f"{side}_key"), role.alias(f"{side}_role"), F.col("text").alias(f"{side}_question")).join(found, f"{side}_key")
    return found.select("train_key", "eval_key", *named, "eval_role", "eval_question", "train_role", "train_question")


#: Answers asked for and written together.
ASKED_TOGETHER = 200


def fill(spark: SparkSession, source: str, earlier: str, out: str, client, limit: int = 0, log: str | None = None) -> DataFrame:
    """Missing answers from a completion client; every source row is written, with its status.

    Answers go to a log first, a few at a time, each batch whole before the next is asked:
    what a stopped run has paid for is there when it starts again. Nothing to ask and an
    earlier file present: that file stays as it is.
    """
    rows = files.with_position(files.read_csv(spark, source, schemas.QUESTION))
    done = scratch.cut(files.read_csv(spark, earlier, schemas.QUESTION)) if files.exists(spark, earlier) else spark.createDataFrame([], schemas.QUESTION)
    log = log or f"{out}.answers"
    logged = lambda: files.read_jsonl(spark, log, schemas.ANSWER)
    given = lambda: logged().where("answer IS NOT NULL")
    todo = prompts.pending(rows, done, limit, "source_row").withColumn("key", prompts.fill_key(rows)).dropDuplicates(["key"])
    todo = todo.join(given().select("key").distinct(), "key", "left_anti")
    n = todo.count()
    if not n and files.exists(spark, out) and not files.exists(spark, log):
        return files.read_csv(spark, out)
    asked = todo.withColumn("prompt", T.fill_prompt(F.col("question"), F.col("interview_intent"), F.col("expected_points")))
    n_batches = -(-n // ASKED_TOGETHER)
    if n:
        frozen = scratch.cut(asked.withColumn("_batch", F.pmod(F.xxhash64("key"), F.lit(n_batches))))
        for k in range(n_batches):
            answers = candidates.complete(frozen.where(F.col("_batch") == k), client)
            sinks.append_jsonl(answers.select("key", "answer", "error"), log)
    new = given().groupBy("key").agg(F.min("answer").alias("_new")).withColumnRenamed("key", "_key")
    all_rows = prompts.filled(rows, done).withColumn("_key", prompts.fill_key(rows)).join(new, "_key", "left")
    status = F.when(F.col("answer").isNull() & F.col("_new").isNotNull(), "generated").otherwise(F.col("status"))
    final = all_rows.withColumn("status", status).withColumn("answer", F.coalesce("answer", "_new")).drop("_new", "_key")
    sinks.write_csv(final.orderBy("source_row"), out, single=True)
    return files.read_csv(spark, out)


def convert(spark: SparkSession, source: str, out_dir: str, system: str | None = None) -> None:
    """Filled answers to the SFT training file and its registry entry."""
    rows = files.with_position(files.read_csv(spark, source, schemas.QUESTION))
    sinks.write_json_array(formats.sft_rows(rows.orderBy("source_row"), system=system), f"{out_dir}/sft_train.json")
    sinks.write_json_document(spark, f"{out_dir}/dataset_info.json", formats.SFT_ENTRY)


def register(spark: SparkSession, path: str, entry: dict = formats.SFT_ENTRY) -> dict:
    """Add entries to a registry file; present ones stay."""
    existing = files.read_registry(spark, path) if files.exists(spark, path) else {}
    merged = formats.merge_registry(existing, entry)
    if merged != existing:
        sinks.write_json_document(spark, path, merged)
    return merged
