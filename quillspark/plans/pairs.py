"""Entry point: questions to preference pairs, in stages that can be resumed."""

from __future__ import annotations

import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import candidates, formats, judging, preference, prompts
from quillspark.plans.options import PairOptions
from quillspark.sources import files, scratch, sinks


def select_prompts(spark: SparkSession, o: PairOptions) -> DataFrame:
    """The frozen selection: reused if it exists, else sampled and written."""
    path = f"{o.output_dir}/selected_prompts.jsonl"
    if o.overwrite_selection or not files.exists(spark, path):
        rows = files.with_position(files.read_source(spark, o.input))
        rows = prompts.require_rows(prompts.require_unique(prompts.normalise(rows)), "the source")
        sinks.replace_jsonl(prompts.stratified_sample(rows, "role", "prompt_id", o.limit, o.seed), path)
    return files.read_jsonl(spark, path, schemas.PROMPT)


def generate(spark: SparkSession, selected: DataFrame, o: PairOptions, model=candidates.stand_in_answer) -> None:
    """Append the references and samples that the log lacks."""
    path = o.candidates_path or f"{o.output_dir}/candidates.jsonl"
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at_utc")
    done = files.read_jsonl(spark, path, schemas.CANDIDATE)
    fresh = candidates.references(selected, done)
    todo = candidates.pending(selected, candidates.temperature_table(spark, o.temperatures), done, o.seed)
    samples = candidates.generate(todo, model, o.top_p, o.repetition_penalty)
    both = candidates.merge_logs(fresh, samples).select("*", now)
    sinks.append_jsonl(both.select(*[f.name for f in schemas.CANDIDATE.fields if f.name in both.columns]), path)


def score(spark: SparkSession, o: PairOptions, judge=None) -> None:
    """Append scores of the candidates that the scored log lacks."""
    log = files.read_jsonl(spark, o.candidates_path or f"{o.output_dir}/candidates.jsonl", schemas.CANDIDATE)
    path = o.scored_path or f"{o.output_dir}/scored_candidates.jsonl"
    todo = judging.unscored(log, files.read_jsonl(spark, path, schemas.SCORED))
    if todo.isEmpty():
        return
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    sinks.append_jsonl(judging.score(todo, judge, o.judge_model).withColumn("scored_at_utc", now), path)


def candidates_of(scored: DataFrame) -> DataFrame:
    """Scored log rows in the shape pair selection takes; keys once."""
    whole = F.struct(*[c for c in scored.columns if c not in ("prompt_id", "candidate_id")])
    first = F.struct(*(F.col(c) for c in ("scored_at_utc", "answer", "judge_reward") if c in scored.columns))
    rows = scored.groupBy("prompt_id", "candidate_id").agg(F.min_by(whole, first).alias("r")).select("prompt_id", "candidate_id", "r.*")
    place = F.struct((F.col("candidate_source") != "sft_reference").alias("a"), F.try_to_number(F.regexp_extract("candidate_id", r"_(\d+)$", 1), F.lit("999999999")).cast("int").alias("b"), F.col("candidate_id").alias("c"))
    return rows.select(
        "prompt_id", place.alias("pos"), (F.col("candidate_source") == "sft_reference").alias("is_ref"), "answer", F.col("judge_reward").alias("reward"), "temperature", "candidate_id"
    )


def build(spark: SparkSession, selected: DataFrame, o: PairOptions) -> dict:
    """Pairs, training file, audit sheet and reports from the scored log; all replaced."""
    scored = prompts.require_rows(files.read_jsonl(spark, o.scored_path or f"{o.output_dir}/scored_candidates.jsonl", schemas.SCORED), "the scored log")
    rows = candidates_of(scored)
    unique = scratch.cut(preference.deduplicate(preference.viable(rows, o.min_answer_chars, o.max_answer_chars).drop("answer")))
    pairs = preference.select_pairs(unique, o.min_margin, o.max_margin, o.sample_chosen_fallback)
    results = preference.with_answers(preference.outcomes(selected, unique, pairs), rows, "answer")
    out = o.output_dir
    sinks.replace_jsonl(preference.records(results, o.judge_model), f"{out}/preference_pairs.jsonl")
    kept = files.read_jsonl(spark, f"{out}/preference_pairs.jsonl", schemas.PAIR)
    sinks.write_json_array(formats.dpo_rows(kept), f"{out}/preference_pairs_llamafactory.json")
    sinks.write_json_document(spark, f"{out}/dataset_info.json", formats.DPO_ENTRY)
    sinks.write_csv(preference.audit(kept), f"{out}/manual_audit.csv", single=True)
    selection = {"min_answer_chars": o.min_answer_chars, "max_answer_chars": o.max_answer_chars, "min_margin": o.min_margin, "max_margin": o.max_margin, "sample_chosen_fallback": o.sample_chosen_fallback}
    report = preference.report(results, kept, scored.count(), selection)
    sinks.write_json_document(spark, f"{out}/data_quality_report.json", report)
    items = [("Selected prompts", report["selected_prompts"]), ("Scored candidates", report["scored_candidates"]), ("Pairs kept", f"{report['preference_pairs']} ({report['retention_rate']:.1%})"), ("Skipped", report["skipped"]), ("Margins", report["judge_margin"])]
    sinks.write_text(spark, f"{out}/data_quality_report.md", sinks.markdown("Preference data quality", items, ["Audit a stratified sample of manual_audit.csv before training on the pairs."]))
    return report


def run(spark: SparkSession, o: PairOptions, model=candidates.stand_in_answer, judge=None) -> dict | None:
    """The stages that ``o.stage`` names."""
    selected = select_prompts(spark, o)
    versions = {"spark": spark.version, "python": platform.python_version()}
    manifest = dict(o.__dict__) | {"selected_prompts": selected.count(), "written_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "versions": versions}
    sinks.write_json_document(spark, f"{o.output_dir}/run_manifest.json", manifest)
    if o.stage in ("all", "generate"):
        generate(spark, selected, o, model)
    if o.stage in ("all", "score"):
        score(spark, o, judge)
    return build(spark, selected, o) if o.stage in ("all", "build") else None
