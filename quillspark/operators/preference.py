"""Preference pairs: viable answers, exact deduplication, hard negatives, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark import schemas
from quillspark.functions import grams
from quillspark.functions import text as T
from quillspark.sources import scratch

#: Names of the reasons and of the policy.
TOO_FEW, NO_NEGATIVE = "fewer_than_two_viable_answers", "no_hard_negative_in_margin_band"
POLICY = "reference_first_then_top_sample_hard_negative"


def unflagged(rows: DataFrame, text: str = "answer", min_chars: int = 80, max_chars: int = 700, repeats: int = 4) -> DataFrame:
    """Rows whose text has no quality flag, with the compacted text ``_c``.

    One pass over the texts in Arrow. Length is tested first, so only texts inside the band are
    searched for repeats. Columns that cost something and are not needed here (a reward of the
    text) are better added to what is left.
    """
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, kept = grams.unflagged(batch.column(at), min_chars, max_chars, repeats)
            if len(places):
                chosen = pa.array(places)
                yield pa.RecordBatch.from_arrays([*(c.take(chosen) for c in batch.columns), kept.cast(batch.column(at).type)], names=[*batch.schema.names, "_c"])

    return rows.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), StructField("_c", StringType())]))


def viable(scored: DataFrame, min_chars: int = 80, max_chars: int = 700) -> DataFrame:
    """Answers with a reward and no quality flag, with their compacted text.

    ``scored`` needs prompt_id, pos, is_ref, answer and reward. Duplicates have equal flags, so
    the filter may come before deduplication.
    """
    return rewarded(unflagged(scored, "answer", min_chars, max_chars))


def rewarded(rows: DataFrame) -> DataFrame:
    """Rows with a reward."""
    return rows.where(F.col("reward").isNotNull() & ~F.isnan("reward"))


def deduplicate(rows: DataFrame) -> DataFrame:
    """One row for each prompt and compacted text: the reference, else the highest reward, else the first.

    Texts are told apart by a 128-bit hash: pass rows without their texts (see
    :func:`with_answers`) and none is shuffled. ``gpos`` is the place of the group's first
    member, whichever survives. A group is aggregated, not collected: two minima by key,
    combined before the shuffle.
    """
    others = [c for c in rows.columns if c not in ("prompt_id", "_c")]
    best = F.struct((~F.col("is_ref")).cast("int").alias("o1"), (-F.col("reward")).alias("o2"), F.col("pos").alias("o3"))
    kept = rows.groupBy("prompt_id", F.md5(F.col("_c").cast("binary")).alias("_h")).agg(F.min("pos").alias("gpos"), F.min_by(F.struct(*others), best).alias("_r"))
    return kept.select("prompt_id", "gpos", *(F.col(f"_r.{c}").alias(c) for c in others))


#: Rewards nearer than this to the edge of a band are settled by the difference itself.
EDGE = 1e-9


def select_pairs(unique: DataFrame, min_margin: float = 0.5, max_margin: float = 8.0, fallback: bool = True) -> DataFrame:
    """The pair of each prompt: chosen and rejected as structs, and the margin.

    The first chosen wins that has a rejected in the band: the reference, then (with
    ``fallback``) by reward. Its rejected has the least margin, the first of equals.
    Of answers with equal rewards only the first can be chosen, so a prompt's rows are
    first reduced to one for each reward, before the shuffle too. An as-of pass over the
    rewards finds the nearest below: work is that of one sort of a prompt's rewards, not of
    its pairs. Whether a margin is in the band is asked of the difference of the two
    rewards; those within :data:`EDGE` of the lower edge are looked at one by one. The
    rejected itself is looked up at the end, for one chosen a prompt.
    """
    row = F.struct(*[c for c in unique.columns if c != "prompt_id"])
    ref = F.when(F.col("is_ref"), row)
    firsts = unique.groupBy("prompt_id", "reward").agg(F.min_by(row, "gpos").alias("row"), F.min_by(ref, F.when(F.col("is_ref"), F.col("gpos"))).alias("ref"), F.count("*").alias("n"))
    asking = firsts.where("ref IS NOT NULL").select("prompt_id", "reward", F.col("ref").alias("row"), "n")
    if fallback:
        asking = asking.unionByName(firsts.drop("ref"))
    answers = firsts.select("prompt_id", F.col("reward").alias("at"), "reward", F.lit(0).alias("kind"), F.lit(None).cast(firsts.schema["row"].dataType).alias("row"), "n")
    points = asking.select("prompt_id", (F.col("reward") - F.lit(min_margin) + F.lit(EDGE)).alias("at"), "reward", F.lit(1).alias("kind"), "row", "n")
    over = "OVER (PARTITION BY prompt_id ORDER BY at RANGE BETWEEN {} PRECEDING AND {})"
    answer, width = "CASE WHEN kind = 0 THEN reward END", f"CAST({2 * EDGE} AS DOUBLE)"
    found = answers.unionByName(points)
    found = found.withColumn("_below", F.expr(f"last({answer}, true) " + over.format("UNBOUNDED", f"{width} PRECEDING")))
    found = found.withColumn("_edge", F.expr(f"collect_list({answer}) " + over.format(width, "CURRENT ROW"))).where("kind = 1")
    near = F.filter(F.transform("_edge", lambda x: F.when(x < F.col("reward"), F.col("reward") - x)), lambda m: m >= min_margin)
    margin = F.coalesce(F.array_min(near), F.col("reward") - F.col("_below"))
    if min_margin <= 0:
        margin = F.when(F.col("n") > 1, 0.0).otherwise(margin)
    found = found.select("prompt_id", F.col("row").alias("chosen"), margin.alias("margin")).where(F.col("margin").between(min_margin, max_margin))
    first = F.struct((~F.col("chosen.is_ref")).cast("int"), -F.col("chosen.reward"), F.col("chosen.gpos"))
    best = found.groupBy("prompt_id").agg(F.min_by(F.struct("chosen", "margin"), first).alias("p")).select("prompt_id", "p.*")
    met = best.join(unique.select("prompt_id", row.alias("_o")), "prompt_id")
    met = met.where((F.col("chosen.reward") - F.col("_o.reward") == F.col("margin")) & (F.col("_o.gpos") != F.col("chosen.gpos")))
    return met.groupBy("prompt_id").agg(F.first("chosen").alias("chosen"), F.min_by("_o", "_o.gpos").alias("rejected"), F.first("margin").alias("margin"))


def with_answers(found: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs whose two sides get ``columns`` of the rows of the same prompt and place.

    The rows that a pair names are taken out first, in one pass; while the pairs are few, they go
    to the rows and no text is shuffled.
    """
    found = scratch.cut(found)
    sides = F.explode(F.array("chosen.pos", "rejected.pos"))
    wanted = found.select("prompt_id", sides.alias("pos")).where("pos IS NOT NULL").distinct()
    rows = scratch.cut(rows.select("prompt_id", "pos", *columns).join(scratch.few(wanted), ["prompt_id", "pos"]))
    for side in ("chosen", "rejected"):
        more = rows.select(F.col("prompt_id").alias("_p"), F.col("pos").alias("_s"), *(F.col(c).alias(f"_{c}") for c in columns))
        met = found.join(more, (F.col("prompt_id") == F.col("_p")) & (F.col(f"{side}.pos") == F.col("_s")), "left")
        met = met.withColumn(side, F.when(F.col(side).isNotNull(), F.struct(f"{side}.*", *(F.col(f"_{c}").alias(c) for c in columns))))
        found = met.drop("_p", "_s", *(f"_{c}" for c in columns))
    return found


def outcomes(prompts: DataFrame, unique: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each prompt with its viable answers counted and, without a pair, the reason."""
    counts = unique.groupBy("prompt_id").agg(F.count("*").alias("viable"))
    joined = prompts.join(counts, "prompt_id", "left").join(pairs, "prompt_id", "left")
    joined = joined.withColumn("viable", F.coalesce("viable", F.lit(0).cast("bigint")))
    reason = F.when(F.col("margin").isNotNull(), F.lit(None).cast("string")).when(F.col("viable") < 2, TOO_FEW).otherwise(NO_NEGATIVE)
    return joined.withColumn("reason", reason)


def records(results: DataFrame, judge_model: str = "stand-in") -> DataFrame:
    """Outcomes with a pair as preference records of 20 fields."""
    get = lambda c: F.col(c) if c in results.columns else F.lit("").alias(c)
    part = lambda side, c, kind: F.col(f"{side}.{c}") if c in results.schema[side].dataType.names else F.lit(None).cast(kind)
    source = F.when(F.col("chosen.is_ref"), "sft_reference").otherwise("sft_sample")
    message = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    out = results.where("margin IS NOT NULL").select(
        "prompt_id",
        *(get(c).alias(c) for c in ("role", "category", "skill", "difficulty", "question_type", "source_type")),
        "question",
        F.array(message).alias("prompt"),
        F.col("chosen.answer").alias("chosen"),
        F.col("rejected.answer").alias("rejected"),
        source.alias("chosen_source"),
        part("chosen", "temperature", "double").alias("chosen_temperature"),
        F.col("chosen.reward").alias("chosen_reward"),
        part("rejected", "temperature", "double").alias("rejected_temperature"),
        F.col("rejected.reward").alias("rejected_reward"),
        F.col("margin").alias("judge_margin"),
        F.col("viable").alias("viable_candidate_count"),
        F.lit(judge_model).alias("judge_model"),
        F.lit(POLICY).alias("selection_policy"),
    )
    return out


def clean_candidates(candidates: DataFrame, min_chars: int = 80, max_chars: int = 700) -> DataFrame:
    """Candidates with one row a key and no quality flag (inferred from published counts)."""
    ok = candidates.where(F.size(T.quality_flags(F.col("answer"), min_chars, max_chars, whole=True)) == 0)
    return ok.dropDuplicates(["prompt_id", "candidate_id"])


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def count_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Counts by key as one map with sorted keys."""
    pairs = counts_by(rows.where(F.col(key).isNotNull()), key)
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def statistics(rows: DataFrame, value: str | Column, digits: int = 4) -> DataFrame:
    """Count, mean, median, p10, p90, min and max; of nothing only the count."""
    v = F.col(value) if isinstance(value, str) else value
    near = lambda q: F.round(F.percentile(v, q), digits)
    return rows.agg(
        F.count(v).alias("count"), F.round(F.avg(v), digits).alias("mean"), near(0.5).alias("median"), near(0.1).alias("p10"), near(0.9).alias("p90"),
        F.round(F.min(v), digits).alias("min"), F.round(F.max(v), digits).alias("max"),
    )


def retention(results: DataFrame) -> DataFrame:
    """Prompts, pairs and their ratio (0 without prompts)."""
    n, k = F.count("*"), F.count("margin")
    return results.agg(n.alias("selected_prompts"), k.alias("preference_pairs"), F.when(n == 0, 0.0).otherwise(F.round(k / n, 4)).alias("retention_rate"))


def report(results: DataFrame, pairs: DataFrame, n_scored: int, options: dict) -> dict:
    """The data-quality report: a handful of aggregates, each a row."""
    counts = lambda rows, key: {r[0]: r[1] for r in sorted(counts_by(rows.where(F.col(key).isNotNull()), key).collect())}
    size = retention(results).first().asDict()
    stats = statistics(pairs, "judge_margin").first().asDict()
    return {
        **size,
        "scored_candidates": n_scored,
        "selection": options,
        "role_counts": counts(pairs, "role"),
        "chosen_source_counts": counts(pairs, "chosen_source"),
        "skipped": counts(results, "reason"),
        "judge_margin": stats if stats["count"] else {"count": 0},
    }


def audit(pairs: DataFrame) -> DataFrame:
    """The 14 columns of the audit sheet."""
    return pairs.select(*schemas.AUDIT)
