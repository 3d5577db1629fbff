"""Evaluation statistics: lengths, repetition, paired rewards, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import files

TIE = 1e-6
RESAMPLES = 5000
#: The published length bands.
BANDS = {"in_150_300": (150, 300), "in_150_450": (150, 450), "upto_550": (0, 550)}


def length_summary(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Mean, median, p90 and longest length in characters, of the raw text; nothing: nulls."""
    n = F.length(text)
    return rows.groupBy(*by).agg(
        F.round(F.avg(n), 2).alias("mean_chars"), F.round(F.percentile(n, 0.5), 2).alias("median_chars"), F.round(F.percentile(n, 0.9), 2).alias("p90_chars"), F.max(n).alias("max_chars"),
    )


def length_bands(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Answers in each published band."""
    n = F.length(text)
    return rows.groupBy(*by).agg(F.count("*").alias("answers"), *(F.count_if(n.between(*b)).alias(name) for name, b in BANDS.items()))


def repetition(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Answers whose most frequent 5-gram stands 4 times (strong) or 8 times (extreme) or more."""
    k = rows.select(*by, T.max_ngram_count(F.col(text), whole=True).alias("k"))
    return k.groupBy(*by).agg(F.count("*").alias("answers"), F.count_if(F.col("k") >= 4).alias("strong"), F.count_if(F.col("k") >= 8).alias("extreme"))


def natural_endings(rows: DataFrame, text: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("answers"), F.count_if(T.ends_naturally(F.col(text))).alias("natural"))


def paired(rows: DataFrame, base: str = "rm_base", tuned: str = "rm_sft") -> DataFrame:
    """Means, mean difference, win and tie rate of paired scores."""
    d = F.col(tuned) - F.col(base)
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    return rows.agg(
        F.count("*").alias("pairs"), F.round(F.avg(base), 4).alias("base_mean"), F.round(F.avg(tuned), 4).alias("sft_mean"), F.round(F.avg(d), 4).alias("mean_delta"),
        rate(d > 0).alias("sft_win_rate"), rate(F.abs(d) <= TIE).alias("tie_rate"),
    )


def draw(n: Column, *seed: Column) -> Column:
    """A number from 1 to ``n`` out of an MD5: the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *seed)), 1, 8), 16, 10).cast("bigint") % n) + 1


def bootstrap(pairs: DataFrame, order: str, delta: str, seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """95 % intervals of the mean difference and win rate over resampled pairs.

    Hash draws replace a random generator, so both engines agree. The evaluation set is
    numbered (it is small by its nature), and each resample is a partial sum by its number.
    """
    spark = pairs.sparkSession
    numbered = files.in_order(pairs.select(F.col(order).alias("o"), F.col(delta).alias("d")), "o", name="i").select((F.col("i") + 1).alias("i"), "d")
    n = numbered.agg(F.count("*").cast("int").alias("n")).where("n > 0")  # one row
    slots = spark.range(resamples).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n)).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
    index = draw(F.col("n"), F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string"))
    drawn = slots.select("rep", index.cast("int").alias("i")).join(numbered, "i")
    reps = drawn.groupBy("rep").agg(F.avg("d").alias("m"), F.avg((F.col("d") > 0).cast("double")).alias("w"))
    near = lambda c, q: F.round(F.percentile(c, q), 4)
    return reps.agg(
        near("m", 0.025).alias("mean_delta_ci95_low"), near("m", 0.975).alias("mean_delta_ci95_high"), near("w", 0.025).alias("win_rate_ci95_low"), near("w", 0.975).alias("win_rate_ci95_high"),
    )


def missing_fields(rows: DataFrame, *fields: str) -> DataFrame:
    """``(field, missing)``: how many rows lack each field."""
    counts = rows.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields))).alias("r")).select("r.*")


def require_fields(rows: DataFrame, *fields: str) -> DataFrame:
    """Fail unless every row has every field."""
    missing = [f for f in fields if f not in rows.columns]
    if missing:
        raise ValueError(f"missing field: {', '.join(missing)}")
    bad = rows.agg(*(F.bool_and(F.col(f).isNotNull()).alias(f) for f in fields)).first()
    if empty := [f for f in fields if bad[f] is False]:
        raise ValueError(f"rows without: {', '.join(empty)}")
    return rows


def question_points(rows: DataFrame) -> DataFrame:
    """Evaluation rows with the expected points as JSON text; the prompt holds the question alone."""
    return rows.withColumn("expected_points_json", F.to_json("expected_points")).withColumn("prompt", T.chatml(F.col("question"))).drop("expected_points")


def comparison_rows(rows: DataFrame, base: Column, tuned: Column) -> DataFrame:
    """Evaluation rows with the answers of two models side by side."""
    return rows.select("id", "role", "difficulty", "question_type", "question", "expected_points_json", base.alias("base_answer"), tuned.alias("sft_answer"))


def staged_answers(run: DataFrame, model: Column, score: Column) -> DataFrame:
    """A demo run's rows with answers where a trained stage has a question, and their scores and buckets."""
    answer = F.when(F.col("to_score"), model).otherwise(F.col("answer"))
    out = run.withColumn("answer", answer).withColumn("score", F.when(F.col("to_score"), score))
    return out.withColumn("bucket", T.score_bucket(F.col("score"))).withColumn("score_text", T.score_text(F.col("score")))


def staged_run(questions: DataFrame, stages: DataFrame) -> DataFrame:
    """Question x stage rows of a demo run; blank questions and untrained stages have no score to come."""
    rows = questions.crossJoin(F.broadcast(stages))
    blank = T.strip(F.col("question")) == ""
    answer = F.when(blank, "").when(F.col("adapter") == "not_trained", F.lit("[not trained]")).otherwise(F.lit(None).cast("string"))
    return rows.withColumn("answer", answer).withColumn("to_score", ~blank & (F.col("adapter") != "not_trained"))
