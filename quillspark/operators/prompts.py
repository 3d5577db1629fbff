"""Prompts: normalisation, checks, stratified sampling, filling of missing answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as T

#: Fewest characters of a stripped answer that counts as given.
MIN_ANSWER = 50


def normalise(rows: DataFrame) -> DataFrame:
    """Source rows to prompts: aliases, defaults, ids; rows without question or answer go.

    ``rows`` needs ``source_row``. An empty value falls through to its alias or default, a
    blank one does not.
    """
    schemas.require_columns(rows, {"question", "instruction"}, {"answer", "output"}, "source_row")
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    either = lambda a, b: T.strip(T.first_filled(get(a), get(b)))
    default = lambda c, d: F.coalesce(F.nullif(get(c).cast("string"), F.lit("")), F.lit(d)).alias(c)
    base = rows.withColumn("_q", either("question", "instruction")).withColumn("_a", either("answer", "output"))
    base = base.where("_q <> '' AND _a <> ''")
    return base.select(
        F.coalesce(F.nullif(get("id").cast("string"), F.lit("")), T.stable_id("prompt", F.col("_q"))).alias("prompt_id"),
        F.col("_q").alias("question"),
        F.col("_a").alias("reference_answer"),
        default("role", "unknown"),
        *(default(c, "") for c in ("category", "skill", "question_type", "difficulty", "seniority")),
        default("source_type", "unknown"),
        F.col("source_row").cast("int").alias("source_row"),
    )


def duplicate_ids(prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Keys that stand more than once."""
    return prompts.groupBy(key).count().where("count > 1")


def require_unique(prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Fail on the first duplicate key, else return the input."""
    if found := duplicate_ids(prompts, key).limit(1).collect():
        raise ValueError(f"duplicate {key}: {found[0][0]}")
    return prompts


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def stratified_sample(rows: DataFrame, stratum: str, key: str, limit: int, seed: int) -> DataFrame:
    """Round robin over the strata in order, each in the order of a seeded hash; 0 or a large limit: all. By key.

    Hash order stands in for a shuffled list. At most ``limit`` rows of a stratum can be
    taken, and the rank filter keeps only those before rows meet.
    """
    if limit <= 0:
        return rows.orderBy(key)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    ranked = rows.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    return ranked.orderBy("_turn", F.col(stratum).asc_nulls_last(), order).limit(limit).drop("_turn").orderBy(key)


def answered(answer: Column) -> Column:
    return F.coalesce(F.length(T.strip(answer)) >= MIN_ANSWER, F.lit(False))


def fill_key(rows: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.col("question"))


def preserved(source: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(key, answer)``: the source's own answers first, earlier output fills gaps."""
    part = lambda df, k: df.where(answered(F.col("answer"))).select(fill_key(df).alias("key"), F.col("answer"), F.lit(k).alias("_k"))
    both = part(source, 0).unionByName(part(earlier, 1))
    return both.groupBy("key").agg(F.min_by("answer", F.struct("_k", "answer")).alias("answer"))


def pending(source: DataFrame, earlier: DataFrame, limit: int = 0, order: str | None = None) -> DataFrame:
    """Source rows without an answer anywhere, in source order up to ``limit`` (0: all)."""
    todo = source.withColumn("_key", fill_key(source)).join(preserved(source, earlier).withColumnRenamed("key", "_key").select("_key"), "_key", "left_anti").drop("_key")
    return todo.orderBy(order).limit(limit) if limit and order else todo


def filled(source: DataFrame, earlier: DataFrame) -> DataFrame:
    """Every source row with its preserved answer, or a null answer and status ``pending``."""
    have = preserved(source, earlier).withColumnRenamed("answer", "_answer").withColumnRenamed("key", "_key")
    joined = source.withColumn("_key", fill_key(source)).join(have, "_key", "left")
    status = F.when(F.col("_answer").isNotNull(), "answered").otherwise("pending")
    return joined.withColumn("answer", F.col("_answer")).withColumn("status", status).drop("_key", "_answer")
