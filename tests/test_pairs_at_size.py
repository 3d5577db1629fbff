"""Pair queries: one pass over the texts, rewards of what is left, answers without a shuffle of texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import judging, preference
from quillspark.plans import registry
from quillspark.sources import files, scratch, sinks


@pytest.fixture
def nothing_small(spark):
    """No table counts as small by its size in bytes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Answers inside the band, repeated ones, long ones, empty ones and none, of three prompts."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz潮汐", k=5)) for _ in range(n // 5))
    texts = [text(n) for n in (20, 80, 90, 300, 690, 705, 2000) for _ in range(6)] + ["xyz" * 50, "", None, " \n"]
    texts += [t.replace(" ", "\n  ") for t in texts[12:20]]
    rows = [(i, t, f"p{i % 3}") for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("pairs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def short_only(text):
    """The stand-in's reward, which refuses texts that have a flag by their length."""
    return F.when(F.length(T.compact(text)).between(80, 700), judging.stand_in_reward(text)).otherwise(F.raise_error(F.lit("a flagged text was scored")).cast("double"))


def pairs_of(spark, d, fallback=True):
    return preference.select_pairs(registry.unique(spark, d), fallback=fallback)


def test_no_task_has_a_whole_report(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").withColumns({"task": F.spark_partition_id(), "a,b": F.lit('x "y"\n ')})
    sinks.write_csv(rows, str(tmp_path / "r.csv"), single=True)
    sinks.write_csv(rows, str(tmp_path / "r.csv"), single=True)  # replaced, not added to
    assert len(list((tmp_path / "r.csv").glob("part-*"))) == 1
    got = files.read_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [int(r.id) for r in got] == list(range(1000))
    assert len({r.task for r in got}) > 1
    assert {r["a,b"] for r in got} == {'x "y"\n '}
    sinks.write_csv(rows.limit(0), str(tmp_path / "none.csv"), single=True)
    none = files.read_csv(spark, str(tmp_path / "none.csv"))
    assert (none.columns, none.count()) == (["id", "task", "a,b"], 0)


def test_a_log_is_replaced_by_records_worked_out_once(spark, tables, monkeypatch):
    asked, real = [], registry.results
    monkeypatch.setattr(registry, "results", lambda *a, **b: asked.append(1) or real(*a, **b))
    assert registry.preference_log_replaced(spark, tables).count() == 3
    assert len(asked) == 1


def test_viable_answers_are_found_in_one_pass(spark, tables):
    found = registry.viable_documents(spark, tables)
    above, below = found._jdf.queryExecution().optimizedPlan().toString().lower().split("mapinarrow")
    assert "md5" in above
    assert "md5" not in below
    assert "regexp_replace" not in below
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    c = T.compact(F.col("text"))
    plain = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").where(F.length(c).between(80, 700) & (T.max_ngram_count(c) < 4) & ~T.has_repeated_span(c))
    want = {(r.doc_id, r.reward) for r in plain.select("doc_id", judging.stand_in_reward(F.col("text")).alias("reward")).collect()}
    assert {(r.doc_id, r.reward) for r in found.collect()} == want
    assert len(want) == 32


def test_only_viable_answers_are_scored(spark, tables):
    assert registry.unique(spark, tables, short_only).count() == registry.dedup_preferred(spark, tables).count() > 0


def test_counts_score_only_viable_answers(spark, tables):
    rows = registry.results(spark, tables, reward=short_only).where("margin IS NOT NULL")
    assert preference.count_map(rows, "prompt_id", "n").first().n == {"p0": 1, "p1": 1, "p2": 1}


def test_pairs_go_to_the_answers(spark, tables, nothing_small):
    seen, real = [], scratch.cut
    try:
        scratch.cut = lambda df: seen.append(plan(df)) or real(df)
        found = preference.with_answers(pairs_of(spark, tables, False), registry.answers(spark, tables), "answer").collect()
    finally:
        scratch.cut = real
    assert [p for p in seen if "BroadcastHashJoin" in p and "answer" in p]
    assert all(r.chosen.answer and r.rejected.answer for r in found)


def test_margins_need_no_reward_of_flagged_answers(spark, tables):
    rows = registry.results(spark, tables, reward=short_only).where("margin IS NOT NULL")
    assert preference.statistics(rows, "margin").collect() == registry.pair_margin_stats(spark, tables).collect()


def test_answers_are_the_same_when_pairs_are_many(spark, tables, monkeypatch, nothing_small):
    few = sorted(registry.preference_pairs_decimal_no_fallback(spark, tables).collect())
    monkeypatch.setattr(scratch, "FEW", 0)
    assert sorted(registry.preference_pairs_decimal_no_fallback(spark, tables).collect()) == few
    assert few


def test_answers_are_taken_out_once(spark, tables):
    assert "documents.parquet" not in plan(registry.dpo_rows(spark, tables))  # only what pairs name is read again
    assert registry.dpo_rows(spark, tables).count() == 3


def test_source_counts_read_no_answers(spark, tables, monkeypatch):
    monkeypatch.setattr(preference, "with_answers", None)
    assert sum(r.n for r in registry.pair_source_counts(spark, tables).collect()) == 3
