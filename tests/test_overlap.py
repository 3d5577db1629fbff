"""The overlap pool and what follows it: against plain Python, what a task holds and what is shuffled."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillspark.operators import overlap
from quillspark.plans import compare
from quillspark.sources import scratch


def grams(x):
    x = "".join(c for c in x if c.isascii() and c.isalnum() or "一" <= c <= "鿿").lower()
    return {x[i : i + 3] for i in range(len(x) - 2)} if len(x) >= 3 else ({x} if x else set())


def plain_pool(tests, train, most):
    t = [(k, grams(x)) for k, x in train]
    for key, text in tests:
        e = grams(text)
        best = sorted((-(len(e & g) / max(1, len(e | g))), k) for k, g in t)[:most]
        yield from ((key, k, -j, rank) for rank, (j, k) in enumerate(best, 1))


def sides(spark, n=400):
    rng = random.Random(7)
    words = ["tide", "time", "diet", "edit", "die", "潮汐", "Tied", "x", "!?"]
    text = lambda: " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 9, 30, 200])))
    train, tests = [(i, text()) for i in range(n)], [(i, text()) for i in range(7)]
    frame = lambda rows: overlap.gram_sets(spark.createDataFrame(rows, "key int, text string"), "key", "text")
    return tests, train, frame(tests), frame(train)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pool_hands_on_no_sets_and_loses_no_row(spark):
    tests, train, e, t = sides(spark)
    found = overlap.pool(e, t, 3)
    assert "ArrowEvalPython" not in plan(found)  # sets are made where they are counted
    got = sorted((r.eval_key, r.train_key, r.ngram_jaccard, r.pool_rank) for r in found.collect())
    assert got == sorted(plain_pool(tests, train, 3))


@pytest.mark.parametrize("cells", [20, 2_000_000])
def test_rows_passed_by_are_in_no_pool(spark, monkeypatch, cells):
    tests, train, e, t = sides(spark, 1500)  # far more rows than are held: pools fill and rows are passed by
    monkeypatch.setattr(overlap, "CELLS", cells)
    shared = SimpleNamespace(value=overlap._index(e.selectExpr("key AS eval_key", "grams", "size").where("size > 0")).value)
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([x for _, x in part])], names=["train_key", "text"]) for part in (train[:700], train[700:])]
    got = [(r["eval_key"], r["train_key"], r["ngram_jaccard"]) for b in overlap._best(shared, 4, 3)(iter(batches)) for r in b.to_pylist()]
    want = [x[:3] for x in plain_pool(tests, train, 4) if x[2] > 0]
    assert sorted(got) == sorted(want)


@pytest.fixture
def nothing_small(spark):
    """No table counts as small by its size in bytes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_pool_goes_to_the_training_texts(spark, nothing_small):
    _, _, e, t = sides(spark)
    found = overlap.flagged(overlap.matches(e, t, 3))
    assert "BroadcastHashJoin" in plan(found)
    assert {r.rank for r in found.collect()} == {1}


def test_a_task_holds_a_slice_and_not_the_sets_of_a_batch(spark):
    """8 million characters whose sets are 24 MB and more at once."""
    _, _, e, _ = sides(spark, 1)
    shared = SimpleNamespace(value=overlap._index(e.selectExpr("key AS eval_key", "grams", "size").where("size > 0")).value)
    rng = random.Random(5)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000)) for _ in range(50)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int32()), pa.array(texts)], names=["train_key", "text"])
    tracemalloc.start()
    list(overlap._best(shared, 20, 3)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 60


def test_matches_are_the_same_when_the_pool_is_not_small(spark, monkeypatch, nothing_small):
    _, _, e, t = sides(spark, 100)
    few = sorted(tuple(r) for r in overlap.matches(e, t, 4).collect())
    monkeypatch.setattr(scratch, "FEW", 0)
    many = overlap.matches(e, t, 4)
    assert "BroadcastHashJoin" not in plan(many)
    assert sorted(tuple(r) for r in many.collect()) == few


def test_no_text_passes_a_pattern(spark):
    _, _, e, t = sides(spark, 5)
    for found in (overlap.best_matches(overlap.pool(e, t).selectExpr("*", "0.1D AS sequence_similarity")), t):
        assert "regexp_replace" not in plan(found)


def test_a_report_goes_to_the_training_texts(spark, nothing_small):
    tests, train, e, t = sides(spark, 50)
    rows = [spark.createDataFrame(x, "key int, text string") for x in (tests, train)]
    report = compare.overlap_report(overlap.best_matches(overlap.pool(e, t).selectExpr("*", "0.1D AS sequence_similarity")), *rows)
    assert "BroadcastHashJoin" in plan(report)
    got = report.collect()
    assert len(got) == 21
    assert all((r.eval_question, r.train_question) == (tests[r.eval_key][1], train[r.train_key][1]) for r in got)
