"""Pair selection against a plain model, sampling, filling, expansion."""

from __future__ import annotations

import random

import pytest


from quillspark.operators import candidates, formats, preference, prompts

SHAPE = "prompt_id string, _c string, is_ref boolean, pos int, answer string, reward double"


def model(rows, fallback):
    """Loop form: rows are (c, is_ref, pos, reward) of one prompt."""
    slots = {}
    for c, ref, pos, reward in rows:
        have = slots.get(c)
        if have is None or (ref and not have[1]) or (ref == have[1] and reward > have[3]):
            slots[c] = (c, ref, pos, reward)
    alive = list(slots.values())
    if len(alive) < 2:
        return None, len(alive)
    tries = [x for x in alive if x[1]][:1]
    if fallback:
        tries += sorted(alive, key=lambda x: -x[3])
    for chosen in tries:
        below = [(chosen[3] - x[3], k) for k, x in enumerate(alive) if x is not chosen and 0.5 <= chosen[3] - x[3] <= 8]
        if below:
            return (chosen[2], alive[min(below)[1]][2]), len(alive)
    return None, len(alive)


@pytest.mark.parametrize("fallback", [True, False])
def test_pairs_as_in_the_model(spark, fallback):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(150):
        group = [(rng.choice("abcdefgh"), False, p, rng.randint(0, 40) / 4) for p in range(rng.randint(0, 9))]
        if group and rng.random() < 0.7:
            k = rng.randrange(len(group))
            group[k] = (group[k][0], True, *group[k][2:])
        want[f"p{g}"] = model(group, fallback)
        rows += [(f"p{g}", c, ref, pos, c, reward) for c, ref, pos, reward in group]
    unique = preference.deduplicate(spark.createDataFrame(rows, SHAPE))
    listed = spark.createDataFrame([(k,) for k in want], "prompt_id string")
    found = preference.outcomes(listed, unique, preference.select_pairs(unique, fallback=fallback))
    for r in found.collect():
        pair, n = want[r.prompt_id]
        assert r.viable == n
        assert (None if r.margin is None else (r.chosen.pos, r.rejected.pos)) == pair
        assert r.reason == (None if pair else preference.TOO_FEW if n < 2 else preference.NO_NEGATIVE)


@pytest.mark.parametrize(("margin", "inside"), [(0.5, True), (8.0, True), (0.49, False), (8.01, False)])
def test_margin_edges(spark, margin, inside):
    unique = preference.deduplicate(spark.createDataFrame([("p", "a", True, 0, "a", margin), ("p", "b", False, 1, "b", 0.0)], SHAPE))
    assert preference.select_pairs(unique, fallback=False).count() == inside


@pytest.mark.parametrize("fallback", [True, False])
def test_pairs_of_rewards_that_no_binary_fraction_holds(spark, fallback):
    rng = random.Random(8)
    rows, want = [("e", "a", True, 0, "a", 0.6), ("e", "b", False, 1, "b", 0.1)], {"e": ((0, 1), 2)}
    assert model([r[1:4] + r[5:] for r in rows], fallback)[0] == (0, 1)
    for g in range(150):
        group = [(f"t{p}", p == 2, p, rng.choice([rng.randint(0, 30) / 10, 0.1 * rng.randint(0, 30), rng.randint(0, 30) * 0.7 / 7])) for p in range(rng.randint(0, 9))]
        want[f"p{g}"] = model(group, fallback)
        rows += [(f"p{g}", c, ref, pos, c, reward) for c, ref, pos, reward in group]
    unique = preference.deduplicate(spark.createDataFrame(rows, SHAPE).drop("answer"))
    got = {r.prompt_id: (r.chosen.pos, r.rejected.pos) for r in preference.select_pairs(unique, fallback=fallback).collect()}
    assert got == {k: v[0] for k, v in want.items() if v[0]}
    answered = preference.with_answers(preference.select_pairs(unique), spark.createDataFrame(rows, SHAPE), "answer").where("prompt_id = 'e'").first()
    assert (answered.chosen.answer, answered.rejected.answer) == ("a", "b")


def test_a_margin_of_nothing_pairs_equal_rewards(spark):
    rows = [("p", "a", False, 0, "a", 1.0), ("p", "b", False, 1, "b", 1.0), ("p", "c", False, 2, "c", 0.9)]
    pair = preference.select_pairs(preference.deduplicate(spark.createDataFrame(rows, SHAPE)), 0.0, 8.0).first()
    assert (pair.chosen.pos, pair.rejected.pos, pair.margin) == (0, 1, 0.0)


def test_deduplication_prefers_the_reference_and_keeps_the_first_place(spark):
    rows = [("p", "x", False, 0, "x", 9.0), ("p", "x", True, 1, "x", 1.0), ("q", "y", False, 0, "y", 1.0), ("q", "y", False, 1, "y", 2.0)]
    got = {r.prompt_id: r for r in preference.deduplicate(spark.createDataFrame(rows, SHAPE)).collect()}
    assert (got["p"].is_ref, got["p"].gpos) == (True, 0)
    assert (got["q"].reward, got["q"].gpos, got["q"].pos) == (2.0, 0, 1)


def test_nan_reward_is_no_reward(spark):
    text = "".join(chr(0x4E00 + i) for i in range(90))
    rows = spark.createDataFrame([("p", 0, False, text, float("nan")), ("p", 1, False, text[::-1], None)], "prompt_id string, pos int, is_ref boolean, answer string, reward double")
    assert preference.viable(rows).count() == 0


def test_statistics_of_nothing(spark):
    row = preference.statistics(spark.createDataFrame([], "m double"), "m").first()
    assert row["count"] == 0
    assert row["mean"] is None


@pytest.mark.parametrize(("limit", "want"), [(0, 4), (3, 3), (9, 4)])
def test_round_robin(spark, limit, want):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, role string")
    got = prompts.stratified_sample(rows, "role", "id", limit, 7).collect()
    assert len(got) == want
    if limit == 3:
        assert sorted(r.role for r in got) == ["a", "a", "b"]


def test_normalise(spark):
    rows = spark.createDataFrame(
        [("", " q 　", None, "a", "", 0), ("7", "", "i", "", "o", 1), ("8", "  ", "i", "a", "", 2)], "id string, question string, instruction string, answer string, output string, source_row int"
    )
    got = {r.source_row: r for r in prompts.normalise(rows).collect()}
    assert set(got) == {0, 1}  # a blank question does not fall through
    assert (got[0].question, got[1].question, got[1].reference_answer, got[1].role) == ("q", "i", "o", "unknown")
    with pytest.raises(ValueError, match="duplicate prompt_id"):
        prompts.require_unique(spark.createDataFrame([("a",), ("a",)], "prompt_id string"))


def test_fill_threshold_and_priority(spark):
    source = spark.createDataFrame([("1", "q1", "x" * 49), ("2", "q2", "x" * 50)], "id string, question string, answer string")
    earlier = spark.createDataFrame([("1", "q1", "e" * 60), ("2", "q2", "e" * 60)], source.schema)
    nothing = spark.createDataFrame([], source.schema)
    assert [r.id for r in prompts.pending(source, nothing).collect()] == ["1"]
    got = {r.id: r.answer[0] for r in prompts.filled(source, earlier).collect()}
    assert got == {"1": "e", "2": "x"}
    assert prompts.filled(source, nothing).where("id = '1'").first().status == "pending"


def test_candidate_ids_and_resume(spark):
    temps = candidates.temperature_table(spark, [0.3, 1.0, 1.1])
    assert [r.candidate_id for r in temps.orderBy("candidate_index").collect()] == ["sample_t0.3_0", "sample_t1_1", "sample_t1.1_2"]
    rows = spark.createDataFrame([("p", "q", 2)], "prompt_id string, question string, source_row int")
    done = spark.createDataFrame([("p", "sample_t1_1")], "prompt_id string, candidate_id string")
    todo = candidates.pending(rows, temps, done, 10)
    assert {r.generation_seed for r in todo.collect()} == {210, 212}
    assert candidates.generate(todo).where("answer = 'q @1.1'").count() == 1
    with pytest.raises(ValueError):
        candidates.parse_temperatures("0.3,-1")


def test_completion_errors_stay_in_their_row(spark):
    def client():
        def ask(text):
            if text == "bad":
                raise RuntimeError("no")
            return text.upper()

        return ask

    rows = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in candidates.complete(rows, client, tries=2, pause=0).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "no")}


def test_registry(spark):
    old = spark.createDataFrame([("a", 1)], "name string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "name string, v int")
    assert {tuple(r) for r in formats.upsert(old, new).collect()} == {("a", 1), ("b", 2)}
    assert formats.merge_registry({"a": 1}, {"a": 2, "b": 2}) == {"a": 1, "b": 2}
