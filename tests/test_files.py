"""Sources and sinks, entry points, streaming logs."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pytest

from quillspark import schemas
from quillspark.operators import evaluation, overlap
from quillspark.plans import compare, options, pairs
from quillspark.sources import files, sinks
from quillspark.streaming import logs


def test_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes('﻿id,question,answer\n1,"a ""b"", c\nd",\n'.encode())
    row = files.read_csv(spark, str(path)).first()
    assert (row.id, row.question, row.answer) == ("1", 'a "b", c\nd', "")


def test_jsonl(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), schemas.DPO).count() == 0
    path = tmp_path / "x.jsonl"
    path.write_text('{"instruction": "a"}\n\n{"instruction": "b"}\n')
    assert files.read_jsonl(spark, str(path), schemas.DPO).count() == 2
    path.write_text("{bad\n")
    with pytest.raises(Exception, match=r"malformed line in .*x.jsonl: \{bad"):
        files.read_jsonl(spark, str(path), schemas.DPO).collect()
    with pytest.raises(ValueError):
        files.read_source(spark, "x.txt")


def test_json_array_and_registry(spark, tmp_path):
    path = str(tmp_path / "a.json")
    sinks.write_json_array(spark.createDataFrame([("é", "", "c", None)], schemas.DPO), path)
    assert json.loads((tmp_path / "a.json").read_text()) == [{"instruction": "é", "input": "", "chosen": "c", "rejected": None}]
    assert files.read_json_array(spark, path, schemas.DPO).count() == 1
    registry = str(tmp_path / "r.json")
    first = compare.register(spark, registry)
    assert compare.register(spark, registry, {"sft_train": {}, "b": {}}) == first | {"b": {}}


def test_build_pairs_end_to_end_and_resume(spark, tmp_path):
    source = tmp_path / "q.csv"
    lines = ["id,question,answer,role"]
    for i in range(6):
        answer = "".join(chr(0x4E00 + (i * 97 + k * 7) % 5000) for k in range(100))
        lines.append(f"{i},问题{i},{answer},r{i % 2}")
    source.write_text("\n".join(lines) + "\n", encoding="utf-8")

    def model(questions, temperatures):
        return questions + temperatures.map(lambda t: "".join(chr(0x5E00 + int(t * 10) * 131 + k) for k in range(100)))

    o = options.PairOptions(input=str(source), output_dir=str(tmp_path / "out"), limit=4)
    report = pairs.run(spark, o, model)
    assert report["selected_prompts"] == 4
    assert report["scored_candidates"] == 24
    assert report["preference_pairs"] + sum(report["skipped"].values()) == 4
    assert sum(report["role_counts"].values()) == report["preference_pairs"]
    assert pairs.run(spark, o, model) == report  # nothing is generated or scored twice
    kept = files.read_jsonl(spark, str(tmp_path / "out/preference_pairs.jsonl"), schemas.PAIR).collect()
    assert all(0.5 <= r.judge_margin <= 8 for r in kept)
    dpo = json.loads((tmp_path / "out/preference_pairs_llamafactory.json").read_text())
    assert len(dpo) == len(kept)


def test_options_are_checked():
    for bad in ({"top_p": 0}, {"min_margin": 9.0}, {"stage": "x"}, {"limit": -1}, {"output_dir": ""}):
        with pytest.raises(ValueError):
            options.PairOptions(**bad)


def test_compare_never_shows_the_rubric(spark, tmp_path):
    rows = [{"id": str(i), "role": "r", "difficulty": "d", "question_type": "t", "question": f"q{i}", "expected_points": ["SECRET"]} for i in range(3)]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    o = options.CompareOptions(eval_file=str(tmp_path / "e.json"), output_dir=str(tmp_path / "out"))
    summary = compare.compare(spark, o, lambda p: p.str.len().astype(str), lambda p: p, lambda t: t.str.len().astype(float))
    assert summary["questions"] == 3
    assert summary["reward"]["sft_win_rate"] == 1.0
    out = spark.read.parquet(str(tmp_path / "out/comparisons.parquet"))
    assert out.where("prompt LIKE '%SECRET%'").count() == 0
    assert evaluation.length_summary(out, "base_answer").first().max_chars > 0


def test_fill_and_convert(spark, tmp_path):
    names = [f.name for f in schemas.QUESTION.fields]
    good = "g" * 60
    lines = [",".join(names)] + [",".join({"id": str(i), "question": f"q{i}", "answer": a}.get(n, "") for n in names) for i, a in enumerate([good, "", "short"])]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    done = compare.fill(spark, str(tmp_path / "s.csv"), str(tmp_path / "none.csv"), str(tmp_path / "f.csv"), lambda: lambda p: "n" * 55)
    assert [r.status for r in done.orderBy("id").collect()] == ["answered", "generated", "generated"]
    compare.convert(spark, str(tmp_path / "s.csv"), str(tmp_path / "sft"))
    assert len(json.loads((tmp_path / "sft/sft_train.json").read_text())) == 3


def test_overlap_against_plain_python(spark):
    train = [(i, t) for i, t in enumerate(["tide and time", "diet", "abcdefgh", "", "xyz tide", "zzz"])]
    tests = [(0, "tide"), (1, "qqqq"), (2, "abcdeXYZ")]
    e, t = (overlap.gram_sets(spark.createDataFrame(x, "key int, text string"), "key", "text") for x in (tests, train))
    got = {(r.eval_key, r.rank): (r.train_key, r.max_similarity) for r in overlap.matches(e, t, 4, 3).collect()}

    def form(x):
        return "".join(c for c in x if c.isascii() and c.isalnum()).lower()

    def grams(x):
        return {x[i : i + 3] for i in range(len(x) - 2)} if len(x) >= 3 else ({x} if x else set())

    for key, q in tests:
        a = form(q)
        jac = [(len(grams(a) & grams(form(x))) / max(1, len(grams(a) | grams(form(x)))), i) for i, x in train]
        pool = sorted(jac, key=lambda p: (-p[0], p[1]))[:4]
        best = sorted(((max(j, SequenceMatcher(None, a, form(train[i][1])).ratio()), -k, i) for k, (j, i) in enumerate(pool)), reverse=True)[:3]
        for rank, (m, _, i) in enumerate(best, 1):
            assert got[key, rank] == (i, pytest.approx(m))
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25


def test_log_stream_resumes(spark, tmp_path):
    schema = "k int, v string"
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in ([(1, "a"), (1, "a")], [(1, "b"), (2, "b")]):
        sinks.append_jsonl(spark.createDataFrame(rows, schema), log)
        stream = logs.follow(spark, log, spark.createDataFrame([], schema).schema)
        logs.append_new(stream, out, ["k"], lambda df: df, mark).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_reports_start_with_a_mark_and_large_arrays_keep_every_row(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "r.csv"), single=True)
    part = next((tmp_path / "r.csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b\n")
    assert files.read_csv(spark, str(tmp_path / "r.csv")).columns == ["a", "b"]
    sinks.write_json_array(spark.range(1000).repartition(5), str(tmp_path / "n.json"))
    assert sorted(r["id"] for r in json.loads((tmp_path / "n.json").read_text())) == list(range(1000))
    sinks.write_json_array(spark.range(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    rows = files.with_position(spark.range(500).repartitionByRange(4, "id").sortWithinPartitions("id"))
    assert all(r["id"] == r.source_row for r in rows.collect())


def test_fill_keeps_what_was_answered_when_it_stops(spark, tmp_path):
    names = [f.name for f in schemas.QUESTION.fields]
    lines = [",".join(names)] + [",".join({"id": str(i), "question": f"q{i}"}.get(n, "") for n in names) for i in range(3)]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "f.csv")

    def client():
        def ask(prompt):
            if "q1" in prompt:
                raise RuntimeError("refused")
            return "n" * 55

        return ask

    real = compare.candidates.complete
    compare.candidates.complete = lambda rows, c: real(rows, c, pause=0)
    try:
        first = compare.fill(spark, str(tmp_path / "s.csv"), out, out, client)
        assert [r.status for r in first.orderBy("id").collect()] == ["generated", "pending", "generated"]
        again = compare.fill(spark, str(tmp_path / "s.csv"), out, out, lambda: lambda p: "m" * 60)
    finally:
        compare.candidates.complete = real
    assert [r.answer[0] for r in again.orderBy("id").collect()] == ["n", "m", "n"]


def test_command_lines(spark, tmp_path, capsys):
    from quillspark.__main__ import main, parser

    (tmp_path / "t.csv").write_text("id,question,answer,role\n0,what is tide,a,r\n1,what is diet,b,r\n")
    (tmp_path / "e.json").write_text(json.dumps([{"id": "0", "role": "r", "difficulty": "d", "question_type": "t", "question": "what is tide", "expected_points": []}]))
    row = main(["overlap", "--eval_file", str(tmp_path / "e.json"), "--train_file", str(tmp_path / "t.csv"), "--out", str(tmp_path / "o.csv")], spark)
    assert (row.flagged, row.questions) == (1, 1)
    report = files.read_csv(spark, str(tmp_path / "o.csv"))
    assert {"eval_role", "train_role", "eval_question"} <= set(report.columns)
    main(["convert", "--input", str(tmp_path / "t.csv"), "--out_dir", str(tmp_path / "sft")], spark)
    assert json.loads((tmp_path / "sft/dataset_info.json").read_text())
    assert main(["compare", "--eval_file", str(tmp_path / "e.json"), "--output_dir", str(tmp_path / "c")], spark)["questions"] == 1
    with pytest.raises(ValueError, match="overwrite"):
        main(["compare", "--eval_file", str(tmp_path / "e.json"), "--output_dir", str(tmp_path / "c")], spark)
    main(["verify"], spark)
    main(["demo", "--question", "hello", "--question", " "], spark)
    assert "[not trained]" in capsys.readouterr().out
    args = parser().parse_args(["pairs", "--no-sample_chosen_fallback", "--temperatures", "0.3,0.5"])
    assert (args.sample_chosen_fallback, args.limit, args.temperatures) == (False, 200, "0.3,0.5")
    with pytest.raises(ValueError, match="rm_input_format"):
        options.CompareOptions(rm_model="m:f")
    with pytest.raises(ValueError, match="key"):
        compare.candidates.chat_client("qwen")


def test_csv_keeps_ends_of_texts_and_absent_values(spark, tmp_path):
    from quillspark.plans import registry

    texts = [" a", "a ", "a\n", "\na", "\ta", "\r", "a\r\n", "\0a", "　a　", " ", "\n\n", "", None, '"', ' "a",\n', "a\r\nb"]
    rows = [(i, t, [None, "", " en"][i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: (r.question, r.role, r.answer) for r in registry.csv_scan(spark, str(tmp_path)).collect()}
    assert got == {str(i): (t, lang, "") for i, t, lang in rows}
