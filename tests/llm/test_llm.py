"""The operators against brute force, and their edge cases: nulls, empty, long, ties, repeats, extra columns."""

from __future__ import annotations

import random
import time
from html import unescape
from html.parser import HTMLParser

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, classifier, common, html, licenses, mixing, neardup_vectors, ngram_join, pii, quality, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, t string, n bigint, h string"


def frame(spark, rows, schema=SCHEMA):
    """Rows (id, text[, source]) with clashing extra columns."""
    width = len(schema.split(","))
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "k", "t", 1, "h")[:width] for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        out.append((i, " ".join(w)))
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a\tB"), (1005, "zz " * 20000), (1006, out[0][1]), (0, out[0][1])]


def test_ngram_join_equals_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute.classes(ids, links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}
    assert got[1003].component_id == got[1004].component_id == 1003
    assert ngram_join.near_duplicates(frame(spark, rows)).count() == len(rows)


def test_repeated_rows_in_different_slices_count_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = []
    for g in range(6):
        x, y, z = (" ".join(f"{c}{g}_{i}" for i in range(40)) for c in "xyz")
        # Jaccard of every two: 36 / 116
        rows += 2 * [(10 * g, f"{x} {y}"), (10 * g + 1, f"{y} {z}"), (10 * g + 2, f"{z} {x}")]
    try:
        spark.conf.set(key, "1")  # one slice a row
        got = ngram_join.near_duplicates(frame(spark, rows)).collect()
        kept = ngram_join.one_of_each(frame(spark, rows)).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id for r in got)
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in rows})


def test_ngram_join_takes_ids_of_any_type_and_the_empty_text(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([("b10", text), ("b9", text), ("a", "other words stand here now"), (None, text), ("x", ""), ("y", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {"b10": (3, "b10"), "b9": (3, "b10"), "a": (1, "a"), None: (3, "b10"), "x": (0, "x"), "y": (0, "y")}


def test_one_of_each_keeps_rows_without_words_and_all_columns(spark):
    kept = ngram_join.one_of_each(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x y")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ngram_join.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert quality.assess(none).count() == 0
    assert pii.report(none).count() == 0
    assert licenses.scan(none.select("doc_id", "text")).count() == 0
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("one_task", [True, False])
def test_components_on_both_paths(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", 10**6 if one_task else 0)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute.classes(sorted({x for e in real for x in e}), real)
    assert got == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 40))
    x = np.concatenate([base, base[:30] + rng.normal(scale=0.1, size=(30, 40)), base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 40), (902, [float("nan")] * 40), (903, [1.0, None])]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), tile=32).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = brute.classes(list(range(len(x))), np.argwhere(near).tolist())
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (900, 901, 902, 903))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_many_tiles_and_files_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(neardup_vectors, "FILE_BYTES", 16 << 10)
    monkeypatch.setattr(neardup_vectors, "TILES_A_JOB", 3)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base, base[:40] + rng.normal(scale=0.25, size=(40, 24)), np.repeat(base[:1], 60, axis=0), base[:1] + rng.normal(scale=0.1, size=(60, 24))]).astype(np.float32).astype(float)
    if kind == "double":
        x[5], x[200] = x[5] * 1e200, x[200] * 1e-200
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, f"vec_id string, embedding array<{kind}>"), tile=32).collect()}
    s = x / np.abs(x).max(axis=1)[:, None]
    u = s / np.linalg.norm(s, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = brute.classes(list(range(len(x))), np.argwhere(near).tolist())
    assert all((got[f"v{i:04}"].n_links, got[f"v{i:04}"].component_id) == (near[i].sum(), f"v{want[i]:04}") for i in range(len(x)))


def test_vectors_with_negative_zero_stay(spark):
    rows = [(1, [1.0, -0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, [-0.0, 1.0, -0.0]), (4, [-0.0, 0.0, -0.0])]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_vectors_of_every_length_are_compared(spark):
    rows = [(1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [2.0, 4.1]), (7, [1.0])]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 0, 7, True)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_mixing_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c"])) for i in range(3000)] + [(5000, None, None), (5001, "x y", None), (5002, "", "zero")]
    docs = frame(spark, rows)
    first = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    assert len(first) == len(rows)
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7), keep=["doc_id"]).collect()}
    assert {r.doc_id: r.copies for r in first} == again
    total, plan = sum(r.size for r in first), {}
    for r in first:
        s = plan.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.size * r.copies
        assert 0 <= r.copies <= 3
    assert sum(p[1] for p in plan.values()) == pytest.approx(total)
    for size, target, taken in plan.values():
        assert target <= 3 * size + 1e-6
        assert abs(taken - target) <= max(60, 0.03 * target)
    assert plan[None][1] == 3 * plan[None][0]  # capped at three times its size
    assert plan["zero"][1] == 0


def poured(sizes, weights=(5, 2, 1), most=3):
    """Targets by pouring: full sources stop, the rest is shared again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
        open_ -= full
        left = sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
    return target


def test_mixing_targets_equal_pouring_and_repeats_are_dealt_out(spark):
    rng = random.Random(12)
    for turn in range(3):
        rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", "e", None][: 3 + turn])) for i in range(rng.randint(30, 400))]
        docs = frame(spark, rows + [(7, "same words here", "b")] * 25 + [(None, "no key", "a"), (None, "no key", "a"), (None, "other", None)])
        got = mixing.mix(docs.withColumn("size", F.lit("x")).withColumn("copies", F.lit("y"))).collect()
        sizes = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        want = poured(sizes)
        assert len(got) == len(rows) + 28
        assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] for r in got)
        same = [r.copies for r in got if r.doc_id == 7 and r.text == "same words here"]
        assert len(same) == 25 and max(same) - min(same) <= 1
        assert abs(sum(same) - 25 * want["b"] / sizes["b"]) <= 1
        taken = {s: sum(r.size * r.copies for r in got if r.source == s) for s in sizes}
        assert all(abs(taken[s] - want[s]) <= max(45, 0.05 * want[s]) for s in sizes)


def test_mixing_writes_few_files_however_many_partitions(spark, monkeypatch):
    rng = random.Random(5)
    docs = frame(spark, [(i, "w " * rng.randint(0, 40), rng.choice("aaab")) for i in range(6000)])
    want = {r.doc_id: r.copies for r in mixing.mix(docs, keep=["doc_id"]).collect()}
    written = []

    def cut(df):
        written.append(common.cut(df))
        return written[-1]

    monkeypatch.setattr(mixing, "cut", cut)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(40), keep=["doc_id"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert len(written) >= 4 and max(len(t.inputFiles()) for t in written) <= 8


def test_base_spans_and_hashes(spark):
    rng = random.Random(3)
    ab = "1234567890 ..--++@@ab()_%é😀\n5"
    rows = [(i, "".join(rng.choice(ab) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(5000, None), (5001, ""), (5002, "1 " * 5000 + "4111 1111 1111 1111"), (5003, "a" * 50000 + "@b.c"), (5004, "4111111111111111 999.1.1.1 a@b.c_d@e.f 0000000001.2.3.255")]
    texts = dict(rows)
    for r in pii.report(frame(spark, rows)).collect():
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.written(spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_contexts_discover_unseen_identifiers(spark):
    values = [f"u{i}@mail.example" for i in range(30)] + ["k7.user.corp"]
    docs = frame(spark, [(i, f"write to contact: {v} today") for i, v in enumerate(values)] + [(99, None)])
    assert pii.learn(docs) == {"contact: ": 0}
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (got[30].n_email, got[30].spans) == (0, "email:18:30")
    assert {r.doc_id: r.text for r in pii.mask(docs).collect()}[30] == "write to contact: <email> today"


def test_one_text_supports_no_context(spark):
    docs = frame(spark, [(i, "write to " + " contact: u{}@mail.example and".format(i) * 1) for i in range(4)] + [(9, " and ".join(f"note: v{i}@mail.example" for i in range(30)))] * 3)
    assert pii.learn(docs) == {}


def plain_method(rows):
    """The whole method over (id, text) rows: spans of each."""
    import regex

    token, tail = regex.compile(pii.TOKEN), regex.compile(r"[.!?:*#%$&|]+$")
    base = {i: brute.base_spans(t) for i, t in rows}
    tokens = {}
    for i, t in rows:
        out = []
        for m in token.finditer(t or ""):
            if m.group(3) is None:
                continue
            v = tail.sub("", m.group(3))
            if len(v) >= 6:
                out.append((m.group(1).lower() + regex.sub(r"[ \t]+", " ", m.group(2)), v, m.start(3), m.start(3) + len(v)))
        tokens[i] = out
    values, texts, seeds = {}, {}, {}
    for i, t in rows:
        for w, v, s, e in tokens[i]:
            values.setdefault(w, set()).add(v)
            texts.setdefault(w, set()).add(t)
            k = next((k for a, k, b in base[i] if a < e and s < b), None)
            if k is None and regex.search(pii.SHAPES["secret"], v) and regex.match("[a-z_]*", w).group() not in pii.PUBLIC:
                k = 4
            if k is not None:
                seeds[v] = max(k, seeds.get(v, -1))
    known, patterns = {v: (k, 1.0) for v, k in seeds.items()}, {}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for w, vs in values.items():
            if len(vs) >= pii.SUPPORT and len(texts[w]) >= pii.DOCUMENTS:
                for k in range(5):
                    c = sum(known[v][1] for v in vs if v in known and known[v][0] == k) / (len(vs) + 1)
                    if c >= pii.CONFIDENT:
                        patterns[w] = (k, c)
        for w, (k, c) in patterns.items():
            for v in values[w]:
                if v not in seeds and c > known.get(v, (0, 0))[1]:
                    known[v] = (k, c)
    out = {}
    for i, _ in rows:
        more = [(s, patterns[w][0], e) for w, _, s, e in tokens[i] if w in patterns and not any(a < e and s < b for a, _, b in base[i])]
        out[i] = ",".join(f"{pii.ALL_KINDS[k]}:{s}:{e}" for s, k, e in sorted(base[i] + more))
    return out, set(patterns)


def test_spans_equal_the_whole_method_in_plain_python(spark):
    rng = random.Random(31)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = {
        "email": lambda: f"u{rng.randrange(999)}@mail.example", "ip": lambda: f"10.0.{rng.randrange(256)}.{rng.randrange(256)}",
        "secret": lambda: hexes(40), "odd": lambda: f"{rng.choice('kq')}{rng.randrange(10**6, 10**7)}.x", "word": lambda: rng.choice(["alpha", "beta7", "gamma"]),
    }
    lead = {"token = \"": "secret", "mail: ": "email", "host ": "ip", "see ": "word", "commit ": "secret", "id=": "odd"}
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w, kind = rng.choice(list(lead.items()))
            if rng.random() < 0.15:
                kind = rng.choice(list(made))
            parts.append(f"{w}{made[kind]()}{chr(34) if w.endswith(chr(34)) else ''}{rng.choice([' ', '. ', chr(10), ' é😀 '])}")
        rows.append((i, "".join(parts)))
    rows += [(900, None), (901, "")]
    want, patterns = plain_method(rows)
    assert 'token = "' in patterns and "commit " not in patterns
    docs = frame(spark, rows).withColumn("_base", F.lit(1)).withColumn("_spans", F.lit("kept"))
    assert {r.doc_id: r.spans for r in pii.report(docs).collect()} == want
    masked = pii.mask(docs).collect()
    assert all(r._spans == "kept" and r._base == 1 for r in masked)
    assert any("token = \"<secret>\"" in (r.text or "") for r in masked)


@pytest.mark.parametrize("inline", [True, False])
def test_every_confident_context_is_promoted(spark, monkeypatch, inline):
    monkeypatch.setattr(pii, "INLINE", 10**6 if inline else 0)
    word = lambda c: "ctx" + "".join("abcdefghij"[int(x)] for x in f"{c:03}")
    n = 210
    rows = [(100 * c + i, f"{word(c)}: u{c}x{i}@mail.example") for c in range(n) for i in range(8)]
    rows += [(100 * c + 50, f"{word(c)}: k{c}.user.corp") for c in range(n)]
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"email:8:{len(t)}" for i, t in rows if i % 100 == 50)


def test_whole_values_and_words_of_any_length(spark):
    word, value = "contactperson" * 3, "k" * 120 + "7.user.corp"
    rows = [(i, f"{word}: u{i}@mail.example") for i in range(30)] + [(30, f"{word}: {value}")]
    assert {r.doc_id: r.text for r in pii.mask(frame(spark, rows)).collect()}[30] == f"{word}: <email>"
    rows = [(0, "ab:" * 60_000 + " contact: x1234567")]  # no square of the length
    tokens = frame(spark, rows).select(pii._tokens(F.col("text")).alias("x")).first().x
    assert [(x.w, x.v) for x in tokens] == [("contact: ", "x1234567")]


def test_quality_rules(spark):
    rows = [
        (1, "This is a plain sentence of some words that ends well.\nhome | about | news | help\nAnother line of quite different words follows here."),
        (2, None),
        (3, ""),
        (4, "a b c d e " * 10),
        (5, "one two three four five six seven eight nine ten eleven twelve"),
    ]
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows)).collect()}
    assert got[1].kept
    assert "about" not in got[1].clean_text
    assert (got[1].n_dup_lines, got[1].n_symbols) == (0, 3)
    assert got[2].base_failed and got[3].base_failed and got[4].base_failed
    assert got[4].n_repeat_words == 50
    assert not got[5].base_failed and not got[5].kept  # no sentence
    assert quality.clean(frame(spark, rows)).columns[-1] == "h"


def test_line_end_is_seen_behind_padding():
    for end in ":;\")]….":
        assert not quality.line_fails("some words before the end" + end + " \t" * 40, 5)
    assert quality.line_fails("some words before the end" + " " * 80, 5)


def test_quality_equals_its_sql_on_padded_repeated_and_long_texts(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(14)
    ends = [".", ":", " ;", '"', ")", "…", "", " |", "!!", " \t", "." + " " * 60, ":\t\t" + " " * 50, "é"]
    line = lambda: " ".join(rng.choice(["home", "About", "words", "cookie", "policy", "and", "naïve", "#", "a.", "click here to"]) for _ in range(rng.randint(0, 14))) + rng.choice(ends)
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "long words of text stand here. " * 4000), (3, rows[3][1] + " "), (903, "a\r\nb\x0bc\x85d e f g h i j k.")]
    unique = pd.DataFrame(rows, columns=["doc_id", "text"]).drop_duplicates("doc_id")
    want = duckdb.query_df(unique, "documents", quality.sql()).fetchall()
    got = quality.assess(frame(spark, list(unique.itertuples(index=False, name=None))), with_text=False).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_codec_equals_the_public_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\x1c\x85\n\t'sll123中文😀ा") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "x" * 100000, "<|endoftext|>"]
    rows = [*enumerate(texts), (999, None)]
    got = bpe.encode(frame(spark, rows), bpe.tables(path), public_tokenizers.PATTERN).collect()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert list(r.ids) == known.encode_ordinary(text)
        assert r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == brute.sha(text)
    table = bpe.tables(path)[1]
    assert sorted(table.ranks) == sorted(ranks.values())  # minimal and perfect


def test_licenses(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, None), (3, "x gnu GENERAL public license\nApache License mit license"), (4, "All rights\nreserved"), (5, "Released under this MIT license")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].score) == ("cc-by", "cc-by,cc-by-nc", 1.0)
    assert (got[2].n_words, got[2].labels, got[2].first_word, got[2].score) == (0, "", None, 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (3, 1, 7)
    assert got[4].labels == "all-rights-reserved"  # a line break does not part a statement


def test_license_blocks_equal_brute_force_and_wrapped_statements_are_found(spark):
    rng = random.Random(21)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choice(words + ["filler"] * 60) for _ in range(rng.randint(0, 130)))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            t = [w for w in t if rng.random() > rng.choice([0, 0.1, 0.3])]
            parts.insert(rng.randint(0, len(parts)), rng.choice([" ", "\n", "\n * "]).join(t))
        rows.append((i, rng.choice([" ", "\n\n"]).join(parts)))
    mit = "# Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software and associated documentation\n# files (the Software)"
    rows += [(900, mit), (901, None), (902, "z " * 30000 + mit), (900, mit)]
    docs = frame(spark, rows).withColumn("labels", F.lit(1)).withColumn("score", F.lit("x"))
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    assert {r.labels for r in got if r.doc_id in (900, 902)} == {"mit"}
    text = dict(rows)
    for r in got:
        ws = __import__("re").findall(r"[a-z0-9]+", (text[r.doc_id] or "").lower())
        best, found = 0.0, set()
        for i in range(0, len(ws), licenses.STEP):
            block = set(ws[i : i + licenses.BLOCK_WORDS])
            for label, t in licenses.TEMPLATES:
                tokens = set(t.split())
                if 10 * len(block & tokens) >= 8 * len(tokens):
                    found.add(label)
                    best = max(best, len(block & tokens) / len(tokens))
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {' '.join(ws)} "}
        assert r.labels == ",".join(sorted(found | base))
        assert r.score == (1.0 if base else best)


def test_substring_removal(spark):
    one = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon. Phi chi psi omega and then some more words stand here."
    rows = [(1, "First words of it. " + one + " Last words."), (2, "Quite another start. " + one + " And its end"), (3, "Nothing repeats here. At all."), (4, None), (5, ""), (6, "run into " + one)]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert (got[1].n_repeated, got[1].n_removed, got[1].text) == (3, 0, rows[0][1])
    assert (got[2].n_sentences, got[2].n_removed, got[2].text) == (5, 3, "Quite another start. And its end")
    assert got[6].text == "run into Alpha beta gamma delta epsilon zeta eta theta iota kappa."
    assert [got[i].text for i in (3, 4, 5)] == [rows[2][1], None, ""]


def spans_by_brute_force(rows):
    """Every run of every length; rows equal in id and text are one."""
    order = sorted({(i is None, i if i is not None else 0, x, t) for i, x, t in rows}, key=lambda r: r[:3])
    sentences = [brute.sentences(t) for *_, t in order]
    plain = [[brute.solid(x) for x in s] for s in sentences]
    first, gone, held = {}, set(), set()
    runs = [(d, a, b, "|".join(p[a:b])) for d, p in enumerate(plain) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if sum(map(len, p[a:b])) >= 80]
    count = {}
    for d, a, b, x in sorted(runs, key=lambda r: (r[0], r[1])):
        first.setdefault(x, (d, a))
        count[x] = count.get(x, 0) + 1
    for d, a, b, x in runs:
        if count[x] > 1:
            held |= {(d, k) for k in range(a, b)}
        if first[x] != (d, a):
            gone |= {(d, k) for k in range(a, b)}
    out = {}
    for d, (_, i, x, t) in enumerate(order):
        n = len(sentences[d])
        some = any((d, k) in gone for k in range(n))
        text = "".join(s for k, s in enumerate(sentences[d]) if (d, k) not in gone) if some else t
        out[None if _ else i, x] = (n, sum((d, k) in held for k in range(n)), sum((d, k) in gone for k in range(n)), text)
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_substring_equals_every_run_of_brute_force(spark, batch):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "Ωmega", "d", "e3", "naïve"]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "! ", '?"', "。", "\n", ".)"]) for _ in range(60)]
    rows = []
    for i in range(120):
        part = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if rows and rng.random() < 0.5:
            part += [rng.choice(rows)[1] or ""]
        rows.append((i % 90 if i % 7 else i, rng.choice([" ", "\n\n", "  "]).join(part)))
    rows += [(500, "x" * 200000 + ". " + "long tail of words. " * 3000), (501, "long tail of words. " * 50), (None, rows[5][1]), (None, None), rows[8], rows[8], (502, "")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = frame(spark, rows)
    try:
        spark.conf.set(key, batch)
        got = substring.remove_repeats(docs).collect()
    finally:
        spark.conf.set(key, before)
    small = [r for r in rows if r[0] not in (500,)]
    assert len(got) == len(rows)
    hashes = {(r.doc_id, r.text): r.x for r in docs.select("doc_id", "text", F.xxhash64("text").alias("x")).collect()}
    want = spans_by_brute_force([(i, hashes[i, t], t) for i, t in small])
    mine = sorted(((r.doc_id, r.n_sentences, r.n_repeated, r.n_removed, r.text) for r in got if r.doc_id != 500), key=str)
    # the long row only repeats itself and the row after it
    theirs = [(i, *want[i, hashes[i, t]]) for i, t in small if i != 501]
    assert sorted((r for r in mine if r[0] != 501), key=str) == sorted(((i, n, h, g, None if t0 is None else t) for (i, t0), (_, n, h, g, t) in zip([x for x in small if x[0] != 501], theirs, strict=True)), key=str)
    by = {r.doc_id: r for r in got}
    assert (by[500].n_sentences, by[500].n_removed, by[501].n_removed) == (3001, 2999, 50)


def test_substring_takes_ids_of_any_type(spark):
    text = "Some words that make a sentence of fair length here. And another sentence of about the same length there."
    docs = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert got == {"a": 0, "b": 2, None: 2}


def test_html_blocks():
    page = """<html><head><title>x</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on the site for you and us.</div>
    <article><h1>Title &eacute;</h1><p>The quick brown fox is in the house and it was there with the dog for a long time.<p>Short.
    <div id=comments><p>I think that this is the best of all and so good.</p></div></article><footer>foot</footer>"""
    assert html.main_text(page) == "Title é The quick brown fox is in the house and it was there with the dog for a long time. Short."
    assert html.main_text("") == ""
    assert html.main_text("<p>" * 2000) == ""


@pytest.mark.parametrize("unit", ["<p x ", '<a "', "<!-- ", "<div>", '<a "> "', "<a '\">", "</x>", "<div></p>", "<script>", "< ", "&amp", "<![CDATA[", "<a '>\"<b ", '<div class="a'])
def test_broken_markup_costs_time_in_proportion(unit):
    took = []
    for n in (1 << 18, 1 << 20):
        page = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        html.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 20


class Plain(HTMLParser):
    """Blocks of a page by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.out, self.text, self.links, self.link, self.open, self.bad, self.article, self.articles = [], "", 0, False, [], 0, 0, 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join(unescape(self.text).split())
        if text:
            self.out.append((text, self.links, self.bad > 0, self.article))
        self.text, self.links = "", 0

    def data(self, raw):
        self.text += raw
        self.links += len(raw.strip()) if self.link else 0

    def handle_data(self, raw):
        if not any(x[0] in html.RAW for x in self.open[-1:]):
            self.data(raw)

    def handle_entityref(self, name):
        self.data(f"&{name};")

    def handle_charref(self, name):
        self.data(f"&#{name};")

    def pop(self):
        name, bad, before = self.open.pop()
        self.bad -= bad
        self.article = before if name in html.ARTICLE else self.article
        return name

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCKS:
            self.flush()
        if tag == "a":
            self.link = True
            return
        if tag in html.VOID:
            return
        raw = " ".join(k if v is None else f'{k}="{v}"' for k, v in attrs)
        if tag == "p":
            while self.open and self.open[-1][0] in ("p", "b", "i", "em", "strong", "span"):
                self.pop()
        furniture = html._furniture(" " + raw)
        marked = tag in html.SKIPPED or tag not in ("html", "body") and furniture
        if tag == "header" and self.article and not furniture:
            marked = False
        if tag in html.BLOCKS or marked:
            self.open.append((tag, marked, self.article))
            self.bad += marked
            if tag in html.ARTICLE and not self.bad:
                self.articles += 1
                self.article = self.articles

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.flush()
        if tag == "a":
            self.link = False
        elif any(x[0] == tag for x in self.open):
            while self.pop() != tag:
                pass


def plain_text(page):
    found = [(t, k, bad, home) for t, k, bad, home in Plain(page).out]
    counts = [html._stop_words(t) for t, k, bad, _ in found if not bad and len(t) >= html.SHORT and k <= html.FEW_LINKS * len(t)]
    foreign = sum(c[0] for c in counts) < html.LOW_STOP * sum(c[1] for c in counts)
    first = [html.classify(t, k, bad, bool(home), foreign) for t, k, bad, home in found]
    kept = []
    for i, (text, _, _, home) in enumerate(found):
        label = first[i]
        if label == html.AMBIGUOUS:
            sides = []
            for ks in (range(i - 1, -1, -1), range(i + 1, len(found))):
                sides += [(abs(k - i), first[k]) for k in ks if found[k][3] == home and first[k] != html.AMBIGUOUS and not (home and found[k][2])][:1]
            if home:
                label = html.GOOD if not sides or any(x[1] == html.GOOD for x in sides) else html.BAD
            else:
                label = min(sides, key=lambda x: x[0])[1] if sides else html.BAD
        if label == html.GOOD:
            kept.append(text)
    return " ".join(kept)


def test_pages_equal_a_second_implementation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(220)
    pages = {r.page_id: r.html for r in rows.collect()}
    got = html.extract(rows.unionByName(spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-1, None, None)], rows.select("page_id", "url", "html").schema), allowMissingColumns=True)).collect()
    assert len(got) == len(pages) + 3
    for r in got:
        assert r.text == (plain_text(pages[r.page_id]) if r.page_id >= 0 else "")
        assert r.n_chars == len(r.text)


def test_furniture_inside_an_article_decides_nothing():
    page = "<article><p>First short words.</p><div class=share>Share this</div><p>Second short words.</p></article>"
    assert html.main_text(page) == "First short words. Second short words."


def test_pages_in_languages_without_known_stop_words():
    russian = "Быстрая рыжая лиса перепрыгнула через спящую собаку и побежала дальше к старому дому у реки."
    chinese = "敏捷的棕色狐狸跳过了懒狗，然后跑向河边的老房子。" * 4
    polish = "Szybki rudy lis przeskoczył nad śpiącym psem i pobiegł dalej w stronę starego domu nad rzeką."
    page = "<nav>Меню</nav><div>{}</div><div>{}</div><div class=footer>Подвал</div>"
    for text in (russian, chinese, polish):
        assert html.main_text(page.format(text, text)) == f"{text} {text}"


def test_fit_equals_plain_dual_coordinate_descent():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, rng.integers(3, 15))).astype(np.int32) for _ in range(120)]
    y = np.array([int(np.isin(r, range(20)).sum() * 3 > len(r)) for r in rows])
    model = classifier.fit(rows, y)
    # plain form: count, ratio, then alpha by alpha until nothing moves
    count = np.ones((2, classifier.SIZE))
    for r, c in zip(rows, y, strict=True):
        count[c][r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    train = [i for i in range(120) if i % classifier.HELD_FOR_CURVE]
    sign, cost = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    dense = np.zeros((120, 61))
    for i, r in enumerate(rows):
        dense[i, r] = ratio[r] / np.sqrt(len(r))
    dense[:, 60] = 1
    alpha, w = np.zeros(120), np.zeros(61)
    for _ in range(2000):
        for i in train:
            new = np.clip(alpha[i] - (sign[i] * (w @ dense[i]) - 1) / (dense[i] @ dense[i]), 0, cost[i])
            w += (new - alpha[i]) * sign[i] * dense[i]
            alpha[i] = new

    def objective(v):
        return v @ v / 2 + sum(cost[i] * max(0.0, 1 - sign[i] * (v @ dense[i])) for i in train)

    mine = np.append(np.divide(model.weights[:60], ratio[:60], out=np.zeros(60), where=ratio[:60] != 0), model.intercept)
    assert objective(mine) < 1.15 * objective(w)
    assert np.corrcoef(dense @ mine, dense @ w)[0, 1] > 0.99


def test_classifier_takes_conflicts_repeats_and_empty_tables(spark):
    rows = [(i, "good words here" if i % 2 else "bad stuff there") for i in range(60)] + [(3, "other text")] * 2
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (7, None), (None, 1), (9, 3)], "doc_id bigint, quality int")
    one, two = (classifier.train(d, x, "quality") for d, x in ((docs, labels), (docs.repartition(5), labels.repartition(4))))
    assert np.array_equal(one.weights, two.weights) and (one.intercept, one.slope, one.shift) == (two.intercept, two.slope, two.shift)
    none = classifier.train(docs.limit(0), labels.limit(0), "quality")
    assert classifier.score(docs.limit(0), none).count() == 0
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}


def test_classifier_separates_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "cat"] if i % 2 else ["###", "buy", "now", "win"]) for _ in range(30))) for i in range(300)]
    docs = frame(spark, [*rows, (900, None), (901, "")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    model = classifier.train(docs, labels, "quality")
    got = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200, 300))
    assert 0 <= got[900] <= 1
    single = classifier.train(docs, labels.where("quality = 1"), "quality")
    assert classifier.score(docs, single).agg(F.min("score")).first()[0] > 0.5


def test_pipeline_equals_plain_python_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    prose = "The cat sat on the mat and looked at the dog that ran by the old house near the river."
    rows = [(i, f"{prose} Number {i} writes to a{i}@b.example about the {'very ' * (i % 5)}long day number {i * 7} of the {i * 13} year.", "s1" if i % 2 else "s2") for i in range(40)]
    rows += [(40 + i, corpus(9, 30)[i][1] + ". Mail x@y.example now.", "s3") for i in range(30)]
    rows += [(90, "short"), (91, None), (92, "Home | News | About | Help | More | Shop | Blog | Jobs | Press | Terms | Mail")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).select(*corpus_pipeline.COLUMNS)
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        seen.append(docs)
    assert all(x.columns == corpus_pipeline.COLUMNS for x in seen[:-1])
    first, second, third = ({r.doc_id: r.text for r in x.collect()} for x in seen[:3])
    assert set(range(40)) <= set(first) and not {90, 91, 92} & set(first)
    sets, ids = {i: brute.shingles(t) for i, t in first.items()}, sorted(first)
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert second == {i: first[i] for i, c in brute.classes(ids, links).items() if i == c}
    for i, text in second.items():
        for s, k, e in reversed(brute.base_spans(text)):
            text = text[:s] + f"<{brute.KINDS[k]}>" + text[e:]
        assert third[i] == text
    mixed = seen[3].collect()
    assert all(r.text == third[r.doc_id] and r.n_chars == len(r.text) for r in mixed)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, known.encode_ordinary(r.text)) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in seen[4].collect()) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in whole) == want


def test_pipeline_takes_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    text = "The cat sat on the mat and looked at the dog that ran by the old house near the river."
    frame(spark, [(1, text), (1, text), (2, text), (None, text + " And one more sentence of words stands here.")]).write.parquet(str(tmp_path / "some/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id for r in got} <= {1, None}
    assert sum(r.doc_id == 1 for r in got) <= 3
