"""Text functions against hand-made cases that the driver's tables do not hold."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("甲　乙", "甲乙"), ("a b c\u0085d\u001ce\u000bf", "abcdef"), ("a​﻿b", "a​﻿b"), (None, ""), ("", "")],
)
def test_compact(spark, value, want):
    assert one(spark, value, T.compact) == want


def test_strip(spark):
    assert one(spark, " 　 x \n", T.strip) == "x"


def distinct_text(n):
    return "".join(chr(0x4E00 + i) for i in range(n))


@pytest.mark.parametrize(
    ("value", "flags"),
    [
        ("", ["empty"]),
        ("abcd", ["too_short"]),
        (distinct_text(79), ["too_short"]),
        (distinct_text(80), []),
        (distinct_text(700), []),
        (distinct_text(701), ["too_long"]),
        ("abc" * 40, ["repeated_5gram", "repeated_span"]),
        (distinct_text(90) + "".join("vwxyz" + chr(0x5800 + i) for i in range(3)), []),
        (distinct_text(90) + "".join("vwxyz" + chr(0x5800 + i) for i in range(4)), ["repeated_5gram"]),
    ],
)
def test_quality_flags(spark, value, flags):
    assert one(spark, value, T.quality_flags) == flags


@pytest.mark.parametrize(("value", "want"), [("abcabcabc", True), ("ababab", False), ("abcabc", False), ("xxxxxxxxx", True)])
def test_repeated_span(spark, value, want):
    assert one(spark, value, T.has_repeated_span) is want


@pytest.mark.parametrize(("value", "want"), [("Ａb L1正则，化?", "bl1正则化"), ("", ""), (None, "")])
def test_overlap_form(spark, value, want):
    assert one(spark, value, T.overlap_form) == want


@pytest.mark.parametrize(("value", "want"), [("", []), ("ab", ["ab"]), ("abc", ["abc"]), ("aaaa", ["aaa"])])
def test_char_ngrams(spark, value, want):
    assert one(spark, value, T.char_ngrams) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab😀é", max_size=30), min_size=1, max_size=20))
def test_ngram_ids_name_the_same_sets(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    number = lambda g: sum((ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    for t, ids in rows.select("t", T.char_ngram_ids(F.col("t"))).collect():
        t = t or ""
        want = {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else ({t} if t else set())
        assert ids == sorted(map(number, want))


def test_stable_id(spark):
    assert one(spark, "题", lambda c: T.stable_id("prompt", c)) == "prompt_c9d6c8a34855"


@pytest.mark.parametrize(("value", "want"), [(1.0, "Mid"), (1.01, "High"), (-1.0, "Low"), (-0.99, "Mid"), (None, "RM unavailable"), (float("nan"), "RM unavailable")])
def test_score_bucket(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(T.score_bucket(F.col("x"))).first()[0] == want


def test_jaccard_of_nothing(spark):
    assert spark.range(1).select(T.jaccard(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 0.0


def test_fill_prompt_leaves_out_empty_parts(spark):
    row = spark.createDataFrame([("q", None, "p")], "q string, i string, p string")
    assert row.select(T.fill_prompt(F.col("q"), F.col("i"), F.col("p"))).first()[0] == "问题：q\n期望要点：p\n回答："


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab😀é ", max_size=40), min_size=1, max_size=20))
def test_ngram_count_and_span_as_in_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = T.compact(F.col("t"))
    for t, n, hit in rows.select("t", T.max_ngram_count(c), T.has_repeated_span(c)).collect():
        plain = re.sub(r"\s+", "", t)
        grams = Counter(plain[i : i + 5] for i in range(len(plain) - 4))
        assert n == max(grams.values(), default=0)
        assert hit == bool(re.search(r"(.{3,20})\1{2,}", plain))
