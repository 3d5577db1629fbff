"""Quality flags, counts and forms on code points, against plain Python; what a pass holds."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from quillspark.functions import grams
from quillspark.functions import text as T

ALPHABETS = ["ab", "abc😀é \n", "abcdefghijklmnopqrstuvwxyz ", "".join(chr(0x4E00 + i) for i in range(3000)) + " 　", "xyz​￿\U0010ffff\x85\xa0\x1cAb0"]


def odd_texts(n=800):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "ab", "abc"]
    for _ in range(n):
        a = rng.choice(ALPHABETS)
        t = "".join(rng.choices(a, k=rng.choice([0, 1, 2, 3, 5, 9, 30, 100, 300])))
        if rng.random() < 0.4:
            t += "".join(rng.choices(a, k=rng.randint(1, 24))) * rng.randint(2, 4) + "".join(rng.choices(a, k=4))
        texts.append(t)
    return texts


def plain(text):
    c = re.sub(r"\s+", "", text or "")
    most = max(Counter(c[i : i + 5] for i in range(len(c) - 4)).values(), default=0)
    tests = (len(c) < 80, len(c) > 700, most >= 4, bool(re.search(r"(.{3,20})\1{2,}", c, re.DOTALL)))
    return c, most, [name for name, t in zip(T.FLAGS[1:], tests, strict=True) if t] if c else ["empty"]


@pytest.mark.parametrize("size", [50, 1 << 18])
def test_flags_of_whole_texts_as_in_python(monkeypatch, size):
    monkeypatch.setattr(grams, "SLICE", size)
    texts = odd_texts()
    want = [plain(t) for t in texts]
    rows = pa.array(["before", *texts]).slice(1)
    assert grams.flags(rows, T.FLAGS, 80, 700, 4, True).to_pylist() == [w[2] for w in want]
    places, kept = grams.unflagged(rows, 80, 700, 4)
    assert places.tolist() == [i for i, w in enumerate(want) if not w[2]]
    assert kept.to_pylist() == [want[i][0] for i in places]
    assert grams.changed(rows, grams.compacted).to_pylist() == [w[0] for w in want]
    forms = [re.sub("[^一-鿿A-Za-z0-9]", "", t or "").lower() for t in texts]
    assert grams.changed(rows, grams.overlap_forms).to_pylist() == forms


def peak_mb(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def long_texts():
    """A batch of 8 million characters."""
    rng = random.Random(5)
    return pa.array(["".join(rng.choices("abcdefghij klmnopqrst uvwxyz", k=4000)) for _ in range(50)] * 40)


def test_flag_counts_are_one_pass_without_patterns(spark, tmp_path):
    from quillspark.plans import registry

    spark.createDataFrame([(1, "a b" * 40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.quality_flag_counts(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan
    assert "rlike" not in plan
    assert {tuple(r) for r in rows.collect()} == {("repeated_5gram", 1), ("repeated_span", 1)}


def test_counts_hold_a_slice_and_not_the_batch(spark):
    from quillspark.operators import evaluation

    rows = long_texts()
    assert peak_mb(lambda: grams.most_frequent_count(rows, 5)) < 40
    found = evaluation.repetition(spark.createDataFrame([("ab" * 6,), ("a b " * 12,), (None,)], "t string"), "t")
    assert tuple(found.first()) == (3, 2, 1)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_flags_hold_a_slice_and_not_the_batch():
    rows = long_texts()
    assert peak_mb(lambda: grams.flags(rows, T.FLAGS, 80, 700, 4, True)) < 40
