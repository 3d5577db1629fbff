"""Text functions as Column expressions, inside the JVM but for n-grams, quality flags and overlap forms (Arrow and NumPy)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import grams

#: Fixed value: every white-space character of Unicode, and the four ASCII separators.
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: a span of 3 to 20 characters, three times or more in a row.
REPEATED_SPAN = r"(.{3,20})\1{2,}"
#: Order and names of the quality flags.
FLAGS = ("empty", "too_short", "too_long", "repeated_5gram", "repeated_span")
#: Characters that end a sentence naturally (our own definition).
SENTENCE_ENDS = "。！？.!?…\"”）)"


def compact(text: Column) -> Column:
    """The text without any white space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text; blanks count as values."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def stable_id(prefix: str, text: Column) -> Column:
    """Prefix and the first 12 hex digits of the text's SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(text), 1, 12))


def overlap_form(text: Column) -> Column:
    """Lower-case text with CJK ideographs, ASCII letters and digits only; null: empty."""

    def run(x: pa.Array) -> pa.Array:
        return grams.changed(x, grams.overlap_forms)

    return F.arrow_udf(run, "string")(text)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def all_ngrams(text: Column, n: int) -> Column:
    """Every run of ``n`` characters, repeats included; none for shorter texts."""

    def grams(chars: Column) -> Column:
        last = F.size(chars) - (n - 1)
        joined = F.transform(chars, lambda x, i: F.concat(x, *(F.get(chars, i + k) for k in range(1, n))))
        return F.when(last >= 1, F.slice(joined, 1, last)).otherwise(F.array().cast("array<string>"))

    return bind(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), grams)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of ``n``-character runs; a shorter text is its own only member, an empty one has none."""
    short = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) >= n, F.array_distinct(all_ngrams(text, n))).otherwise(short)


def char_ngram_ids(text: Column, n: int = 3) -> Column:
    """The same set as numbers, ascending: what joins and counts use. Exact up to ``n`` = 3."""

    def run(x: pa.Array) -> pa.Array:
        return grams.distinct(x, n)

    return F.arrow_udf(run, "array<bigint>")(text)


def max_ngram_count(text: Column, n: int = 5, whole: bool = False) -> Column:
    """How often the most frequent ``n``-character run stands in a text; none: 0. ``whole``: of its compact form."""

    def run(x: pa.Array) -> pa.Array:
        return grams.most_frequent_count(x, n, whole)

    return F.arrow_udf(run, "int")(text)


def has_repeated_span(text: Column) -> Column:
    return text.rlike(REPEATED_SPAN)


def quality_flags(text: Column, min_chars: int = 80, max_chars: int = 700, repeats: int = 4, whole: bool = False) -> Column:
    """Names of the rules a compacted text breaks, in fixed order; an empty one breaks that rule alone.

    ``whole``: the text is compacted first, in the same pass.
    """

    def run(x: pa.Array) -> pa.Array:
        return grams.flags(x, FLAGS, min_chars, max_chars, repeats, whole)

    return F.arrow_udf(run, "array<string>")(text)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity from set sizes; 0 for two empty sets."""
    union = left + right - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def score_bucket(score: Column) -> Column:
    """High above 1, Mid above -1, else Low; null and NaN are no score."""
    absent = score.isNull() | F.isnan(score)
    return F.when(absent, "RM unavailable").when(score > 1.0, "High").when(score > -1.0, "Mid").otherwise("Low")


def score_text(score: Column) -> Column:
    """A signed score with two decimals."""
    return F.when(score.isNull(), "RM unavailable").otherwise(F.format_string("%+.2f", score))


def chatml(question: Column) -> Column:
    """One user turn in ChatML, open for the assistant."""
    return F.concat(F.lit("<|im_start|>user\n"), question, F.lit("\n<|im_end|>\n<|im_start|>assistant\n"))


def chat_template(messages: Column, open_turn: bool = True) -> Column:
    """Any list of (role, content) in ChatML."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("\n<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n" if open_turn else ""))


def reward_input(question: Column, answer: Column, form: str = "question_answer") -> Column:
    """What a reward model reads: labelled lines, chat turns, or two paragraphs."""
    if form == "question_answer":
        return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)
    if form == "chat":
        turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
        return chat_template(F.array(turn("user", question), turn("assistant", answer)), False)
    if form == "paragraphs":
        return F.concat(question, F.lit("\n\n"), answer)
    raise ValueError(f"unknown form: {form}")


def fill_prompt(question: Column, intent: Column, points: Column) -> Column:
    """The completion prompt; parts without text are left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("问题："), F.coalesce(question, F.lit("")), F.lit("\n"), line("考察意图：", intent), line("期望要点：", points), F.lit("回答："))


def with_shots(instructions: str, shots: list[tuple[str, str]]) -> str:
    """A system text: instructions, then worked examples of question and answer in the prompt's own form."""
    examples = "\n\n".join(f"问题：{q}\n回答：{a}" for q, a in shots)
    return f"{instructions}\n\n{examples}" if shots else instructions


def system_messages(system: str, prompt: Column) -> Column:
    """A system turn and a user turn as a message list."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", prompt))


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters for logs and messages, with an ellipsis where something is left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def ends_naturally(text: Column) -> Column:
    """Whether the last visible character ends a sentence."""
    return F.right(strip(F.coalesce(text, F.lit(""))), F.lit(1)).isin(*SENTENCE_ENDS)
