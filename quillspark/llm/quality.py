"""Line-first quality rules.

Each line is judged by rules on punctuation, navigation, symbols, shouting and boilerplate;
lines that fail go, and a document that loses more than half its word characters is
rejected, as is one that fails the base rules (too few words, too much repetition).

A null or empty text has no words and is rejected; lines without words are never counted
as lost. Repeated rows are judged each, other columns stay untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, small

MIN_WORDS, MAX_REPEATED_PERCENT, MAX_LOST_PERCENT, WINDOW = 10, 20, 50, 5
#: Phrases of site furniture, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "log in to your account",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use of cookies",
)
#: Longest line, in words, that one boilerplate phrase can condemn.
BOILERPLATE_WORDS = 30
#: A line of prose ends in one of these, or has a sentence end for each so many words.
ENDS, PROSE_WORDS = r"""[.!?…:;"'”»)\]][\x20\x09-\x0D]*$""", 60
SENTENCE_END, BARS, SYMBOLS, SHOUTS = r"[.!?]([\x20\x09-\x0D]|$)", r"[|›»·•]", r"[#*$%&<>]", r"!!"

_word, _ends, _sentence = re.compile(WORD), re.compile(ENDS), re.compile(SENTENCE_END)
_bars, _symbols, _phrases = re.compile(BARS), re.compile(SYMBOLS), re.compile("|".join(map(re.escape, BOILERPLATE)))
_counted = re.compile(r"[#*$%&|<>]")


def line_fails(line: str, n_words: int) -> bool:
    """The rules for one line that has ``n_words`` words (at least one)."""
    if not _ends.search(line.rstrip(" \t\n\v\f\r")[-1:]) and len(_sentence.findall(line)) * PROSE_WORDS < n_words:
        return True  # no sentence: a heading, a menu entry, a list of links
    if len(_bars.findall(line)) * 4 > n_words or len(_symbols.findall(line)) > n_words:
        return True
    if line.count("!!") * 2 > n_words and n_words > 2:
        return True
    return n_words <= BOILERPLATE_WORDS and bool(_phrases.search(line.translate(_lower)))


_lower = {c: c + 32 for c in range(65, 91)}


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    seen: set[str] = set()
    clean: list[str] = []
    ids: list[int] = []
    number: dict[str, int] = {}
    chars = dup = lost = 0
    for line in text.split("\n"):
        words = _word.findall(line)
        if words:
            ids += [number.setdefault(w, len(number)) for w in words]
            size = sum(map(len, words))
            chars += size
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, len(words)):
                lost += size
                continue
        clean.append(line)
    n = len(ids)
    repeated = 0
    windows = list(zip(*(ids[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        until = 0  # words up to here are counted
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + WINDOW - max(i, until)
                until = i + WINDOW
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * chars
    return n, chars, len(_counted.findall(text)), dup, repeated, failed, kept, "\n".join(clean)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Measures and verdict for each row: key, the base counts, base_failed, kept and the cleaned text."""
    names = [key, *MEASURES[: 8 if with_text else 7]]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                for column, x in zip(out, judge(value.as_py() or ""), strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    return docs.select(key, text).mapInArrow(run, schema + ", clean_text string" * with_text)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with failing lines removed; all columns of ``docs`` stay."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep, texts = [], []
            for i, value in enumerate(batch.column(at)):
                *_, kept, cleaned = judge(value.as_py() or "")
                if kept:
                    keep.append(i)
                    texts.append(cleaned)
            rest = batch.take(pa.array(keep, pa.int32()))
            columns = [pa.array(texts, pa.string()) if k == at else rest.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def sql() -> str:
    """The same over the view ``documents``."""
    phrases = "|".join(x.replace(".", r"\.") for x in BOILERPLATE)
    q = lambda x: x.replace("'", "''")
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws from d),
ln as (select doc_id, u.i as i, string_split(t, chr(10))[u.i] as line
       from d, unnest(range(1, len(string_split(t, chr(10))) + 1)) u(i)),
lw as (select *, regexp_extract_all(line, '{WORD}') as ws,
              row_number() over (partition by doc_id, line order by i) as nth from ln),
lf as (select doc_id, nth, len(ws) as n, coalesce(list_sum([length(x) for x in ws]), 0) as size, line from lw where len(ws) > 0),
lr as (select *, (not regexp_matches(line, '{q(ENDS)}')
                  and len(regexp_extract_all(line, '{SENTENCE_END}')) * {PROSE_WORDS} < n)
               or len(regexp_extract_all(line, '{BARS}')) * 4 > n
               or len(regexp_extract_all(line, '{SYMBOLS}')) > n
               or (n > 2 and len(regexp_extract_all(line, '{SHOUTS}')) * 2 > n)
               or (n <= {BOILERPLATE_WORDS} and regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{phrases}')) as fails
       from lf),
la as (select doc_id, sum(size) as word_chars, count(*) filter (nth > 1) as dup,
              coalesce(sum(size) filter (fails), 0) as lost from lr group by doc_id),
g as (select doc_id, u.i as i, ws[u.i : u.i + 4] as win from w, unnest(range(1, len(ws) - 3)) u(i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as k from g) where k > 1),
rw as (select doc_id, count(distinct i + o.k) as rep from r, unnest(range(0, 5)) o(k) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
             coalesce(dup, 0)::bigint as n_dup_lines, coalesce(rep, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
      from w left join la using (doc_id) left join rw using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * lost <= {MAX_LOST_PERCENT} * word_chars as kept
from b"""
