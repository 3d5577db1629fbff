"""License scans: phrases by place, and an exact containment join with license templates.

DataFrame functions only. A text block is a window of :data:`BLOCK_WORDS` words, and one
begins at every :data:`STEP` words of the text: line breaks do not matter, and a statement of up to
``BLOCK_WORDS - STEP + 1`` words stands whole in some block. Blocks and templates are sets of
tokens in one global order, from the corpus-wide rarest on; of a block only template
tokens count. A block can contain the share :data:`CONTAINED` of a template only if it holds one of
the template's first ``n - need + 1`` tokens (prefix filter: blocks without any are
never made), holds at least ``need`` template tokens (length filter), and at least ``need`` of them
from the first one met on (positional filter: earlier ones are not the template's). What passes is counted
exactly. The templates are a fixed table, so the index over their prefixes is a literal and
the join runs inside each row: no shuffle, whatever the source's share.

A null text is empty: no words, no labels, score 0. Repeated rows are scanned each. The
order only decides how much is verified, never the result. Input columns named as one of
:data:`OWN` are replaced.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases looked for word by word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licenses and the statements they ask for, in words; a label may have several.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Part of a template's distinct tokens that a block must hold.
CONTAINED = 0.8
#: Words of a block, and from one block's begin to the next.
BLOCK_WORDS, STEP = 80, 40
#: Columns that the result adds.
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Not a word: ASCII other than letters and digits (after lower-casing A-Z).
NOT_WORD, IS_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def need(n: int, share: float = CONTAINED) -> int:
    """Tokens of an ``n``-token template that a block must hold."""
    return max(1, math.ceil(share * n - 1e-9))


def _words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def frequencies(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[str, int]:
    """Documents of the whole corpus that hold each template token; one row for each token comes back."""
    vocabulary = sorted({t for _, s in templates for t in s.split()})
    found = F.array_intersect(F.split(F.lower(F.col(text)), NOT_WORD), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(found).alias("t")).groupBy("t").count()
    return dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in counted.collect()}


def _any_of(words: list[str]) -> str:
    """A pattern that takes one of the words, longest first, testing no character twice."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [c + written(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return written(tree)


def _places(ws: Column, phrase: list[str], label: str) -> Column:
    """Where the words of a phrase stand one after another: ``(i, label)`` structs."""

    def here(i: Column) -> Column:
        out = F.get(ws, i) == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            out = out & (F.get(ws, i + j) == word)
        return out

    positions = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here)
    found = F.transform(positions, lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))
    return F.when(reduce(and_, (F.array_contains(ws, w) for w in phrase)), found).otherwise(F.array().cast("array<struct<i:bigint,label:string>>"))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINED) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    count = frequencies(docs, templates, text)
    order = {t: i for i, t in enumerate(sorted(count, key=lambda t: (count[t], t)))}
    sets = [(label, sorted(set(s.split()), key=order.__getitem__)) for label, s in templates]
    index: dict[str, list[tuple[int, int]]] = {}  # token: templates that it may be the first one met of
    for k, (_, tokens) in enumerate(sets):
        for i, t in enumerate(tokens[: len(tokens) - need(len(tokens), share) + 1]):
            index.setdefault(t, []).append((k, i))
    # only texts that hold a prefix token or a phrase's first word are taken apart
    first = sorted({*index, *(p.split()[0] for p in PHRASES)})
    edge = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hit = F.when(F.lower(value).rlike(rf"(?<![{edge}]){_any_of(first)}(?![{edge}])"), value)

    def struct(k: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(need(len(sets[k][1]), share)).alias("need"))

    lookup = F.create_map(*(x for t in sorted(index) for x in (F.lit(t), F.array(*(struct(k) for k, _ in index[t])))))
    all_sets = F.array(*(F.array(*map(F.lit, tokens)) for _, tokens in sets))
    ordered = F.array(*map(F.lit, order))  # every template token, rarest first
    prefix = F.array(*map(F.lit, sorted(index)))
    sizes = F.array(*(F.lit(len(tokens)) for _, tokens in sets))
    needed = F.array(*map(struct, range(len(sets))))

    def matches(ws: Column, block: Column) -> Column:
        """``(template, containment)`` of one block."""
        held = F.array_intersect(ordered, F.slice(ws, block * STEP + 1, F.lit(BLOCK_WORDS)))

        def near(t: Column, j: Column) -> Column:
            # length and positional filter: from the one met on, enough template tokens must follow in the block
            return F.filter(F.element_at(lookup, t), lambda c: F.size(held) - j >= c["need"])

        met = F.filter(F.transform(held, lambda t, j: F.when(F.array_contains(prefix, t), near(t, j))), lambda x: x.isNotNull())
        found = F.transform(F.array_distinct(F.flatten(met)), lambda c: F.struct(c["k"].alias("k"), F.size(F.array_intersect(held, F.element_at(all_sets, c["k"] + 1))).alias("m"), c["need"].alias("need")))
        return F.transform(F.filter(found, lambda c: c["m"] >= c["need"]), lambda c: F.struct(c["k"].alias("k"), (c["m"] / F.element_at(sizes, c["k"] + 1)).alias("c")))

    def possible(ws: Column) -> Column:
        """Whether the whole text holds enough tokens of any template: the length filter, once for all its blocks."""
        held = F.array_intersect(ordered, ws)
        return F.exists(needed, lambda c: F.size(F.array_intersect(F.element_at(all_sets, c["k"] + 1), held)) >= c["need"])

    def blocks(ws: Column) -> Column:
        """Blocks that hold a prefix token."""
        at = F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains(prefix, w), F.floor(i / STEP).cast("int"))), lambda x: x.isNotNull())
        before = F.filter(F.transform(at, lambda b: b - 1), lambda b: b >= 0)
        return F.array_union(at, before)

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in OWN])
    out = docs.withColumn("_hit", hit).withColumn("n_words", F.regexp_count(value, F.lit(IS_WORD)).cast("long"))
    out = out.withColumn("_ws", F.when(F.col("_hit").isNotNull(), _words(F.col("_hit"))))
    starts = [_places(F.col("_ws"), phrase.split(), label) for phrase, label in PHRASES.items()]
    none = F.array().cast("array<struct<i:bigint,label:string>>")
    out = out.withColumn("_base", F.coalesce(F.flatten(F.array(*starts)), none))
    empty = F.array().cast("array<struct<k:int,c:double>>")
    out = out.withColumn("_found", F.coalesce(F.when(possible(F.col("_ws")), F.flatten(F.transform(blocks(F.col("_ws")), lambda b: matches(F.col("_ws"), b)))), empty))
    label_of = F.array(*(F.lit(label) for label, _ in sets))
    base = F.array_sort(F.array_distinct(F.col("_base.label")))
    more = F.transform("_found", lambda c: F.element_at(label_of, c["k"] + 1))
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words",
        F.size("_base").cast("long").alias("n_base"), F.array_min(F.col("_base.i")).alias("first_word"), F.array_max(F.col("_base.i")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("_found.c")), F.lit(0.0))).alias("score"),
    )
    return out


def sql() -> str:
    """The same over the view ``documents``, every line against every template."""
    values = ", ".join(f"({k}, '{label}', {sorted(set(s.split()))}, {need(len(set(s.split())))})" for k, (label, s) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    return rf"""
with p(ph, label) as (values {phrases}), tp(k, label, ts, need) as (values {values}),
d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d),
b as (select doc_id, label, u.i - 1 as i from w, p, unnest(range(1, len(ws) + 1)) u(i) where ws[u.i : u.i + len(ph) - 1] = ph),
ln as (select doc_id, ws[u.i + 1 : u.i + {BLOCK_WORDS}] as lw from w, unnest(range(0, len(ws), {STEP})) u(i)),
m as (select doc_id, label, len(list_intersect(list_distinct(lw), ts)) / len(ts)::double as c from ln, tp where len(list_intersect(list_distinct(lw), ts)) >= need),
ba as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by doc_id),
la as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union select doc_id, label from m) group by doc_id),
ma as (select doc_id, max(c) as c from m group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(c, 0)::double end as score
from w left join ba using (doc_id) left join la using (doc_id) left join ma using (doc_id)"""
