"""Substring deduplication by sliding sentence spans.

A sentence ends at ``.``, ``!``, ``?``, ``…`` or an ideographic full stop, exclamation or
question mark (closing quotes and brackets may follow; the ASCII marks and ``…`` need white
space or the text's end behind them), and at a line break. White space does not count when
sentences are compared, nor does the case of A-Z. A span is a run of :data:`MIN_SENTENCES`
or more consecutive sentences with at least :data:`MIN_CHARS` characters besides white space. A
sentence goes if a span that covers it stands earlier: in a row before its own in the order
of id and text hash, or before it in its own row. A passage's first and last sentence, where
the text around it runs into them, are no sentences of the passage and stay.

Of every run only the shortest qualifying one from each sentence on, and the shortest one up to
each, are hashed (64 bits). That loses nothing: the sentences of a repeated run of any length
are covered by the shortest runs inside it, and those stand earlier where the run does.

1. A slice of rows finds, of each hash, its first row; rows after that are decided at once.
2. First rows meet by fragments of the hash order: one entry a slice for each hash, so a span of a
   third of all rows costs an entry a slice.
3. What is known of a row's spans joins the documents by id and text hash, and those rows cut
   their sentences. Texts are never sent to fragments.

Texts without a repeated span stay byte for byte. A null text counts as empty and stays null; a
null id comes after all others. Rows equal in id and text are one document: each gets the same
result. Ids may be of any type that sorts; other columns are left out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .hashing import U, mix, segments

MIN_SENTENCES, MIN_CHARS = 2, 80
#: Bytes of text for each fragment of the hash order, and for a slice of rows, about.
FRAGMENT, SLICE, LEAST_FRAGMENTS = 24 << 20, 1 << 20, 48
#: Bytes of text whose entries travel together.
TOGETHER = 8 << 20
_closing = rb"(?:[\"')\]}]|\xe2\x80[\x99\x9d]|\xc2\xbb|\xe3\x80[\x8d\x8f]|\xef\xbc\x89)*"
_end = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)" + _closing + rb"(?=[\x20\x09-\x0D]|\Z)|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])" + _closing + rb"|\n")


def sentence_ends(raw: bytes) -> list[int]:
    """The byte after each sentence of a text; the last one ends with the text."""
    ends = [m.end() for m in _end.finditer(raw)]
    if raw and (not ends or ends[-1] < len(raw)):
        ends.append(len(raw))
    return ends


class Spans:
    """Sentences and spans of some rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_sentences: int, min_chars: int) -> None:
        self.data, self.offsets = data, offsets
        per_row = [sentence_ends(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        count = np.array([len(x) for x in per_row], np.int64)
        row = np.repeat(np.arange(len(count)), count)
        ends = np.fromiter((e for x in per_row for e in x), np.int64, int(count.sum())) + offsets[row]
        h, chars = segments(data, ends)
        solid = chars > 0  # blank lines and the like belong to the sentence after, or to the row's last
        self.h, row = h[solid], row[solid]
        self.row_of = row
        self.n = np.bincount(row, minlength=len(count)).astype(np.int64)
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.n)))
        # a sentence reaches to the next one's begin, a row's last to its end
        self.end = ends[solid]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(chars[solid])))
        k = len(self.h)
        at = np.arange(k)
        begin, stop = self.first[:-1][row], self.first[1:][row]
        ahead = np.maximum(np.searchsorted(total, total[:-1] + min_chars), at + min_sentences)
        back = np.minimum(np.searchsorted(total, total[1:] - min_chars, "right") - 1, at + 1 - min_sentences)
        fits, fits_back = ahead <= stop, back >= begin
        a = np.concatenate((at[fits], back[fits_back]))
        b = np.concatenate((ahead[fits], at[fits_back] + 1))
        once = np.unique(a * (k + 1) + b)
        self.a, self.b = once // (k + 1), once % (k + 1)
        self.row = row[self.a]
        size = self.b - self.a
        self.hash = size.astype(np.uint64) * U(0xA0761D6478BD642F)
        left = np.arange(len(size))
        for j in range(int(size.max()) if len(size) else 0):
            left = left[size[left] > j]
            self.hash[left] += mix(self.h[self.a[left] + j] + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.hash = mix(self.hash)

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """Whether each sentence is in one of the chosen spans."""
        step = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(step, self.a[spans], 1)
        np.add.at(step, self.b[spans], -1)
        return np.cumsum(step)[:-1] > 0

    def without(self, row: int, gone: np.ndarray) -> bytes:
        """A row's bytes without the sentences that go."""
        p, q = self.first[row], self.first[row + 1]
        ends = self.end[p:q].copy()
        ends[-1] = self.offsets[row + 1]
        starts = np.concatenate((self.offsets[row : row + 1], ends[:-1]))
        return b"".join(self.data[s:e].tobytes() for s, e, g in zip(starts, ends, gone[p:q], strict=True) if not g)


def _firsts(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash and document, and the place in it of each entry's first document."""
    order = np.lexsort((doc, h))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)


def _ranks(key: pa.Array, t: np.ndarray) -> np.ndarray:
    """Numbers of documents in the order of key, null last, and text hash; equal ones share theirs."""
    dense = pc.rank(key, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((t, dense))
    new = np.zeros(len(t), np.int64)
    new[1:] = (dense[order][1:] != dense[order][:-1]) | (t[order][1:] != t[order][:-1])
    out = np.empty(len(t), np.int64)
    out[order] = np.cumsum(new)
    return out


def _grouped(group: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct groups, and each one's values as bytes."""
    by = np.argsort(group, kind="stable")
    names, starts = np.unique(group[by], return_index=True)
    ends = np.append(starts[1:], len(group))[: len(names)]
    return names, [[v[p:q].tobytes() for p, q in zip(starts, ends, strict=True)] for v in (v[by] for v in values)]


def _sent_schema(kind: pa.DataType) -> pa.Schema:
    # entries of a slice: hashes, whether the slice holds more of them, the document of each; the documents
    return pa.schema([("frag", pa.int32()), ("h", pa.binary()), ("flag", pa.binary()), ("doc", pa.binary()), ("key", pa.list_(kind)), ("t", pa.binary())])


def _send(n_frag: int, limits: tuple[int, int]):
    def flush(held: list, block: int, schema: pa.Schema) -> pa.RecordBatch:
        h, key, t = (np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held]))
        sizes = np.array([len(x[2]) for x in held])
        row = np.concatenate([x[3] + s for x, s in zip(held, np.cumsum(sizes) - sizes, strict=True)])
        doc = _ranks(key, t)
        some = np.zeros(doc.max() + 1 if len(doc) else 0, np.int64)
        some[doc] = np.arange(len(doc))  # a row of each document
        d = doc[row]
        order, lead = _firsts(h, d)
        s, d = h[order], d[order]
        first = lead == np.arange(len(s))
        more = np.bincount(lead, minlength=len(s)) > 1  # at the first entry: the slice holds another
        # rows after the first one's document are decided here
        later = d != d[lead]
        columns: list[list] = [[] for _ in schema]
        frag = ((s >> U(32)) * U(n_frag) >> U(32)).astype(np.int64)
        ends = np.searchsorted(frag[first], np.arange(n_frag + 1))
        hs, ds, ms = s[first], d[first], more[first].astype(np.uint8)
        for f in range(n_frag):
            p, q = ends[f], ends[f + 1]
            if p < q:
                names, same = np.unique(ds[p:q], return_inverse=True)
                rows = some[names]
                for c, x in zip(columns, (f, hs[p:q].tobytes(), ms[p:q].tobytes(), same.astype(np.uint32).tobytes(), key.take(pa.array(rows)), t[rows].tobytes()), strict=True):
                    c.append(x)
        names, values = _grouped(d[later], s[later])
        if len(names):
            lengths = np.array([len(x) // 8 for x in values[0]])
            mixed = int(mix(np.array([block], np.uint64))[0] % U(n_frag))
            body = (-1 - mixed, b"".join(values[0]), b"", np.repeat(np.arange(len(names)), lengths).astype(np.uint32).tobytes(), key.take(pa.array(some[names])), t[some[names]].tobytes())
            for c, x in zip(columns, body, strict=True):
                c.append(x)
        arrays = [pa.array(c, x.type) if x.name != "key" else _lists(c, x.type) for c, x in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema, held, size = TaskContext.get().partitionId() << 24, None, [], 0
        for batch in batches:
            schema = _sent_schema(batch.column(0).type)
            data, offsets = text_bytes(batch.column(2))
            t = batch.column(1).to_numpy()
            for i, j in slices(offsets, SLICE):
                spans = Spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *limits)
                held.append((spans.hash, batch.column(0)[i:j], t[i:j].copy(), spans.row))
                size += int(offsets[j] - offsets[i])
                if size >= TOGETHER:
                    yield flush(held, block, schema)
                    held, size, block = [], 0, block + 1
            pa.default_memory_pool().release_unused()
        if held:
            yield flush(held, block, schema)

    return run


def _lists(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts) if parts else pa.array([], kind.value_type))


def _meet(group: pa.Table) -> pa.Table:
    """One fragment: for each document, its spans that others hold too, and whether it is their first."""
    group = group.combine_chunks()
    keys = group.column("key").combine_chunks().flatten()
    t = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("t").to_pylist()])
    counts = pc.list_value_length(group.column("key")).to_numpy()
    h = [np.frombuffer(x, np.uint64) for x in group.column("h").to_pylist()]
    sizes = np.array([len(x) for x in h])
    h = np.concatenate(h)
    row = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("doc").to_pylist()]).astype(np.int64) + np.repeat(np.cumsum(counts) - counts, sizes)
    rank = _ranks(keys, t)
    some = np.zeros(rank.max() + 1, np.int64)
    some[rank] = np.arange(len(rank))
    doc = rank[row]
    if group.column("frag")[0].as_py() < 0:
        flag = np.ones(len(h), np.uint8)
    else:
        several = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("flag").to_pylist()])
        order, lead = _firsts(h, doc)
        h, doc = h[order], doc[order]
        held = np.bincount(lead, 1 + several[order], len(h))[lead]  # entries, and rows the slices know besides
        keep = held > 1
        flag = (doc != doc[lead]).astype(np.uint8)[keep]
        h, doc = h[keep], doc[keep]
    names, (hs, flags) = _grouped(doc, h, flag)
    rows = some[names]
    return pa.table({"key": keys.take(pa.array(rows)), "t": t[rows], "h": pa.array(hs, pa.binary()), "flag": pa.array(flags, pa.binary())})


def _remove(limits: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, SLICE):
                yield one(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            pa.default_memory_pool().release_unused()

    def one(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        spans = Spans(data, offsets, *limits)
        later, again = np.zeros(len(spans.hash), bool), np.zeros(len(spans.hash), bool)
        at = np.searchsorted(spans.row, np.arange(batch.num_rows + 1))
        for r, (hs, flags) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            if not hs.is_valid:
                continue
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in hs.as_py()])
            flag = np.concatenate([np.frombuffer(x, np.uint8) for x in flags.as_py()])
            mine = spans.hash[at[r] : at[r + 1]]
            known = np.isin(mine, h)
            seen = np.unique(mine, return_index=True)[1]
            repeat = np.ones(len(mine), bool)
            repeat[seen] = False  # its first place in the row
            again[at[r] : at[r + 1]] = known
            later[at[r] : at[r + 1]] = known & (np.isin(mine, h[flag > 0]) | repeat)
        gone, repeated = spans.covered(later), spans.covered(again)
        sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in (gone, repeated)]
        removed, held = (s[spans.first[1:]] - s[spans.first[:-1]] for s in sums)
        texts = batch.column(1).to_pylist() if removed.any() else None
        if texts is not None:
            for r in np.flatnonzero(removed):
                texts[r] = spans.without(r, gone).decode()
        text = batch.column(1) if texts is None else pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans.n), pa.array(held), pa.array(removed), text], names=["key", "n_sentences", "n_repeated", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(key, n_sentences, n_repeated, n_removed, text)`` for each row.

    ``text`` has lost the removed sentences. ``n_repeated`` counts those covered by any
    repeated span, in the row where it stands first too.
    """
    limits = (min_sentences, min_chars)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_frag = max(LEAST_FRAGMENTS, -(-size // FRAGMENT))
    sent = rows.mapInArrow(_send(n_frag, limits), f"frag int, h binary, flag binary, doc binary, key array<{kind}>, t binary")
    met = sent.groupBy("frag").applyInArrow(_meet, f"key {kind}, t bigint, h binary, flag binary")
    # a document's entries come from several fragments and slices; its own text bounds them
    known = met.groupBy("key", "t").agg(F.collect_list("h").alias("h"), F.collect_list("flag").alias("flag"))
    known = known.select(F.col("key").alias("_k"), F.col("t").alias("_t"), "h", "flag").hint("shuffle_hash")
    both = rows.join(known, F.col("key").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")), "left").select("key", "text", "h", "flag")
    out = both.mapInArrow(_remove(limits), f"key {kind}, n_sentences bigint, n_repeated bigint, n_removed bigint, text string")
    return out.withColumnRenamed("key", key).withColumnRenamed("text", text)
