"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings: a whole pre-token
that is in the vocabulary is one id. Tier two merges the bytes of the others: the parts
are a doubly linked list, and a heap gives the pair with the lowest rank, leftmost first.

Nulls encode as the empty text; an empty text has no ids. Repeated rows are encoded
each; other columns are left out of the result. A text is never cut, whatever its length.
"""

from __future__ import annotations

import base64
import heapq
import struct
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from .common import small

#: Bytes that a worker's remembered pre-tokens may take, about, in each of two generations;
#: what one entry takes besides its token and ids. A longer pre-token is not remembered.
REMEMBERED, ENTRY, LONGEST = 16 << 20, 200, 200
#: Characters from which on a text's pre-tokens are met one by one; ids decoded together.
LONG, TOGETHER = 1 << 16, 1 << 16
MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings: one slot for each key, no slot empty.

    Keys go to buckets by one hash; buckets, the largest first, get the first displacement
    that sends their keys to free slots. A stored key tells members from strangers.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.n = n = len(ranks)
        self.m = m = max(1, n // 3)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for key in ranks:
            x = xxh3_64_intdigest(key)
            buckets[x % m].append((x, key))
        self.shift = array("Q", bytes(8 * m))
        self.keys: list[bytes] = [b""] * n
        self.ranks = array("I", bytes(4 * n))
        free = np.ones(n, bool)
        for k in sorted(range(m), key=lambda k: -len(buckets[k])):
            if not buckets[k]:
                break
            x = [x for x, _ in buckets[k]]
            if len(set(x)) < len(x):
                raise ValueError("two keys of the vocabulary share their hash")
            d = 0
            while not free[slots := [self._slot(v, d) for v in x]].all() or len(set(slots)) < len(slots):
                d += 1
            free[slots] = False
            self.shift[k] = d
            for slot, (_, key) in zip(slots, buckets[k], strict=True):
                self.keys[slot], self.ranks[slot] = key, ranks[key]

    def _slot(self, x: int, d: int) -> int:
        return (((x ^ d * 0x9E3779B97F4A7C15) & MASK) * 0xD6E8FEB86659FD93 & MASK) * self.n >> 64

    def get(self, key: bytes) -> int:
        """The rank of ``key``, or -1."""
        x = xxh3_64_intdigest(key)
        slot = self._slot(x, self.shift[x % self.m])
        return self.ranks[slot] if self.keys[slot] == key else -1


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.hash = ranks, perfect
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for key, rank in ranks.items():
            self.bytes_of[rank] = key
        self.memory = _Memory(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry."""
        get, n, push, pop = self.ranks.get, len(piece), heapq.heappush, heapq.heappop
        after = list(range(1, n + 2))  # start of the next part; n ends the list
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = pop(heap)
            j = after[i]
            if j >= n or after[j] != end:
                continue  # one of the two parts has been merged since
            after[i], after[j] = end, n + 1
            before[end] = i
            if end < n and (r := get(piece[i : (k := after[end])])) is not None:
                push(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := get(piece[h:end])) is not None:
                push(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split.findall(text) if len(text) < LONG else (m.group() for m in self.split.finditer(text))
        return b"".join(map(self.memory.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memory(dict):
    """Ids of pre-tokens seen before, within a bound of bytes; a new one goes through the two tiers."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.older, self.room = codec, {}, REMEMBERED

    def __missing__(self, token: str) -> bytes:
        if (out := self.older.get(token)) is None:
            raw = token.encode()
            rank = self.codec.hash.get(raw)
            ids = [rank] if rank >= 0 else self.codec.merge(raw)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) < LONGEST:
            self.room -= ENTRY + len(token) + len(out)
            if self.room < 0:  # what is used again comes back from the older generation
                self.older, self.room = dict(self), REMEMBERED
                self.clear()
            self[token] = out
        return out


_codecs: dict = {}
_tables: dict = {}


def _cached(shared, digest: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary; its tables come as a broadcast."""
    if (key := (digest, pattern)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value, pattern)
    return _codecs[key]


def tables(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    """Ranks and perfect hash of a vocabulary file, built once in the driver."""
    if path not in _tables:
        ranks = read_ranks(path)
        _tables[path] = ranks, PerfectHash(ranks)
    return _tables[path]


def encode(docs: DataFrame, vocabulary: tuple[dict[bytes, int], PerfectHash], pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids and decoded bytes of each text.

    ``vocabulary`` (see :func:`tables`) is broadcast: its size is fixed, whatever the corpus.
    Result: key, ids array<int> (left out unless ``with_ids``), n_tokens, ids_sha256,
    decoded_sha256; a null text counts as empty, a null key stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    digest = sha256(repr(sorted(vocabulary[0].items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _cached(shared, digest, pattern)
        for batch in small(batches):
            n, ids_hash, text_hash, all_ids = [], [], [], []
            for value in batch.column(1):
                raw = codec.encode_bytes(value.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                ids_hash.append(sha256(raw).hexdigest())
                decoded = sha256()
                for k in range(0, len(ids), TOGETHER):
                    decoded.update(codec.decode(ids[k : k + TOGETHER].tolist()))
                text_hash.append(decoded.hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                out.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)
