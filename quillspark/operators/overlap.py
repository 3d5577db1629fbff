"""Lexical overlap between evaluation and training texts."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import grams as G
from quillspark.functions import text as T
from quillspark.sources import scratch

#: Pool and report sizes, n-gram length, similarity that is flagged.
POOL, TOP, N, FLAGGED = 20, 3, 3, 0.45
#: N-grams of evaluation rows in one block (8 bytes each, and as much again to look them up):
#: what goes to the workers at once, however many rows there are.
BLOCK_GRAMS = 2_000_000
#: Cells of a table of training rows by evaluation rows.
CELLS = 2_000_000


def gram_sets(rows: DataFrame, key: str, text: str, n: int = N) -> DataFrame:
    """``(key, text, form, grams, size)``: the text, its normalised form and its n-gram set, once for each row."""
    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), T.overlap_form(F.col(text)).alias("form"))
    return out.withColumn("grams", T.char_ngram_ids(F.col("form"), n)).withColumn("size", F.size("grams"))


def pool(evaluation: DataFrame, training: DataFrame, most: int = POOL, n: int = N) -> DataFrame:
    """The ``most`` training rows of highest Jaccard for each evaluation row, ties by training key.

    Both sides are gram sets of ``n``. The evaluation rows are a query set and go to the workers in
    blocks of a counted size, as an index from n-gram to rows; every training row counts what
    it shares with all rows of the block at once. Its own grams are made from the text where they
    are counted, a slice of characters at a time: sets are many times their texts and are neither
    handed on nor held for a batch. A row too large or small to reach any full pool is passed by.
    A task hands on its own best ``most`` a question, so what is shuffled follows the questions,
    whatever grams are frequent.
    Training rows without a common gram fill up short pools in key order: for those only the
    first ``most`` keys and the pool itself matter.
    """
    e = evaluation.select(F.col("key").alias("eval_key"), "grams", "size").where("size > 0 AND eval_key IS NOT NULL")
    t = training.select(F.col("key").alias("train_key"), "text").where("train_key IS NOT NULL")
    kinds = e.schema["eval_key"].dataType.simpleString(), t.schema["train_key"].dataType.simpleString()
    n_blocks = max(1, -(-(e.agg(F.sum("size")).first()[0] or 0) // BLOCK_GRAMS))
    best = None
    for block in range(n_blocks):
        part = e.where(F.pmod(F.xxhash64("eval_key"), F.lit(n_blocks)) == block) if n_blocks > 1 else e
        found = t.mapInArrow(_best(_index(part), most, n), f"eval_key {kinds[0]}, train_key {kinds[1]}, ngram_jaccard double")
        best = found if best is None else best.union(found)
    rank = F.row_number().over(Window.partitionBy("eval_key").orderBy(F.desc("ngram_jaccard"), "train_key"))
    best = best.withColumn("pool_rank", rank).where(F.col("pool_rank") <= most).drop("pool_rank")
    # rows without a common gram: if a pool is short, all that share one are in it, and of the
    # first keys at most as many again can be needed
    spare = training.select(F.col("key").alias("train_key")).orderBy("train_key").limit(2 * most)
    fill = evaluation.select(F.col("key").alias("eval_key")).crossJoin(F.broadcast(spare)).withColumn("ngram_jaccard", F.lit(0.0))
    both = best.unionByName(fill).groupBy("eval_key", "train_key").agg(F.max("ngram_jaccard").alias("ngram_jaccard"))
    return both.withColumn("pool_rank", rank).where(F.col("pool_rank") <= most)


def _index(part: DataFrame):
    """A broadcast of one block: keys, set sizes, distinct grams, and the rows that hold each."""
    got = part.select("eval_key", "grams").toArrow().combine_chunks()
    grams = got.column("grams").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(grams.offsets.to_numpy()) if got.num_rows else np.zeros(0, np.int64)
    flat = grams.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    values, starts = np.unique(flat[order], return_index=True)
    holders = np.repeat(np.arange(len(sizes)), sizes)[order].astype(np.int32)
    spark = part.sparkSession
    return spark.sparkContext.broadcast((got.column("eval_key").combine_chunks() if got.num_rows else got.column("eval_key"), sizes, values, np.append(starts, len(flat)), holders))


def _best(shared, most: int, size: int):
    def prune(eval_, score, order, keys):
        """The best ``most`` of each evaluation row, ties by key."""
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        by = np.lexsort((rank[order], -score, eval_))
        first = np.searchsorted(eval_[by], np.arange(eval_.max() + 2 if len(eval_) else 1))
        keep = by[np.arange(len(by)) - first[eval_[by]] < most]
        return eval_[keep], score[keep], keys[order[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, values, starts, holders = shared.value
        n = len(sizes)
        if not n:
            return
        rows = max(1, CELLS // n)
        held: list[tuple] = []
        least, kind = np.zeros(n), None
        for kind, keys, own_sizes, flat in _sets(batches, size):
            # of two sets the smaller is at most the shared part, the larger at least the union
            near = np.zeros(len(keys), bool)
            for i in range(0, len(keys), rows):
                part = own_sizes[i : i + rows, None]
                near[i : i + rows] = ((np.minimum(part, sizes) / np.maximum(part, sizes) >= least) & (part > 0)).any(1)
            flat, keys, own_sizes = flat[np.repeat(near, own_sizes)], keys[near], own_sizes[near]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(own_sizes)))
            for i in range(0, len(keys), rows):
                j = min(i + rows, len(keys))
                g = flat[ends[i] : ends[j]]
                own = np.repeat(np.arange(j - i), own_sizes[i:j])
                spot = np.minimum(np.searchsorted(values, g), len(values) - 1)
                hit = values[spot] == g
                spot, own = spot[hit], own[hit]
                shares = np.zeros((j - i) * n, np.int64)
                for p in range(0, len(spot), 1 << 14):  # postings of some grams at once
                    s, w = spot[p : p + (1 << 14)], own[p : p + (1 << 14)]
                    count = starts[s + 1] - starts[s]
                    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[s], count)
                    cell = np.repeat(w * n, count) + holders[at]
                    shares += np.bincount(cell, minlength=len(shares)) if len(cell) * 4 > len(shares) else _few(cell, len(shares))
                shares = shares.reshape(j - i, n)
                both = own_sizes[i:j, None] + sizes[None, :] - shares
                score = shares / both
                r, q = np.nonzero((shares > 0) & (score >= least[None, :]))
                held.append((q, score[r, q], keys[i + r]))
                if sum(len(x[0]) for x in held) > 4 * most * n:
                    held = [_prune_all(held, prune)]
                    q, s = held[0][0], held[0][1]
                    full = np.bincount(q, minlength=n) >= most
                    worst = np.full(n, np.inf)
                    np.minimum.at(worst, q, s)
                    least = np.where(full, worst, 0.0)
        if held:
            q, s, k = _prune_all(held, prune)
            for p in range(0, len(q), 10_000):
                part = slice(p, p + 10_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[part])), pa.array(k[part].tolist(), kind), pa.array(s[part])], names=["eval_key", "train_key", "ngram_jaccard"])

    return run


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """The key type, keys, set sizes and sets of some (key, text) rows after others."""
    for batch in batches:
        keys, at = np.array(batch.column(0).to_pylist(), dtype=object), 0
        for points, offsets in G.slices(batch.column(1)):
            flat, sizes = G.sets(*G.overlap_forms(points, offsets), n)
            yield batch.column(0).type, keys[at : at + len(sizes)], sizes, flat
            at += len(sizes)


def _few(cell: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, cell, 1)
    return out


def _prune_all(held: list[tuple], prune) -> tuple:
    q, s, k = (np.concatenate([x[i] for x in held]) for i in range(3))
    return prune(q, s, np.arange(len(k)), k)


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def sequence_similarity(left: str, right: str):
    """Ratcliff-Obershelp ratio, evaluation text first: it is not symmetric."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _ratio(a, b)

    return F.pandas_udf(run, "double")(left, right)


def matches(evaluation: DataFrame, training: DataFrame, most: int = POOL, top: int = TOP) -> DataFrame:
    """The ``top`` matches of each evaluation row by the larger of the two similarities, ties by pool order.

    The sequence ratio, one row at a time in Python, sees only the pools.
    """
    return best_matches(with_ratio(pool(evaluation, training, most), evaluation, training), top)


def with_ratio(found: DataFrame, evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """A pool with ``sequence_similarity``; it is written first, so that no training text is shuffled to meet it."""
    found = training.select(F.col("key").alias("train_key"), F.col("text").alias("_t")).join(scratch.few(found), "train_key")
    found = found.join(evaluation.select(F.col("key").alias("eval_key"), F.col("text").alias("_e")), "eval_key")
    found = found.withColumns({c: T.overlap_form(F.col(c)) for c in ("_e", "_t")})
    # pairs cost as their texts are long: deal them out evenly, whatever the key
    found = found.repartition(found.sparkSession.sparkContext.defaultParallelism, F.xxhash64("eval_key", "train_key"))
    return found.withColumn("sequence_similarity", sequence_similarity("_e", "_t")).drop("_e", "_t")


def best_matches(found: DataFrame, top: int = TOP) -> DataFrame:
    """The report rows of pools that have both similarities."""
    found = found.withColumn("max_similarity", F.greatest("sequence_similarity", "ngram_jaccard"))
    rank = F.row_number().over(Window.partitionBy("eval_key").orderBy(F.desc("max_similarity"), "pool_rank"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("eval_key", "rank", "train_key", "sequence_similarity", "ngram_jaccard", "max_similarity", F.lit("pending").alias("manual_review"))


def flagged(found: DataFrame, least: float = FLAGGED) -> DataFrame:
    """First matches at or above the threshold."""
    return found.where((F.col("rank") == 1) & (F.col("max_similarity") >= least))


def flagged_count(found: DataFrame, least: float = FLAGGED) -> DataFrame:
    first = found.where("rank = 1")
    return first.agg(F.count_if(F.col("max_similarity") >= least).alias("flagged"), F.count("*").alias("questions"))
