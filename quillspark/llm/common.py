"""Shared pieces: word pattern, scratch tables, Arrow helpers, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.scratch import cut, drop

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the offsets of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Views of the batches with fewer rows each, so that results stay small; freed memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about ``most`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


#: Rows for each task of a small shuffled table, about.
TASK_ROWS = 250_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than a table of about ``rows`` rows needs; a large one keeps all."""
    return df.coalesce(max(8, rows // TASK_ROWS))


#: Edges that one task may hold.
ONE_TASK = 1_000_000


def smallest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the edges ``(i, j)``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of the partition."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = nodes[smallest(at[: len(a)], at[len(a) :], len(nodes))]
        for k in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(root[k : k + 10_000])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: one row ``(node, root)`` for each node of ``edges``.

    ``root`` is the smallest node reachable. Alternates large-star and small-star, each
    a minimum by key (combined before the shuffle) and a join, until nothing changes;
    every round is written to the shared folder. Null ends and self-links are ignored.
    A graph of integer nodes whose counted edges fit one small task (``ONE_TASK`` of them,
    16 bytes each) takes one pass of that task instead of the rounds: same result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.schema["a"].dataType.simpleString() == "bigint" and e.count() <= ONE_TASK:
        return e.coalesce(1).mapInArrow(_forest, "node bigint, root bigint")
    while True:
        rows = 2 * e.count()
        # large star: larger neighbours of each node go to the least of its neighbourhood
        n = e.union(e.select("b", "a"))
        least = few(n.groupBy("a").agg(F.min("b").alias("m")), rows).select("a", F.least("a", "m").alias("m"))
        large = few(n.join(least, "a"), rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = cut(large)  # a pair twice does no harm
        # small star: a node and its smaller neighbours go to the least of them
        least = few(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        small = few(large.join(least, "a"), rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = cut(few(small.union(least.select("a", F.col("m").alias("b"))).distinct(), rows))
        drop(large)
        # done when every node has one link and no root has any
        state = nxt.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(nxt.select("b", F.lit(0), F.lit(1)))
        state = few(state.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")), rows)
        drop(e)
        e = nxt
        if state.where("up > 1 OR up > 0 AND down > 0").limit(1).isEmpty():
            break
    roots = few(e.select(F.col("b").alias("node")).distinct(), rows).select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
