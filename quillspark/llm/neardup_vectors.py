"""Embedding near-duplicates: PCA-ordered tiled comparison with early stopping.

Vectors are scaled to length 1 and turned to their principal axes, so the leading
dimensions hold most of what tells them apart. They are sorted along the first axis, written, and
cut into tiles. A tile goes to the workers (its size is fixed) and meets the tile itself and
the vectors after it, as far along the axis as the gap allows a link: the written table is
sorted, so the scan skips the rest. Nothing but what links is shuffled. Inside, dot
products grow by blocks of leading dimensions; after each block the rest of a product is at
most the product of the two suffix norms, and pairs whose bound cannot reach the threshold stop.
Pairs left at the end are decided by the dot product of the original vectors in double
precision over the product of their norms.

Equal vectors are compared once and counted as often as they stand. A tile and a batch of
vectors give each vector's number of links and a spanning forest, never the list of all links, so a group
of near copies costs rows in proportion to its size. Shuffle and disk are in proportion to the
vectors; the arithmetic is quadratic in the number of different vectors that lie close along the first axis.

Vectors that are null, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths never link: each length that two rows have is compared by itself. Rows that repeat an id with the
same vector count as links of each other; their ``vec_id`` is one node.
A null id stays null and is never a component's smallest id unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources import scratch

from .common import components, cut, drop, smallest

#: Vectors of a tile, at most; bytes of a tile, at most; dimensions accumulated between two bounds.
TILE, TILE_BYTES, STEPS = 8192, 16 << 20, (12, 20, 32)
#: Tiles that one job compares.
TILES_A_JOB = 8
#: Slack of the bounds, for rounding: pairs are decided by exact products alone.
SLACK = 1e-9
ROWS = 256
#: Bytes of vectors in one sorted file, about.
FILE_BYTES = 8 << 20


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of double precision, scaled by a power of two so that no norm overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def axes(vectors: DataFrame, column: str, dim: int) -> np.ndarray:
    """Principal axes, leading first, of the unit vectors; each batch sends one ``dim`` x ``dim`` sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, mean = np.zeros((dim, dim)), 0, np.zeros(dim)
        for batch in batches:
            x = _unit(batch.column(0), dim)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            total, n, mean = total + x.T @ x, n + len(x), mean + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()]), pa.array([mean.tobytes()])], names=["n", "s", "m"])

    got = vectors.select(column).mapInArrow(run, "n bigint, s binary, m binary")
    n, s, m = 0, np.zeros((dim, dim)), np.zeros(dim)
    for r in sorted(got.toLocalIterator(), key=lambda r: (r[0], bytes(r[1]))):  # one small matrix a partition, one at a time
        n, s, m = n + r[0], s + np.frombuffer(r[1]).reshape(dim, dim), m + np.frombuffer(r[2])
    values, vectors_ = np.linalg.eigh(s / max(1, n) - np.outer(m, m) / max(1, n) ** 2)
    return vectors_[:, np.argsort(-values)]


def _links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of two tiles; ``pa_`` and ``pb`` are the turned unit vectors."""
    dim = pa_.shape[1]
    cuts = [s for s in STEPS if s < dim]
    lead = cuts[0] if cuts else dim
    rest_a = [np.sqrt(np.maximum(0, (pa_[:, k:] ** 2).sum(1))) for k in cuts]
    rest_b = [np.sqrt(np.maximum(0, (pb[:, k:] ** 2).sum(1))) for k in cuts]
    out_i, out_j = [], []
    head = np.ascontiguousarray(pb[:, :lead].T)
    # |rest_a||rest_b| as one more dimension of the leading product
    if cuts:
        head = np.vstack([head, rest_b[0]])
    for at in range(0, len(pa_), ROWS):
        x = pa_[at : at + ROWS, :lead]
        if cuts:
            x = np.hstack([x, rest_a[0][at : at + ROWS, None]])
        i, j = np.nonzero(x @ head >= threshold - SLACK)
        i += at
        for p in range(0, len(i), 1 << 16):
            ii, jj = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            part, done = np.einsum("ij,ij->i", pa_[ii, :lead], pb[jj, :lead]), lead
            for k, ra, rb in zip(cuts[1:], rest_a[1:], rest_b[1:], strict=True):
                part = part + np.einsum("ij,ij->i", pa_[ii, done:k], pb[jj, done:k])
                keep = part + ra[ii] * rb[jj] >= threshold - SLACK
                ii, jj, part, done = ii[keep], jj[keep], part[keep], k
            u, v = a[ii], b[jj]
            cos = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
            keep = cos >= threshold
            out_i.append(ii[keep])
            out_j.append(jj[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row of ``vectors``."""
    # -0.0 becomes 0.0: equal numbers, equal bytes
    wide = vectors.schema[column].dataType.elementType.simpleString()
    kind = "float" if wide == "float" else "double"
    rows = vectors.select(F.col(f"`{key}`").alias("_key"), F.transform(F.col(f"`{column}`").cast(f"array<{kind}>"), lambda c: c + F.lit(0.0).cast(kind)).alias("_x"))
    ok = F.coalesce(F.col("_x").isNotNull() & ~F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("_x", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("_ok", ok)
    lengths = rows.where("_ok").groupBy(F.size("_x").alias("d")).count().where("count > 1").orderBy("d").collect()
    dims = [r[0] for r in lengths]
    good = (F.col("_ok") & F.size("_x").isin(dims)) if dims else F.lit(False)
    out = rows.where(~good).select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"), F.lit(True).alias("kept"))
    for dim in dims:
        out = out.union(_same_length(rows.where(F.col("_ok") & (F.size("_x") == dim)), key, dim, threshold, tile))
    return out


def _same_length(rows: DataFrame, key: str, dim: int, threshold: float, tile: int) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for rows ``(_key, _x)`` of usable vectors, all ``dim`` long."""
    spark = rows.sparkSession
    kind = rows.schema["_key"].dataType.simpleString()
    numbers = rows.schema["_x"].dataType.simpleString()
    # equal vectors once: smallest id, how many rows; two hashes name a vector
    name = [F.xxhash64(F.lit(i), "_x").alias(f"h{i}") for i in range(2)]
    once = cut(rows.select("_key", "_x", *name).groupBy("h0", "h1").agg(F.min("_key").alias("rep"), F.count("*").alias("k"), F.first("_x").alias("x")))
    turn = axes(once, "x", dim)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(4), dim)
            first = x / np.linalg.norm(x, axis=1)[:, None] @ turn[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=["h0", "h1", "rep", "k", "x", "first"])

    files = max(1, -(-once.count() * dim * 8 // FILE_BYTES))
    flat = once.mapInArrow(turned, f"h0 bigint, h1 bigint, rep {kind}, k bigint, x {numbers}, first double")
    flat = cut(flat.repartitionByRange(files, "first").sortWithinPartitions("first").withColumn("node", F.monotonically_increasing_id()))
    size = max(1, min(tile, TILE_BYTES // (8 * dim)))
    part = F.struct(F.shiftright("node", 33).alias("part"), F.expr(f"(node & {(1 << 33) - 1}) div {size}").alias("piece"))
    pieces = flat.groupBy(part.alias("tile")).agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max("first").alias("most"), F.count("*").alias("n"))
    tiles = _tiles(pieces.orderBy("a").collect(), size)
    gap = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    path = scratch.new_path(spark)
    columns = flat.select("node", "k", "x", "first")

    def met(a: int, b: int, most: float) -> DataFrame:
        """What one tile links with: itself and the vectors after it within the gap."""
        own = columns.where(F.col("node").between(a, b)).toArrow().combine_chunks()
        x = _unit(own.column("x").combine_chunks(), dim)
        shared = spark.sparkContext.broadcast((own.column("node").to_numpy(), own.column("k").to_numpy(), x))
        near = columns.where((F.col("node") >= a) & (F.col("first") <= most + gap))
        return near.mapInArrow(_compare(shared, turn, dim, threshold), "node bigint, links bigint, to bigint")

    for at in range(0, len(tiles), TILES_A_JOB):
        found = [met(*t) for t in tiles[at : at + TILES_A_JOB]]
        together = found[0]
        for more in found[1:]:
            together = together.union(more)
        together.write.mode("append").parquet(path)
    found = spark.read.schema("node bigint, links bigint, to bigint").parquet(path)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "to")
    nodes = flat.select("node", "h0", "h1", "rep", "k").join(counts, "node", "left").join(groups, "node", "left")
    nodes = cut(nodes.select("h0", "h1", "rep", "k", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = nodes.join(least, "root").select("h0", "h1", (F.col("links") + F.col("k") - 1).alias("n_links"), "component_id")
    drop(once)
    return rows.select("_key", *name).join(named, ["h0", "h1"], "left").select(
        F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )


def _tiles(pieces: list, size: int) -> list[tuple[int, int, float]]:
    """First and last node and farthest place of each tile: neighbouring pieces together, up to ``size`` vectors."""
    tiles: list[list] = []
    for r in pieces:
        if tiles and tiles[-1][3] + r.n <= size:
            tiles[-1][1:] = [r.b, max(tiles[-1][2], r.most), tiles[-1][3] + r.n]
        else:
            tiles.append([r.a, r.b, r.most, r.n])
    return [tuple(t[:3]) for t in tiles]


def _compare(shared, turn: np.ndarray, dim: int, threshold: float):
    """Vectors of a scan against one tile: links of each vector, and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, k, x = shared.value
        y = x / np.linalg.norm(x, axis=1)[:, None] @ turn
        links = np.zeros(len(nodes), np.int64)
        for batch in batches:
            for p in range(0, batch.num_rows, len(nodes)):
                part = batch.slice(p, len(nodes))
                theirs, many, v = part.column(0).to_numpy(), part.column(1).to_numpy(), _unit(part.column(2), dim)
                i, j = _links(v, x, v / np.linalg.norm(v, axis=1)[:, None] @ turn, y, threshold)
                after = theirs[i] > nodes[j]  # each pair once, no vector with itself
                i, j = i[after], j[after]
                links += np.bincount(j, many[i], len(nodes)).astype(np.int64)
                mine = np.bincount(i, k[j], len(theirs)).astype(np.int64)
                if len(i):
                    both, at = np.unique(np.concatenate((theirs[i], nodes[j])), return_inverse=True)
                    root = both[smallest(at[: len(i)], at[len(i) :], len(both))]
                    count = np.zeros(len(both), np.int64)
                    count[np.searchsorted(both, theirs[mine > 0])] = mine[mine > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(count), pa.array(root)], names=["node", "links", "to"])
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[some])], names=["node", "links", "to"])

    return run
