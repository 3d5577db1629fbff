"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Documents are sets of hashed word n-grams (64 bits). Equal sets are one class; the join
runs between classes.

1. Hash order, cut into fragments: each fragment meets its part of all sets and tells which
   n-grams more than one set holds; a set's partial counts are summed over the fragments.
   A set with fewer shared n-grams than the threshold needs links with nothing and stops here.
   A block of rows sends each of its n-grams once, so a frequent one costs a row a block.
2. The same fragments, over the sets that are left, give exact document frequencies: the global order is
   by frequency, then hash. Each set's prefix in that order keeps its shared n-grams.
3. In the bucket of an n-gram the most typical set is the leader and meets every other one;
   afterwards sets of a bucket that are still in different components meet each other,
   under length and positional filters. A bucket of near copies thus costs its size, not
   its square, and no link between components is missed.
4. Candidates are counted fragment by fragment, the partial overlaps summed per pair, and the
   sum decides.

A null text, or one without words, has no n-grams and links with nothing: its component is
its own id. A text with fewer words than an n-gram is one n-gram. Rows that repeat an id are
members of their texts' classes; a null id never names a component unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, drop, few, slices, text_bytes
from .hashing import U, mix, shingles, words

K, PERCENT = 5, 80
#: Bytes of text for each fragment of the order, about; bytes of text a block of rows holds.
FRAGMENT, BLOCK = 12 << 20, 4 << 20
#: Fragments in which a pair's overlap is counted.
PAIR_FRAGMENTS = 4
#: Keys up to this many (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs a round may list, as a multiple of the prefix rows, before another round of leaders comes first.
PAIRS_PER_ROW, MOST_ROUNDS = 1, 4
#: Leaders of a bucket in a round after the first.
LEADERS = 8


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, and where each row's begin."""
    parts, starts, at = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets, 1 << 19):
        h, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        s, begin = shingles(h, first, k)
        parts.append(s)
        starts.append(begin[1:] + at)
        at += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(starts)


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets, equal numbers."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)))))
    return mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64) * U(0x14057B7EF767814F))


def _fragment(h: np.ndarray, n: int) -> np.ndarray:
    """The fragment of the hash order; rises with the hash."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def _block_ids() -> Iterator[int]:
    k, part = 0, TaskContext.get().partitionId()
    while True:
        yield (part << 24) + k
        k += 1


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, start, end)`` of each run of equal values."""
    if len(sorted_):
        at = np.flatnonzero(np.diff(sorted_)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), len(sorted_)], strict=True):
            yield int(sorted_[a]), a, b


_SENT = pa.schema([("frag", pa.int32()), ("block", pa.int64()), ("many", pa.binary()), ("one", pa.binary()), ("row", pa.binary()), ("key", pa.list_(pa.int64())), ("t", pa.binary()), ("cls", pa.binary()), ("n", pa.binary()), ("shared", pa.binary())])
_SENT_SQL = "frag int, block bigint, many binary, one binary, row binary, key array<bigint>, t binary, cls binary, n binary, shared binary"


def _send(n_frag: int, k: int):
    """Rows of text to fragments: hashes that several sets of the block hold, hashes that one does (and which), the block's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _block_ids()
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets, BLOCK):
                h, begin = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n, block = np.diff(begin), next(ids)
                cls = signatures(h, begin)
                _, first, same = np.unique(cls, return_index=True, return_inverse=True)
                row = np.repeat(np.arange(j - i), n)
                lone = np.zeros(j - i, bool)
                lone[first] = True
                keep = lone[row]  # equal sets of the block once
                h, row = h[keep], row[keep]
                order = np.argsort(h, kind="stable")
                new = np.ones(len(h), bool)
                new[1:] = h[order][1:] != h[order][:-1]
                group = np.cumsum(new) - 1
                several = np.zeros(len(h), bool)
                several[order] = (np.bincount(group, minlength=1) > 1)[group] if len(h) else several
                shared = np.bincount(row[several], minlength=j - i)[first][same]
                out = {name: [] for name in _SENT.names}

                def put(**values) -> None:
                    for name in out:
                        out[name].append(values.get(name))

                many = np.unique(h[several])
                many_at = {f: (a, b) for f, a, b in _runs(_fragment(many, n_frag))}
                h, row = h[~several], row[~several]
                frag = _fragment(h, n_frag)
                order = np.argsort(frag.astype(np.uint16) if n_frag < 65536 else frag, kind="stable")  # by row within a fragment
                h, row, frag = h[order].astype(np.uint32), row[order], frag[order]
                one_at = {f: (a, b) for f, a, b in _runs(frag)}
                for f in sorted({*many_at, *one_at}):
                    a, b = one_at.get(f, (0, 0))
                    c, d = many_at.get(f, (0, 0))
                    put(frag=f, block=block, many=many[c:d].astype(np.uint32).tobytes(), one=h[a:b].tobytes(), row=np.diff(row[a:b], prepend=0).astype(np.uint32).tobytes())
                put(
                    frag=-1 - int(mix(np.array([block], np.uint64))[0] % U(n_frag)), block=block, key=batch.column(0)[i:j].to_pylist(), t=batch.column(1)[i:j].to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    cls=cls.astype(np.uint64).tobytes(), n=n.astype(np.int64).tobytes(), shared=shared.astype(np.int64).tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in _SENT], schema=_SENT)
                pa.default_memory_pool().release_unused()

    return run


def _count_fragment(group: pa.Table) -> pa.Table:
    """One fragment: for each block, how many of its rows' lone hashes other blocks hold too."""
    group = group.combine_chunks()
    if group.column("frag")[0].as_py() < 0:
        return group.drop_columns(["frag", "many", "one"])
    blob = lambda name: [np.frombuffer(x or b"", np.uint32) for x in group.column(name).to_pylist()]
    many, one, rows = np.unique(np.concatenate(blob("many"))), blob("one"), blob("row")
    sizes = np.array([len(x) for x in one])
    h = np.concatenate(one)
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= again[1:]
    if len(many):
        again |= many[np.minimum(np.searchsorted(many, s), len(many) - 1)] == s
    hit = np.zeros(len(h), bool)
    hit[order] = again
    blocks, row_out, shared = [], [], []
    for block, delta, (a, b) in zip(group.column("block").to_pylist(), rows, zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True), strict=True):
        row, count = np.unique(np.cumsum(delta)[hit[a:b]], return_counts=True)
        if len(row):
            blocks.append(block)
            row_out.append(row.astype(np.uint32).tobytes())
            shared.append(count.astype(np.uint32).tobytes())
    none = [None] * len(blocks)
    arrays = [pa.array(blocks, pa.int64()), pa.array(row_out, pa.binary()), pa.array(none, pa.list_(pa.int64()))]
    arrays += [pa.array(none, pa.binary())] * 3 + [pa.array(shared, pa.binary())]
    return pa.Table.from_arrays(arrays, names=["block", "row", "key", "t", "cls", "n", "shared"])


def _sum_block(percent: int):
    """A block's rows with their sums over the fragments: key, t, cls, n, and whether enough is shared."""

    def run(group: pa.Table) -> pa.Table:
        key = t = cls = n = shared = same = first = None
        parts = []
        for r in group.to_pylist():
            if r["cls"] is None:
                parts.append(r)
                continue
            key, t = r["key"], np.frombuffer(r["t"], np.int64)
            cls, n = np.frombuffer(r["cls"], np.uint64), np.frombuffer(r["n"], np.int64)
            shared = np.frombuffer(r["shared"], np.int64).copy()
            _, first, same = np.unique(cls, return_index=True, return_inverse=True)
        if cls is None:
            raise ValueError("a block without its own rows")
        more = np.zeros(len(n), np.int64)
        for r in parts:
            more[np.frombuffer(r["row"], np.uint32)] += np.frombuffer(r["shared"], np.uint32)
        shared += more[first][same]
        left = (n > 0) & (100 * shared >= percent * n)
        name = pa.array(cls.view(np.int64), pa.int64(), mask=n == 0)
        return pa.table({"key": pa.array(key, pa.int64()), "t": t, "cls": name, "n": n, "near": left})

    return run


def _pack(k: int):
    """Texts of classes, one each, to packed blocks of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _block_ids()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, BLOCK):
                h, begin = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)]), pa.array([cls[i:j].astype(np.int64).tobytes()]), pa.array([np.diff(begin).astype(np.int64).tobytes()]), pa.array([h.tobytes()])],
                    names=["block", "cls", "n", "h"],
                )

    return run


def _send_counts(n_frag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, count = np.unique(np.frombuffer(r["h"], np.uint64), return_counts=True)
                out = [(f, r["block"], h[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()) for f, a, b in _runs(_fragment(h, n_frag))]
                if out:
                    frag, block, hs, cs = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(frag, pa.int32()), pa.array(block, pa.int64()), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], names=["frag", "block", "h", "count"])

    return run


def _frequencies(group: pa.Table) -> pa.Table:
    """One fragment: the frequency of each hash, as each block lists them."""
    group = group.combine_chunks()
    h = [np.frombuffer(x, np.uint64) for x in group.column("h").to_pylist()]
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("count").to_pylist()])
    _, same = np.unique(np.concatenate(h), return_inverse=True)
    df = np.bincount(same, c).astype(np.uint32)[same]
    ends = np.cumsum([len(x) for x in h])
    parts = [df[e - len(x) : e].tobytes() for x, e in zip(h, ends, strict=True)]
    return pa.table({"block": group.column("block"), "frag": group.column("frag"), "df": pa.array(parts, pa.binary())})


def _prefixes(percent: int):
    """A block's sets with the frequencies: the shared n-grams of each prefix, with their places."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = sorted(right.to_pylist(), key=lambda r: r["frag"])
        df_of = np.concatenate([np.frombuffer(r["df"], np.uint32) for r in parts]) if parts else np.zeros(0, np.uint32)
        for r in left.to_pylist():
            h, n, cls = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["cls"], np.int64)
            _, same = np.unique(h, return_inverse=True)
            df = df_of[same].astype(np.int64)
            at = np.cumsum(n) - n
            for c, size, a in zip(cls, n, at, strict=True):
                d, x = df[a : a + size], h[a : a + size]
                p = size - (-(-percent * size // 100)) + 1
                order = np.lexsort((x, d))[:p]
                order = order[d[order] > 1]
                if len(order):
                    place = np.flatnonzero(np.isin(np.lexsort((x, d))[:p], order, assume_unique=True))
                    out.append((x[order].view(np.int64), np.full(len(order), c), np.full(len(order), size), place, np.full(len(order), int(d.sum() // size))))
        columns = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["h", "cls", "n", "place", "typical"], columns, strict=True)))

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sets to one row for each class and fragment."""
    for batch in batches:
        for r in batch.to_pylist():
            h, n, cls = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["cls"], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            spot = row * PAIR_FRAGMENTS + _fragment(h, PAIR_FRAGMENTS)
            ends = np.searchsorted(spot, np.arange(len(n) * PAIR_FRAGMENTS + 1))
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls, PAIR_FRAGMENTS)), pa.array(np.tile(np.arange(PAIR_FRAGMENTS, dtype=np.int32), len(n))), values], names=["cls", "part", "h"])


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` that link: partial overlaps by fragment, summed per pair."""
    a = segments.select(F.col("cls").alias("a"), "part", F.col("h").alias("ha"))
    b = segments.select(F.col("cls").alias("b"), "part", F.col("h").alias("hb"))
    met = pairs.join(a, "a").join(b, ["b", "part"])
    part = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _long_enough(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _links(entries: DataFrame, segments: DataFrame, percent: int) -> DataFrame | None:
    """``(node, root)`` of the classes that link with another.

    Each round goes on with the buckets that still hold several components, and only with those.
    """
    n_rows = entries.count()
    if not n_rows:
        return None
    links = groups = None
    # buckets with the same members are one: near copies share most of their prefixes
    member = F.xxhash64("cls")
    same = few(entries.groupBy("h").agg(F.count("*").alias("k"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(F.xxhash64("cls", F.lit(1)), 24)).alias("s")), n_rows)
    same = same.where("k > 1").select("h", F.xxhash64("k", "x", "s").alias("bucket"))
    rows = few(entries.join(same, "h"), n_rows)
    rows = cut(few(rows.groupBy(F.col("bucket").alias("h"), "cls", "n", "typical").agg(F.min("place").alias("place")), n_rows))
    n_rows = rows.count()
    rows = rows.withColumn("root", F.col("cls"))
    n_links, last = 0, False
    for turn in range(MOST_ROUNDS + 1):
        # leaders: first the most typical set, then several in the order of a hash
        order = F.struct(-F.col("typical"), F.col("cls")) if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)), F.col("cls"))
        by_root = few(rows.groupBy("h", "root").agg(F.count("*").alias("k")), n_rows)
        buckets = few(by_root.groupBy("h").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count("*").alias("roots")), n_rows)
        buckets = cut(buckets.where("roots > 1").select("h", ((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("pairs")))
        left = buckets.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            drop(buckets)
            break
        last = last or left <= PAIRS_PER_ROW * n_rows or turn == MOST_ROUNDS
        open_ = cut(few(rows.join(buckets.select("h"), "h", "left_semi"), n_rows))
        y = open_.select("h", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"))
        if last:  # every two sets of a bucket that are in different components
            x = open_.select("h", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"))
            pairs = few(x.join(y, "h"), n_rows).where((F.col("ra") < F.col("rb")) & _long_enough(percent))
            # if it is the first n-gram they share, so much can follow
            most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
            pairs = pairs.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
        else:  # the leaders, and every set of another component
            place = F.row_number().over(Window.partitionBy("h").orderBy(order))
            lead = open_.withColumn("_o", place).where(F.col("_o") <= (1 if turn == 0 else LEADERS))
            lead = few(lead, n_rows).select("h", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
            pairs = few(lead.join(y, "h"), n_rows).where((F.col("ra") != F.col("rb")) & _long_enough(percent))
        pairs = few(pairs.select("a", "b", "na", "nb").distinct(), n_rows)
        found = few(_verified(pairs, segments, percent), n_rows)
        new = cut(found if links is None else links.union(found))
        for old in (links, groups, buckets):
            if old is not None:
                drop(old)
        links = new
        groups = cut(components(links))
        if last:
            break
        last = n_links == (n_links := links.count())  # leaders find nothing more
        n_rows = open_.count()
        kept = open_.select("h", "cls", "n", "place", "typical")
        rows = few(kept.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left"), n_rows).withColumn("root", F.coalesce("root", "cls"))
    return groups


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``(key, t, n, component)`` for each row: n-grams and the smallest key reachable; ``t`` is a hash of the text.

    Keys that are no whole numbers are numbered in their order first.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    if rows.schema["key"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        names = cut(rows.select("key").where("key IS NOT NULL").distinct().orderBy("key").withColumn("_id", F.monotonically_increasing_id()))
        same = F.col("key").eqNullSafe(F.col("_name"))
        numbered = rows.join(names.select(F.col("key").alias("_name"), "_id"), same, "left").select(F.col("_id").alias("key"), "t", "text")
        found = _classes(numbered, "number", k, percent)
        own = found.join(names.select(F.col("_id").alias("number"), F.col("key").alias(key)), "number", "left")
        least = names.select(F.col("_id").alias("component"), F.col("key").alias("_least"))
        return own.join(least, "component", "left").select(F.col(f"`{key}`"), "t", "n", F.col("_least").alias("component"))
    return _classes(rows.withColumn("key", F.col("key").cast("long")), key, k, percent)


def _classes(rows: DataFrame, key: str, k: int, percent: int) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_frag = max(8, -(-size // FRAGMENT))
    sent = rows.mapInArrow(_send(n_frag, k), _SENT_SQL)
    part = sent.groupBy("frag").applyInArrow(_count_fragment, "block bigint, row binary, key array<bigint>, t binary, cls binary, n binary, shared binary")
    members = cut(part.groupBy("block").applyInArrow(_sum_block(percent), "key bigint, t bigint, cls bigint, n bigint, near boolean"))
    low = members.where("cls is not null").groupBy("cls").agg(F.min("key").alias("low"), F.max("near").alias("near"), F.min(F.struct("key", "t")).alias("one"))
    low = cut(low)
    near = low.where("near").select("cls", F.col("one.key").alias("key"), F.col("one.t").alias("t"))
    n_near = near.count()
    groups = None
    if n_near:
        if n_near <= BROADCAST_ROWS:
            near = F.broadcast(near)
        texts = rows.alias("r").join(near.alias("n"), (F.col("r.t") == F.col("n.t")) & F.col("r.key").eqNullSafe(F.col("n.key"))).select("n.cls", "r.text")
        # a row that repeats key and text is met as often as it stands: one text a class, dropped before the shuffle too
        texts = texts.dropDuplicates(["cls"])
        packed = cut(few(texts, 128 * n_near).mapInArrow(_pack(k), "block bigint, cls binary, n binary, h binary"))
        some = max(4, -(-(packed.agg(F.sum(F.length("h"))).first()[0] or 0) // FRAGMENT))
        counted = packed.select("block", "h").mapInArrow(_send_counts(some), "frag int, block bigint, h binary, count binary")
        df = counted.groupBy("frag").applyInArrow(_frequencies, "block bigint, frag int, df binary")
        entries = packed.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(_prefixes(percent), "h bigint, cls bigint, n bigint, place bigint, typical bigint")
        entries = cut(entries)
        segments = packed.mapInArrow(_segments, "cls bigint, part int, h array<bigint>")
        groups = _links(entries, segments, percent)
        drop(entries)
        drop(packed)
    named = low.select("cls", "low")
    if groups is not None:
        named = named.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = named.groupBy("root").agg(F.min("low").alias("component"))
        named = named.join(least, "root").select("cls", "component")
    else:
        named = named.withColumnRenamed("low", "component")
    out = members.select("key", "t", "n", "cls").join(named, "cls", "left")
    return out.select(F.col("key").alias(key), "t", "n", F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id)`` for each row."""
    return classes(docs, key, text, k, percent).select(key, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller key; rows without words stay.

    Of rows that repeat key and text one stays. The keys to go are broadcast if they are few.
    """
    found = cut(classes(docs, key, text))
    gone = found.where((F.col("n") > 0) & ~F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("_k"), F.col("t").alias("_t")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = docs.withColumn("_text_hash", F.xxhash64(text))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_t")), "left_anti")
    if not found.where("n > 0").groupBy(key, "t").count().where("count > 1").limit(1).isEmpty():
        rows = rows.dropDuplicates([key, "_text_hash"])
    return rows.drop("_text_hash")
