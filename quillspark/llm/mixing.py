"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every document of a source asks for ``target / source size`` copies. The whole part is
certain; the fractions are rounded together. Blocks of documents, in order of size, pair
the fractional probabilities one after another: of each pair one ends at 0 or 1 and the
other carries the rest on, at random but so that each keeps its probability. What a block
has left is one document; the blocks' rests meet in blocks of the next level, and so on up
a reduction tree whose last block holds one rest for each source. Neighbours in size trade
with each other, so a source's words come out near its target, not only its documents.

Draws are hashes of the document's key and text: reruns agree. The tree carries these, sizes and
probabilities, never texts; each level is written, and what it settled joins the documents
at the end. Units and levels are written in as many files as their rows need, not one for each
shuffle partition: Hadoop's local file system starts processes (``chmod``) for each file, and a
new one has its executor's pages until it runs, which counts that memory twice. ``docs`` are
counted for this. Documents without words carry no mass and are taken 0 times where their source has
words; a source without words has target 0. A null source is a source of its own and comes last.
Rows that repeat source, key and text ask together: what their group is given is dealt out among
them evenly, whole shares to each and the rest one by one. An empty table gives an empty result. Input
columns named as one of :data:`OWN` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, few

#: Documents of a block, about.
BLOCK = 64
WEIGHTS = (5, 2, 1)
#: No target exceeds so many times its source's size.
MOST = 3
#: Columns that the result adds.
OWN = ("size", "source_size", "target", "copies")
#: Parts that the rows of one repeated document are numbered in.
SHARES = 256


def size_of(text: str) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: size, documents and target words.

    Weights repeat over the sources in order. The level ``x`` with
    ``sum(min(most * size, x * weight)) = sum(size)`` is where the running sums, in order
    of the ratio at which a source is full, cross it. Only sources are sorted, not rows.
    """
    many = F.col("m") if "m" in sized.columns else F.lit(1)
    by = sized.groupBy(source).agg(F.sum(F.col(size) * many).alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    by = by.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full", F.col(source).asc_nulls_last())
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("_x", (F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(run), F.lit(0.0))) / F.sum("_w").over(rest))
    # a source is below its cap from the first place on where the level fits
    by = by.withColumn("_level", F.first(F.when(F.col("_x") <= F.col("_full"), F.col("_x")), ignorenulls=True).over(all_))
    target = F.when(F.col("_full") < F.coalesce("_level", F.lit(math.inf)), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    return by.select(source, "source_size", "n_docs", target.alias("target"))


def _draw(key: Column, level: int, seed: int, salt: str) -> Column:
    """A uniform number in [0, 1) from a key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(seed), F.lit(salt)), 11) / F.lit(float(1 << 53))


def _trade(units: Column, row_type: str) -> Column:
    """Fold a block's units ``(row, p, u)``: the settled rows and the unit that is left, or null."""
    settled = f"array<struct<row:{row_type},extra:int>>"
    unit = f"struct<row:{row_type},p:double,u:double>"
    start = F.struct(F.array().cast(settled).alias("done"), F.lit(None).cast(unit).alias("left"))
    end = lambda row, extra: F.struct(row.alias("row"), extra.cast("int").alias("extra"))
    state = lambda done, left: F.struct(done.alias("done"), left.alias("left"))

    def meet(acc: Column, b: Column) -> Column:
        a, total = acc["left"], acc["left"]["p"] + b["p"]
        low = total < 1 - TINY
        # below 1: one gives all it has to the other; from 1 on: one becomes certain
        a_ends = F.when(low, b["u"] * total < b["p"]).otherwise(b["u"] * (2 - total) < 1 - b["p"])
        goes_on, p = F.when(a_ends, b).otherwise(a), F.when(low, total).otherwise(total - 1)
        ended = end(F.when(a_ends, a["row"]).otherwise(b["row"]), ~low)
        rest = F.struct(goes_on["row"].alias("row"), p.alias("p"), goes_on["u"].alias("u"))
        both = F.concat(acc["done"], F.array(ended))
        return (
            F.when((b["p"] <= TINY) | (b["p"] >= 1 - TINY), state(F.concat(acc["done"], F.array(end(b["row"], b["p"] > 0.5))), a))
            .when(a.isNull(), state(acc["done"], b))
            .when(p <= TINY, state(F.concat(both, F.array(end(goes_on["row"], F.lit(0)))), F.lit(None).cast(unit)))
            .otherwise(state(both, rest))
        )

    return F.aggregate(units, start, meet)


#: Less than this of a copy is rounding.
TINY = 1e-12


def decide(units: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``(_source, _key, _t, m, size, source_size, target, total)``: copies in all for each distinct document.

    ``units`` has a row for each of them, with ``m`` rows of it in the corpus.
    """
    largest, n = plan.agg(F.max("n_docs")).first()[0] or 0, units.count()
    asked = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("m")).otherwise(0.0)
    rows = units.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_asked", asked)
    base = F.floor(F.col("_asked") + TINY).cast("long")
    p = F.when(F.col("_size") > 0, F.greatest(F.col("_asked") - base, F.lit(0.0))).otherwise(0.0)
    row = F.struct("_key", "_t", "m", F.col("_size").alias("size"), "source_size", "target", base.alias("base"))
    # at level k a source has n / BLOCK**k blocks; a document's block is a hash of its key and text
    wide = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).cast("long")
    spot = F.pmod(F.xxhash64("_key", "_t", F.lit(seed)), F.lit(1 << 40))
    level_units = rows.select("_source", F.pmod(spot, wide).alias("_block"), row.alias("row"), p.alias("p"))
    row_type = level_units.schema["row"].dataType.simpleString()
    depth = 1
    while BLOCK**depth < largest:
        depth += 1
    out = None
    for level in range(depth):
        if level == depth - 1:
            level_units = level_units.withColumn("_block", F.lit(0).cast("long"))
        key = F.xxhash64("row._key", "row._t")
        order = F.struct((-F.col("row.size")).alias("s"), _draw(key, level, seed, "order").alias("o"), F.struct("row", "p", _draw(key, level, seed, "pair").alias("u")).alias("x"))
        blocks = level_units.groupBy("_source", "_block").agg(F.collect_list(order).alias("_all"))
        in_order = F.transform(F.sort_array("_all"), lambda v: v["x"])
        folded = cut(few(blocks.select("_source", "_block", _trade(in_order, row_type).alias("_f")), n))
        n = folded.count()  # of each block one unit at most goes on
        settled = folded.select("_source", F.explode("_f.done").alias("d")).select("_source", "d.row", "d.extra")
        out = settled if out is None else out.union(settled)
        level_units = folded.where("_f.left is not null").select("_source", F.expr(f"_block div {BLOCK}").alias("_block"), F.col("_f.left.row").alias("row"), F.col("_f.left.p").alias("p"))
    key = F.xxhash64("row._key", "row._t")
    rest = level_units.select("_source", "row", (_draw(key, depth, seed, "rest") < F.col("p")).cast("int").alias("extra"))
    return out.union(rest).select("_source", "row.*", (F.col("row.base") + F.col("extra")).alias("total")).drop("base")


def _dealt(rows: DataFrame) -> DataFrame:
    """``copies`` for rows of documents that stand several times, as even as whole numbers can be."""
    one = ["_source", "_key", "_t"]
    rows = cut(rows.withColumn("_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARES))))
    counts = rows.groupBy(*one, "_share").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*one).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(c).alias(f"{c}2") for c in one), F.col("_share").alias("_share2"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = (F.col("_source").eqNullSafe(F.col("_source2"))) & F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_t") == F.col("_t2")) & (F.col("_share") == F.col("_share2"))
    place = F.row_number().over(Window.partitionBy(*one, "_share").orderBy("_share")) + F.col("_before")
    more = (place <= F.pmod("total", "m")).cast("long")
    return rows.join(counts, same).withColumn("copies", F.floor(F.col("total") / F.col("m")) + more)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, unless named) with size, source_size, target and copies of each row."""
    names = [c for c in keep or docs.columns if c not in OWN]
    one = [F.col(f"`{source}`").alias("_source"), F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_t")]
    found = docs.select(*one, size_of(text).alias("_size")).groupBy("_source", "_key", "_t", "_size").agg(F.count("*").alias("m"))
    units = cut(few(found, docs.count()))
    plan = cut(targets(units, "_source", "_size", weights, most))
    decided = decide(units, plan, seed).withColumnsRenamed({"_source": "_s", "_key": "_k", "_t": "_h"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *one)
    # decisions are a few numbers a document, and unique
    met = rows.join(decided.hint("shuffle_hash"), F.col("_source").eqNullSafe(F.col("_s")) & F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h"))).drop("_s", "_k", "_h")
    columns = ["_row.*", "size", "source_size", "target", F.col("copies").cast("int").alias("copies")]
    out = met.where("m = 1").withColumn("copies", F.col("total")).select(*columns)
    if (units.agg(F.max("m")).first()[0] or 0) > 1:
        out = out.union(_dealt(met.where("m > 1")).select(*columns))
    return out
