"""Personal data: fixed patterns, and bootstrapped contextual extraction around them.

DataFrame functions only. The base patterns give spans and also the seeds: a value that a
base pattern finds is a known instance of its kind; a value of a shape in :data:`SHAPES` seeds a
kind that has no base pattern. The corpus's identifier-like tokens
(with a digit or an ``@``), each with its left context (the word before it and the
separator between), form a bipartite graph of lexical patterns and instances. Rounds go
over that graph: a pattern's confidence is the mean confidence of the instances it extracts
with a support factor, an instance's the best pattern confidence (seeds stay at 1).
Patterns that reach :data:`CONFIDENT` with enough different instances, in enough different
texts, are promoted, all of them, and what they extract outside base spans is a span of their
kind. A shape alone makes no span: only a promoted context does.

Scores and counts cover all rows. A null text is empty and has no spans. Repeated rows are
scanned each, and count once for the support of a pattern (supports are of distinct
texts, counted exactly). Texts of any length are scanned whole: every pattern starts a run at its first
character only and takes it possessively, so the scan stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only contexts find, after the base ones, and the shape of values that seed them.
MORE = ("secret",)
SHAPES = {"secret": r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}$"}
#: Words before a value of such a shape that say it is no secret.
PUBLIC = ("blob", "checksum", "commit", "digest", "etag", "fingerprint", "hash", "md", "md5", "rev", "revision", "sha", "sha1", "sha256", "sha512", "uuid")
ALL_KINDS = KINDS + MORE
_LOCAL = "A-Za-z0-9._%+-"
#: Fixed patterns, as Java regexes that skip hopeless starts: within a run only its first
#: character, or the end of the last match, can start one.
JAVA = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold at least, tested before its pattern.
QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_START, _VALUE, _PLAIN = r"(?:(?<![A-Za-z0-9_])|\G)[A-Za-z_]{2,}+", r"[^\x20\x09-\x0D\"'()<>,;]", r"[^\x20\x09-\x0D\"'()<>,;0-9@]"
#: An identifier-like token and what stands before it: word, separator, value. The second
#: form has no groups: it steps over a long value without a digit or ``@``, where no token
#: can start, all but its end, so that the scan stays linear.
TOKEN = (
    rf"(?:(?<![A-Za-z0-9_])|\G)([A-Za-z_]{{2,}}+)((?:[\x20\t]?[:=#][\x20\t]?|[\x20\t])[\"'(<]?)((?={_PLAIN}*+[0-9@]){_VALUE}{{6,}}+)"
    rf"|{_START}[:=#][\"'(<]?{_PLAIN}*(?<![A-Za-z0-9_])(?={_PLAIN}{{2}})"
)
ROUNDS, CONFIDENT, SUPPORT, DOCUMENTS = 3, 0.6, 5, 5
#: Promoted contexts up to this many are looked up inside each row; more are joined as a table.
INLINE = 200
#: Tables of up to this many promoted contexts are broadcast.
BROADCAST_ROWS = 100_000
_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def _pieces(text: Column, pattern: str) -> Column:
    """``(m, s)`` for each match of ``pattern``: the match and its first code point's place.

    Splitting at the matches gives the text between them, so places are sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<m:string,s:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["b"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), at.alias("s")))).alias("out"))

    pairs = F.filter(F.arrays_zip(found.alias("m"), between.alias("b")), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, start, step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(F.get(doubled, F.ascii(c) - 48)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def part(p: Column) -> Column:
            plain = F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))
            return (F.length(plain) <= 4) & (F.substring(plain, 1, 9).cast("int") <= 255)

        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _spans_of(text: Column, k: int, kind: str) -> Column:
    test = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(QUICK[kind])
    ok = F.filter(_pieces(text, JAVA[kind]), lambda x: _valid(kind, x["m"]))
    spans = F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def _base(text: Column) -> Column:
    """All base spans ``(s, k, e)``, by start, then kind."""
    parts = [_spans_of(text, k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def _tokens(text: Column) -> Column:
    """Identifier-like tokens ``(w, v, s, e)``: left context, value, place of the value."""
    group = lambda m, i: F.regexp_extract(m, TOKEN, i)
    value = lambda x: F.regexp_replace(group(x["m"], 3), r"[.!?:*#%$&|]+$", "")
    left = lambda x: F.concat(F.lower(group(x["m"], 1)), F.regexp_replace(group(x["m"], 2), r"[\x20\t]+", " "))
    from_ = lambda x: x["s"] + F.length(group(x["m"], 1)) + F.length(group(x["m"], 2))
    found = F.transform(_pieces(text, TOKEN), lambda x: F.struct(left(x).alias("w"), value(x).alias("v"), from_(x).alias("s")))
    found = F.transform(found, lambda x: F.struct(x["w"].alias("w"), x["v"].alias("v"), x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e")))
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda x: F.length(x["v"]) >= 6)).otherwise(F.array().cast("array<struct<w:string,v:string,s:bigint,e:bigint>>"))


def _meet(spans: Column, x: Column) -> Column:
    """Whether a base span shares a place with ``x``."""
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _sized(patterns: DataFrame) -> DataFrame:
    """The table, broadcast in joins if it is counted small."""
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_ROWS else patterns


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(w, k)``: promoted left contexts and the place of their kind in :data:`ALL_KINDS`.

    Edges are aggregated by (context, value) before any shuffle; every round is a
    group by value and a group by context over that table. A context has one kind.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(t.alias("_t")).where(F.col("_t").rlike("[0-9@]"))
    rows = rows.select(_base(F.col("_t")).alias("_b"), F.explode(_tokens(F.col("_t"))).alias("x"), F.xxhash64("_t").alias("d"))
    over = F.filter("_b", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))
    shape = F.coalesce(*(F.when(F.col("x.v").rlike(SHAPES[kind]) & ~F.regexp_extract("x.w", "^[a-z_]+", 0).isin(*PUBLIC), k) for k, kind in enumerate(MORE, len(KINDS))))
    seen = rows.select(F.col("x.w").alias("w"), F.col("x.v").alias("v"), F.coalesce(F.get(over, 0)["k"], shape).alias("k"), "d")
    seen = cut(seen.groupBy("w", "v", "d").agg(F.max("k").alias("k")))
    edges = cut(seen.groupBy("w", "v").agg(F.max("k").alias("k")))
    texts = seen.select("w", "d").distinct().groupBy("w").agg(F.count("*").alias("d"))
    wide = cut(edges.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).join(texts.where(F.col("d") >= DOCUMENTS), "w"))
    n_kinds = len(ALL_KINDS)
    seeds = cut(edges.where("k IS NOT NULL").groupBy("v").agg(F.max("k").alias("k")).withColumn("c", F.lit(1.0)))
    known, patterns = seeds, None
    for turn in range(ROUNDS):
        hits = edges.select("w", "v").join(known, "v")
        shares = hits.groupBy("w", "k").agg(F.sum("c").alias("c"))
        scored = shares.join(wide, "w").select("w", "k", (F.col("c") / (F.col("n") + 1)).alias("c"))
        best = cut(scored.where(F.col("c") >= CONFIDENT))
        if patterns is not None:
            drop(patterns)
        patterns = best
        if turn < ROUNDS - 1:
            # what promoted contexts extract becomes known, with their confidence
            more = edges.select("w", "v").join(_sized(patterns), "w").groupBy("v").agg(F.max_by("k", "c").alias("k"), F.max("c").alias("c"))
            grown = cut(seeds.union(more.join(seeds, "v", "left_anti").select("v", "k", "c")))
            if known is not seeds:
                drop(known)
            known = grown
    for old in (seen, edges, wide, seeds, known):
        drop(old)
    return patterns.select("w", "k")


def learn(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """:func:`contexts` brought to the driver, to look at."""
    return {r.w: r.k for r in contexts(docs, text).toLocalIterator()}


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns and their names: base spans and all spans, arrays of (s, k, e), by start, then kind."""
    base_name, spans_name = (next(x for x in (f"{'_' * i}{name}" for i in range(1, 99)) if x not in docs.columns) for name in ("base", "spans"))
    patterns = contexts(docs, text)
    n = patterns.count()
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.col(base_name)
    out = docs.withColumn(base_name, F.when(t.rlike("[0-9@]"), _base(t)).otherwise(F.array().cast(_SPAN)))
    if not n:
        return out.withColumn(spans_name, base), base_name, spans_name
    if n > INLINE:
        # by text, as spans depend on nothing else: two hashes name it
        name = [F.xxhash64(F.lit(i), t).alias(f"_t{i}") for i in range(2)]
        tokens = docs.where(t.rlike("[0-9@]")).select(*name, F.explode(_tokens(t)).alias("x")).select("_t0", "_t1", F.col("x.w").alias("w"), "x.s", "x.e")
        met = tokens.join(_sized(patterns), "w").groupBy("_t0", "_t1").agg(F.collect_set(F.struct("s", F.col("k").cast("int").alias("k"), "e")).alias("_more"))
        whole = F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("_row")
        out = out.select(whole, *name).join(met, ["_t0", "_t1"], "left").select("_row.*", "_more")
        extra = F.filter(F.coalesce("_more", F.array().cast(_SPAN)), lambda x: ~_meet(base, x))
        spans = F.array_sort(F.concat(base, extra))
        kept = [F.col(f"`{c}`") for c in docs.columns]
        return out.select(*kept, base, spans.alias(spans_name)), base_name, spans_name
    pairs = [(r.w, r.k) for r in patterns.orderBy("w").collect()]
    kind_of = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    extra = F.filter(_tokens(t), lambda x: F.array_contains(F.map_keys(kind_of), x["w"]) & ~_meet(base, x))
    extra = F.transform(extra, lambda x: F.struct(x["s"].alias("s"), F.element_at(kind_of, x["w"]).alias("k"), x["e"].alias("e")))
    return out.withColumn(spans_name, F.array_sort(F.concat(base, extra))), base_name, spans_name


def _written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    found, base, spans = find(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    counts = [_count(base, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("key").alias(key), *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets.

    Spans that overlap are replaced together, under the first one's kind.
    """
    found, _, spans = find(docs, text)
    kinds = F.array(*map(F.lit, ALL_KINDS))
    value = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit("<"), F.get(kinds, x["k"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    def whole(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), F.length(value)))

    masked = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, whole)).otherwise(value)
    return found.withColumn(text, masked).select(*[F.col(f"`{c}`") for c in docs.columns])
