"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are put in a fixed pseudo-random order and cut into blocks
of ``block`` rows. Slots of time are given to blocks: with weight w of W in all
sources, block j of a source is released at slot floor(j * W / w) and is due
before slot ceil((j + 1) * W / w). Earliest-deadline-first over one slot at a
time meets all these windows, as the weights add up to one, so after any number
of slots every source has had its share to within less than one block.

Weights are exact whole numbers, so the schedule repeats after W slots. One
period, or as much of it as there are blocks for, is simulated (a fold in one
row; its size follows from the weights and the number of sources, not from the
rows); the slot of any block follows in closed form: (j div w) * W + slot of
block (j mod w) in the period. No row is dropped or repeated: where a source has
run out its slots stay empty. Without given weights a source's target is its
share of the square roots of the sources' rows, in parts of ``PARTS``, one part
at least. Given weights may be whole numbers, fractions or decimals ("1/3",
0.00001); they are kept exactly, over their common denominator, which must stay
under ``MOST_PARTS`` (an error says so otherwise). A source of weight 0 gets no
slot: its rows are kept, with null release, deadline, slot and position, and come
last in files.

Numbering the rows of a source is split by the first digits of the order key:
counts by order key, running sums within equal digits and over the digits; so a
source with a third of all rows is spread over all tasks, and so is a single id,
as rows that agree in id are counted by hashes of their other columns.

Defined cases: null source is a source of its own; null ids are ordered by their
rows' hashes; rows that agree in all columns are interchangeable and all get
places; null and very long texts play no part; an empty table gives an empty
result; one source gets all slots; further columns may have any names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.plans.session import cut

PARTS, BLOCK, DIGITS = 16384, 16, 3
#: Slots of the longest period that is simulated.
MOST_PARTS = 1 << 22
#: Hash buckets for the rows that share an id, and rows of a schedule up to which it is broadcast (beyond, it is joined by shuffle).
BUCKETS, SMALL = 64, 1 << 17
#: Slots of one inner fold.
FOLD = 256


def source_key(source: Column) -> Column:
    """Null and empty text apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tempered(counts: DataFrame, parts: int = PARTS) -> DataFrame:
    """Target weights in proportion to the square root of the sources' rows, in whole parts."""
    rooted = counts.withColumn("root", F.floor(F.sqrt("rows") * 1000))
    total = F.sum("root").over(W.partitionBy())  # as many rows as sources
    return rooted.withColumn("total", total).selectExpr("source_key", "rows", f"greatest(1L, root * {parts} div total) as weight")


def exact_weights(weights: dict[str | None, int | float | str | Fraction]) -> tuple[dict[str | None, int], int]:
    """Whole numbers in the given proportions and their sum, without any rounding."""
    given = {s: Fraction(w) if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in given.values()) or not any(given.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    scale = math.lcm(*(w.denominator for w in given.values()))
    whole = {s: int(w * scale) for s, w in given.items()}
    shared = math.gcd(*whole.values())
    whole = {s: w // shared for s, w in whole.items()}
    if sum(whole.values()) > MOST_PARTS:
        raise ValueError(f"the weights' common denominator is {sum(whole.values())}, more than {MOST_PARTS}")
    return whole, sum(whole.values())


def fixed_weights(counts: DataFrame, whole: dict[str | None, int]) -> DataFrame:
    """Given whole-number weights by source; other sources have 0."""
    pairs = [x for s, w in whole.items() for x in (F.lit("" if s is None else f"={s}"), F.lit(w).cast("long"))]
    return counts.select("source_key", "rows", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source_key")), F.lit(0).cast("long")).alias("weight"))


def period(weighted: DataFrame, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """Earliest-deadline-first over one period, as far as there are blocks: source_key, w, d (slots of the period), k (block), at (slot).

    weighted: source_key, rows, weight. total: the sum of all weights, if sources without rows have some of it.
    """
    d = F.lit(total).cast("long") if total else F.sum("weight").over(W.partitionBy())  # as many rows as sources
    sources = weighted.where("weight > 0").withColumn("d", d)
    last = F.expr(f"(least((rows + {block - 1}) div {block}, weight) * d + weight - 1) div weight")
    row = sources.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("weight").alias("w")))).alias("s"), F.max("d").alias("d"), F.max(last).alias("slots"))
    due = (
        "array_min(filter(transform(s, (x, i) -> struct(((b.done[i] + 1) * d + x.w - 1) div x.w as due, i as i, b.done[i] as k, (b.done[i] * d) div x.w as released)),"
        " c -> c.released <= t))"
    )
    step = f"aggregate(array({due}), b, (e, c) -> if(c is null, e, named_struct('done', transform(e.done, (v, i) -> if(i = c.i, v + 1, v)), 'out', concat(e.out, array(named_struct('i', c.i, 'k', c.k, 'at', t))))))"
    slot = "array<struct<i: int, k: bigint, at: bigint>>"
    part = f"aggregate(sequence(f * {FOLD}, least((f + 1) * {FOLD}, slots) - 1), named_struct('done', a.done, 'out', cast(array() as {slot})), (b, t) -> {step})"
    fold = f"aggregate(sequence(0L, (slots - 1) div {FOLD}), named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<{slot}>)), (a, f) -> aggregate(array({part}), a, (g, p) -> named_struct('done', p.done, 'out', concat(g.out, array(p.out)))))"
    runs = row.where("slots > 0").select("s", "d", F.expr(f"explode({fold}.out)").alias("run"))
    return runs.select("s", "d", F.explode("run").alias("p")).selectExpr("s[p.i].source_key as source_key", "s[p.i].w as w", "d", "p.k as k", "p.at as at")


def _first_numbers(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys (source_key, order_key, those in `by`, n) and first: how many rows of the source come before."""
    keyed = keys.withColumn("digits", F.substring("order_key", 1, DIGITS))
    before = W.partitionBy("source_key").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("source_key", "digits").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = W.partitionBy("source_key", "digits").orderBy("order_key", *by).rowsBetween(W.unboundedPreceding, -1)
    within = keyed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(offsets, ["source_key", "digits"]).withColumn("first", F.col("before") + F.col("within")).drop("digits", "before", "within")


def _order_key(ident: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))


def _scheduled(numbered: DataFrame, counts: DataFrame, weights: dict | None, block: int) -> DataFrame:
    """numbered (source_key, number, ...) with block, release, deadline, slot and position."""
    if weights:
        whole, total = exact_weights(weights)
        pattern = cut(period(fixed_weights(counts, whole), total, block))
    else:
        pattern = cut(period(tempered(counts), None, block))
    small = F.broadcast if pattern.count() <= SMALL else lambda df: df
    quota = pattern.groupBy("source_key").agg(F.max("w").alias("w"), F.max("d").alias("d"))
    blocks = numbered.withColumn("block", F.expr(f"number div {block}"))
    placed = blocks.join(small(quota), "source_key", "left").withColumn("k", F.expr("block % w")).join(small(pattern.select("source_key", "k", "at")), ["source_key", "k"], "left")
    return (
        placed.withColumn("slot", F.expr("(block div w) * d + at"))
        .withColumn("release", F.expr("(block * d) div w"))
        .withColumn("deadline", F.expr("((block + 1) * d + w - 1) div w"))
        .withColumn("position", F.expr(f"slot * {block} + number % {block}"))
        .drop("number", "k", "w", "d", "at")
    )


def placements(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, block, release, deadline, slot, position."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"))
    keys = rows.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    keys = keys.withColumn("source_key", source_key(F.col("source"))).withColumn("order_key", _order_key(F.col("doc_id"), seed))
    first = _first_numbers(keys, ["doc_id"])
    each = first.withColumn("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    counts = keys.groupBy("source_key").agg(F.sum("n").alias("rows"))
    return _scheduled(each, counts, weights, block).select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def with_position(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """All rows and columns of docs, and position in the schedule."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    hashed = [f.name for f in plain.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = plain.withColumn("source_key", source_key(plain[names[docs.columns.index(source_col)]])).withColumn("order_key", _order_key(plain[names[docs.columns.index(id_col)]], seed))
    keyed = keyed.withColumn("row_hash", F.xxhash64(*hashed)).withColumn("bucket", F.pmod("row_hash", F.lit(BUCKETS)))
    by = ["source_key", "order_key", "bucket"]
    keys = keyed.groupBy(*by).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("row_hash")) - 1
    numbered = keyed.withColumn("place", place).join(_first_numbers(keys, ["bucket"]), by).withColumn("number", F.col("first") + F.col("place"))
    counts = keys.groupBy("source_key").agg(F.sum("n").alias("rows"))
    return _scheduled(numbered, counts, weights, block).select(*names, "position").toDF(*docs.columns, "position")


def interleave(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows and columns of docs, dealt into ranges of the schedule and sorted by it, so that files written from it follow it."""
    at = len(docs.columns)
    out = with_position(docs, id_col, source_col, **options).toDF(*[f"c{k}" for k in range(at + 1)])
    order = F.asc_nulls_last(f"c{at}")
    return out.repartitionByRange(order).sortWithinPartitions(order).select(*[f"c{k}" for k in range(at)]).toDF(*docs.columns)
