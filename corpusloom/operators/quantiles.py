"""Exact quantiles of groups of any size by selection.

Splitters from a sketch cut a group's values into ranges; rows are counted by
range where they lie, and only the ranges that hold a wanted place are looked at
again, until their distinct values are few. Nothing sorts a whole group, and no
task holds the counts of all its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.plans.session import cut, small

#: Ranges that a group is cut into at a time, and distinct values of a range that are sorted in one task.
RANGES, FEW = 256, 1 << 16


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """by, share, quantile (interpolated between the two nearest places) of the values that are neither null nor NaN.

    Groups without values have no rows.
    """
    keys = [f"k{i}" for i in range(len(by))]
    plain = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    group = F.struct(F.lit(0).alias("all"), *keys)  # one column that is never null
    left = plain.select(group.alias("g"), "v")
    totals = cut(left.groupBy("g").agg(F.count("*").alias("n")))
    place = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for s in shares]))
    asked = totals.select("g", place.alias("p")).select("g", "p.share", "p.at")
    # places from 0; the same place is looked for once
    places = cut(asked.select("g", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place")).distinct())
    open_, found = places.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf"))).withColumn("skipped", F.lit(0).cast("long")), None
    while True:
        spans = open_.select("g", "low", "high").distinct()
        near = left.join(small(spans), "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        held = cut(near.groupBy("g", "low", "high").agg(F.approx_count_distinct("v").alias("distinct"), F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")))
        done = held.where(F.col("distinct") <= few).select("g", "low", "high")
        # finished ranges: counts by value, in order
        last = open_.join(done, ["g", "low", "high"])
        counted = near.join(small(done), ["g", "low", "high"]).groupBy("g", "low", "high", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy("g", "low", "high").orderBy("v"))
        hit = counted.withColumn("upto", upto).join(last, ["g", "low", "high"]).where((F.col("skipped") + F.col("upto") > F.col("place")) & (F.col("skipped") + F.col("upto") - F.col("c") <= F.col("place")))
        got = cut(hit.select("g", "place", "v"))
        found = got if found is None else found.unionByName(got)
        more = held.where(F.col("distinct") > few)
        if more.isEmpty():
            break
        # the others: count by splitter and by range between two, so that at least one value is told from the rest
        bounds = more.select("g", "low", "high", F.array_distinct("cuts").alias("cuts"))
        ranged = near.join(small(bounds), ["g", "low", "high"]).withColumn("r", 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int"))
        sizes = ranged.groupBy("g", "low", "high", "r").agg(F.count("*").alias("c"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
        before = F.coalesce(F.sum("c").over(W.partitionBy("g", "low", "high").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most 2 * `ranges` rows
        placed = sizes.withColumn("before", before).join(open_, ["g", "low", "high"]).where((F.col("place") >= F.col("skipped") + F.col("before")) & (F.col("place") < F.col("skipped") + F.col("before") + F.col("c")))
        open_ = cut(placed.select("g", "place", F.col("lowest").alias("low"), F.col("highest").alias("high"), (F.col("skipped") + F.col("before")).alias("skipped")))
    at = lambda name, edge: found.select("g", F.col("place").alias(edge), F.col("v").alias(name))
    both = asked.withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at")).join(at("below", "lo"), ["g", "lo"]).join(at("above", "hi"), ["g", "hi"])
    part = F.col("at") - F.col("lo")
    result = F.when(part == 0, F.col("below")).otherwise(F.col("below") * (1 - part) + F.col("above") * part)
    return both.select(*[F.col(f"g.{k}").alias(c) for k, c in zip(keys, by)], "share", result.alias("quantile"))
