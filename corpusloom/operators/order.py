"""Places, running sums and neighbours within groups of any size.

A window over a group sorts the whole group in one task. Here rows are dealt by
ranges of group and order, so a large group lies in many parts, one behind the
other. Each part is numbered by itself; what lies before a part can only
concern the group that the part begins with, so one row for each part (the
number and sums of that group's rows in earlier parts) makes the places whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.plans.session import cut

_PART = "_part"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"_{name}"])
    return condition


def arranged(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, following: dict[str, str] | None = None, place: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place within ``by`` (from 1) in an order that is total.

    sums: name -> value, for running sums up to and including the row.
    following: name -> column, for that column's value in the next row of the group.
    """
    sums, following = sums or {}, following or {}
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.withColumns({f"_v_{k}": v for k, v in sums.items()})
    # written, as ranges are drawn anew each time a plan runs
    dealt = cut(values.repartitionByRange(n, *by, *order).withColumn(_PART, F.spark_partition_id()))
    each = dealt.groupBy(_PART, *by).agg(F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    earlier = W.partitionBy(*by).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # a row for each part of a group
    before = {"_ahead": F.sum("_n").over(earlier)} | {f"_a_{k}": F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)) for k in sums}
    ahead = each.select(F.col(_PART).alias("_at"), *[F.col(c).alias(f"_{c}") for c in by], *[v.alias(k) for k, v in before.items()]).where("_ahead > 0")
    own = W.partitionBy(_PART, *by).orderBy(*order)
    inside = dealt.withColumns({"_inside": F.row_number().over(own)} | {f"_r_{k}": F.sum(f"_v_{k}").over(own.rowsBetween(W.unboundedPreceding, 0)) for k in sums} | {f"_f_{k}": F.lead(c).over(own) for k, c in following.items()})
    joined = inside.join(F.broadcast(ahead), (inside[_PART] == ahead["_at"]) & _same(inside, ahead, by), "left")  # at most one row for each part
    out = joined.withColumn(place, F.coalesce("_ahead", F.lit(0)) + F.col("_inside"))
    for k in sums:
        out = out.withColumn(k, F.coalesce(f"_a_{k}", F.lit(0)) + F.coalesce(f"_r_{k}", F.lit(0)))
    if following:
        # the first rows of parts that go on with a group follow the last rows of the parts before
        border = out.where((F.col("_inside") == 1) & F.col("_ahead").isNotNull())
        firsts = border.select((F.col(place) - 1).alias("_last"), *[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"_b_{k}") for k, c in following.items()])
        out = out.drop("_at", *[f"_{c}" for c in by])
        out = out.join(F.broadcast(firsts), (out[place] == firsts["_last"]) & _same(out, firsts, by), "left")  # at most one row for each part
        for k in following:
            out = out.withColumn(k, F.when(F.col("_last").isNotNull(), F.col(f"_b_{k}")).otherwise(F.col(f"_f_{k}")))
    return out.select(*rows.columns, place, *sums, *following)
