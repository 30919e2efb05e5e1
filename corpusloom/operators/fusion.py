"""Fusion of rankings given as rows (query_id, doc, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reciprocal_rank(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, doc, score, rank; ties go by the rank in the first ranking, then by document."""
    tagged = [r.select("query_id", "doc", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    fused = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "doc").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.when(F.col("list") == 0, F.col("rank"))).alias("in_first"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("in_first"), "doc")
    return fused.withColumn("rank", F.row_number().over(order)).drop("in_first")


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """a1, b1, a2, b2, ..., each document at its first place, up to the shorter ranking's length."""
    lengths = a.groupBy("query_id").agg(F.max("rank").alias("la")).join(b.groupBy("query_id").agg(F.max("rank").alias("lb")), "query_id")
    both = a.select("query_id", "doc", "rank", (2 * F.col("rank") - 1).alias("at")).unionByName(b.select("query_id", "doc", "rank", (2 * F.col("rank")).alias("at")))
    kept = both.join(lengths, "query_id").where(F.col("rank") <= F.least("la", "lb"))
    first = kept.groupBy("query_id", "doc").agg(F.min("at").alias("at"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).drop("at")


def complete(head: DataFrame, candidates: DataFrame) -> DataFrame:
    """head's order among the candidates, then the other candidates in their own. candidates: query_id, doc, rank."""
    first = head.join(candidates.select("query_id", "doc"), ["query_id", "doc"], "left_semi").select("query_id", "doc", F.lit(0).alias("part"), "rank")
    rest = candidates.select("query_id", "doc", F.lit(1).alias("part"), "rank")
    place = first.unionByName(rest).groupBy("query_id", "doc").agg(F.min(F.struct("part", "rank")).alias("at"))
    return place.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at", "doc"))).drop("at")
