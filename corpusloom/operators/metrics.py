"""Evaluation of rankings (query_id, method, doc, rank) against gold (query_id, doc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.plans.session import cut, small


def gold_ranks(rankings: DataFrame, gold: DataFrame, methods: DataFrame) -> DataFrame:
    """query_id, method, doc, rank (null if not ranked) of every gold document. methods: one row per method.

    Of the rankings only gold's rows are met by the join, so whole rankings are not shuffled for it.
    """
    gold = cut(gold)  # met three times
    ranked = rankings.select("query_id", "method", "doc", "rank").join(small(gold.select("query_id", "doc").distinct()), ["query_id", "doc"], "left_semi")
    return gold.join(F.broadcast(methods)).join(ranked, ["query_id", "method", "doc"], "left")  # a row per method


def per_query(ranks: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """acc (all gold within k), recall, hit (any), reciprocal rank of each query and method."""
    aggs = [F.count("*").alias("n_gold"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr")]
    for k in cuts:
        inside = F.count_if(F.col("rank") <= k)
        aggs += [(inside == F.count("*")).alias(f"acc{k}"), (inside / F.count("*")).alias(f"recall{k}"), (inside > 0).alias(f"hit{k}")]
    return ranks.groupBy("query_id", "method").agg(*aggs)


def means(cuts: tuple[int, ...] = (5, 10)) -> list[Column]:
    out = [F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr")]
    for k in cuts:
        out += [F.round(F.avg(F.col(f"acc{k}").cast("double")), 6).alias(f"acc{k}"), F.round(F.avg(f"recall{k}"), 6).alias(f"recall{k}"), F.round(F.avg(F.col(f"hit{k}").cast("double")), 6).alias(f"hit{k}")]
    return out


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: binomial tail by multiplicative terms."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired(queries: DataFrame, a: str, b: str, flag: str) -> DataFrame:
    """Discordant counts of two methods and the exact p."""
    wide = queries.where(F.col("method").isin(a, b)).groupBy("query_id").agg(F.max(F.when(F.col("method") == a, F.col(flag))).alias("a"), F.max(F.when(F.col("method") == b, F.col(flag))).alias("b"))
    counts = wide.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return counts.withColumn("p", F.round(mcnemar(F.col("only_a"), F.col("only_b")), 9))


def average_rank(by: list[str], value: str) -> Column:
    """Rank with ties at their mean."""
    first = F.rank().over(W.partitionBy(*by).orderBy(value))
    return first + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumn("rx", average_rank(by, x)).withColumn("ry", average_rank(by, y))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def failure_class(recovered: Column, seeds_ok: Column, reachable: Column, rank: Column, cut: int, crowded: Column) -> Column:
    """Ordered: recovered, bad seeds, unreachable, outranked, crowded out, other."""
    return (
        F.when(recovered, "recovered").when(~seeds_ok, "bad seeds").when(~reachable, "unreachable").when(rank > cut, "outranked").when(crowded, "crowded out").otherwise("other")
    )


def distance_bucket(d: Column) -> Column:
    return F.when(d.isNull(), "unreachable").when(d >= 3, "3+").otherwise(d.cast("string"))
