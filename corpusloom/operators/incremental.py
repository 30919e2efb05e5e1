"""Keeping published rows up to date by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diff(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """key, status: added, removed, modified or unchanged."""
    joined = previous.select(key, F.col(digest).alias("old")).join(current.select(key, F.col(digest).alias("new")), key, "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return joined.select(key, status.alias("status"))


def is_stale(changes: DataFrame) -> DataFrame:
    """One row: stale."""
    return changes.agg(F.coalesce(F.max(F.col("status") != "unchanged"), F.lit(False)).alias("stale"))


def carry_timestamps(previous: DataFrame, current: DataFrame, now: Column, key: str = "path", digest: str = "hash") -> DataFrame:
    """current with the previous timestamp where the content is the same, else now."""
    old = previous.select(key, F.col(digest).alias("_old"), F.col("timestamp").alias("_then"))
    joined = current.join(old, key, "left")
    return joined.withColumn("timestamp", F.when(F.col("_old") == F.col(digest), F.col("_then")).otherwise(now)).drop("_old", "_then")


def moved(previous: DataFrame, current: DataFrame) -> DataFrame:
    """node, old_grp, new_grp of members that changed their group."""
    joined = previous.select("node", F.col("grp").alias("old_grp")).join(current.select("node", F.col("grp").alias("new_grp")), "node")
    return joined.where("old_grp <> new_grp")


def digest(rows: DataFrame, by: list[str], key: str, content: str) -> DataFrame:
    """One digest per group of the sorted key + content pairs.

    Each pair is hashed where it lies and the sorted hashes are folded once more
    for each of 256 prefixes, so no group is gathered whole.
    """
    pair = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(content)), 256)
    parts = rows.select(*by, pair.alias("h")).groupBy(*by, F.left("h", F.lit(2)).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.groupBy(*by).agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("prefix", "h"))), ""), 256), F.lit(16)).alias("digest"))


def jaccard_match(previous: DataFrame, current: DataFrame, least: float = 0.5) -> DataFrame:
    """grp, old_grp, jaccard of the best previous group with at least this overlap, each previous group once.

    Only groups that share a member are compared. A previous group wanted by
    several goes to the one with the largest overlap, ties to the name that sorts first.
    A group has a second choice only where two previous ones hold exactly half of it
    each; a loser there gets none.
    """
    sizes = current.groupBy("grp").agg(F.count("*").alias("n")), previous.groupBy(F.col("grp").alias("old_grp")).agg(F.count("*").alias("m"))
    both = current.select("node", "grp").join(previous.select("node", F.col("grp").alias("old_grp")), "node").groupBy("grp", "old_grp").agg(F.count("*").alias("k"))
    rated = both.join(sizes[0], "grp").join(sizes[1], "old_grp").withColumn("jaccard", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).where(F.col("jaccard") >= least)
    first = rated.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("jaccard"), "old_grp"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(W.partitionBy("old_grp").orderBy(F.desc("jaccard"), "grp"))).where("r = 1").select("grp", "old_grp", "jaccard")
