"""Connected components by alternating large-star and small-star steps.

Both steps are grouped minima and equi-joins, so nothing about the whole graph
is ever in one place, a hub is split like any skewed join key, and the number of
rounds grows with the logarithm of the longest path rather than with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.session import cut


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", most_rounds: int = 1000) -> DataFrame:
    """node and component (least node that it is connected with) for every node with an edge to another node.

    Rows with a null end and self-edges are ignored; an empty table gives an empty
    result. Rounds go on to the fixed point; an error says so if ``most_rounds`` are not enough.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    links = edges.where(F.col(a) != F.col(b)).select(high.alias("v"), low.alias("m")).distinct()
    links, state = _settle(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(links.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("low"))
        large = both.join(least, "u").where(F.col("w") > F.col("u")).select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        turned = large.join(least, "v")
        small = turned.where(F.col("m") != F.col("low")).select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(least.select("v", F.col("low").alias("m")))
        links, now = _settle(small.where(F.col("v") != F.col("m")).distinct())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = links.select(F.col("m").alias("v"), "m").distinct()
    return links.unionByName(roots).select(F.col("v").alias("node"), F.col("m").alias("component"))


def _settle(links: DataFrame) -> tuple[DataFrame, tuple]:
    links = cut(links)
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.xxhash64("m", "v").cast("decimal(38,0)"))).first()
    return links, tuple(row)
