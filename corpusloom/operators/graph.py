"""Weighted directed graphs as rows (src, dst, weight): degrees, walks, distances, quality of groupings.

The iterative functions are batched by a key column (``seed_set``), so many walks
share each round's join; each round is an equi-join and a partial aggregation, and
lineage is cut every few rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.components import connected_components
from corpusloom.operators.quantiles import quantiles
from corpusloom.plans.session import cut

#: Fixed value: share of the mass that goes back to the seeds.
RESTART = 0.15
#: Weight of a transition along an edge and against it, by task.
DIRECTIONS = {"bug": (1.0, 0.5), "feature": (1.0, 1.0), "security": (0.5, 1.0), "refactor": (0.5, 1.0)}


def fan(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, weight_in, weight_out."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), "weight").unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), "weight"))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum(F.col("weight") * F.col("i")).alias("weight_in"), F.sum(F.col("weight") * F.col("o")).alias("weight_out"))


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, weight: both directions added; self-edges dropped."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def group_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """src_group, dst_group, edges, weight. membership: node, grp."""
    m = membership.select("node", "grp")
    joined = edges.join(m.toDF("src", "src_group"), "src").join(m.toDF("dst", "dst_group"), "dst")
    return joined.groupBy("src_group", "dst_group").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def cohesion(links: DataFrame, membership: DataFrame) -> DataFrame:
    """grp, internal, cut, cohesion = internal / (internal + cut). links: undirected."""
    m = membership.select("node", "grp")
    ends = links.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b")
    sides = ends.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias("grp"), F.when(F.col("ga") == F.col("gb"), F.col("weight")).otherwise(0).alias("inside"), F.when(F.col("ga") != F.col("gb"), F.col("weight")).otherwise(0).alias("outside"))
    sums = sides.groupBy("grp").agg(F.sum("inside").alias("internal"), F.sum("outside").alias("cut"))
    return sums.withColumn("cohesion", F.coalesce(F.round(F.try_divide(F.col("internal").cast("double"), F.col("internal") + F.col("cut")), 3), F.lit(0.0)))


def modularity(links: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity = sum over groups of internal / m - (degree / 2m) ** 2."""
    m = membership.select("node", "grp")
    ends = links.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b")
    inner = ends.where("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.sum("weight").alias("internal"))
    degree = ends.select(F.explode(F.array("ga", "gb")).alias("grp"), "weight").groupBy("grp").agg(F.sum("weight").alias("degree"))
    total = links.agg(F.sum("weight").alias("m"))
    each = degree.join(inner, "grp", "left").join(F.broadcast(total))  # one row
    share = F.coalesce("internal", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))
    return each.agg(F.sum(share).alias("modularity"))


def disconnected_groups(links: DataFrame, membership: DataFrame) -> DataFrame:
    """grp, parts: groups whose members do not hang together by links inside the group."""
    m = membership.select("node", "grp")
    inner = links.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b").where("ga = gb")
    parts = m.join(connected_components(inner, "a", "b"), "node", "left").withColumn("part", F.coalesce("component", "node"))
    return parts.groupBy("grp").agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def distances(edges: DataFrame | None, seeds: DataFrame, depth: int, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """seed_set, node, distance of everything within depth steps along edges. seeds: seed_set, node.

    step: gives seed_set, node of what a frontier (seed_set, node, distance) leads to,
    in place of edges; so a walk may go different ways for different seeds, kinds of nodes or distances.
    """
    if step is None:
        step = lambda at: at.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed_set", F.col("dst").alias("node"))
    seen = seeds.select("seed_set", "node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        near = step(frontier).select("seed_set", "node").distinct()
        frontier = cut(near.join(seen, ["seed_set", "node"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed_set, node, distance, path: one shortest path, of several the one that sorts first."""
    found = seeds.select("seed_set", "node", F.array("node").alias("path")).groupBy("seed_set", "node").agg(F.min("path").alias("path"))
    frontier = found
    for _ in range(depth):
        steps = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed_set", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = steps.groupBy("seed_set", "node").agg(F.min("path").alias("path"))
        frontier = cut(best.join(found, ["seed_set", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found.withColumn("distance", F.size("path") - 1)


def transitions(edges: DataFrame, along: float, against: float, target_weight: DataFrame | None = None) -> DataFrame:
    """u, v, p: a walk's step along and against edges; parallel steps are added. target_weight: node, tw."""
    w = F.col("weight").cast("double")
    steps = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), (w * along).alias("w")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), (w * against).alias("w")))
    if target_weight is not None:
        steps = steps.join(target_weight.select(F.col("node").alias("v"), "tw"), "v", "left").withColumn("w", F.col("w") * F.coalesce("tw", F.lit(1.0))).select("u", "v", "w")
    summed = steps.groupBy("u", "v").agg(F.sum("w").alias("w"))
    total = summed.groupBy("u").agg(F.sum("w").alias("total")).where("total > 0")
    return summed.join(total, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p"))


def walk(steps: DataFrame, seeds: DataFrame, rounds: int = 100, restart: float = RESTART, tolerance: float | None = 1e-9, cut_every: int = 5) -> DataFrame:
    """seed_set, node, mass of a personalised PageRank.

    Seeds share the start evenly; mass on nodes without a step goes back to the
    seeds. Ends after ``rounds``, or when no seed set changes by ``tolerance`` (L1).
    """
    given = seeds.select("seed_set", "node").distinct()
    start = cut(given.withColumn("share", F.lit(1.0) / F.count("*").over(W.partitionBy("seed_set"))))
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = cut(steps.repartition(parts, "u").sortWithinPartitions("u"))  # lies as the join of a round needs it, so only masses move
    dead = cut(steps.select(F.col("v").alias("node")).unionByName(start.select("node")).distinct().join(steps.select(F.col("u").alias("node")), "node", "left_anti"))
    none_dead = dead.isEmpty()  # then the mass stays whole, and what goes home is the same in each round
    state = start.select("seed_set", "node", F.col("share").alias("mass"))
    for round_ in range(rounds):
        moved = state.join(steps, state["node"] == steps["u"]).select("seed_set", F.col("v").alias("node"), ((1 - restart) * F.col("mass") * F.col("p")).alias("mass"))
        if none_dead:
            home = start.select("seed_set", "node", (F.col("share") * restart).alias("mass"))
        else:
            stuck = state.join(dead, "node").groupBy("seed_set").agg(F.sum("mass").alias("stuck"))
            home = start.join(stuck, "seed_set", "left").select("seed_set", "node", (F.col("share") * (restart + (1 - restart) * F.coalesce("stuck", F.lit(0.0)))).alias("mass"))
        after = moved.unionByName(home).groupBy("seed_set", "node").agg(F.sum("mass").alias("mass"))
        at, last = (round_ + 1) % cut_every, round_ + 1 == rounds
        tested = tolerance is not None and at == 0 and not last
        if at == 0 or last or (tolerance is not None and at == cut_every - 1):  # written before a tested round too, so that no round runs twice
            after = cut(after)
        if tested:
            change = after.join(state.withColumnRenamed("mass", "old"), ["seed_set", "node"], "left").groupBy("seed_set").agg(F.sum(F.abs(F.col("mass") - F.coalesce("old", F.lit(0.0)))).alias("l1")).agg(F.max("l1")).first()[0]
            if (change or 0.0) < tolerance:
                return after
        state = after
    return state


def pagerank(links: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node, rank on the undirected graph: a walk that restarts anywhere. nodes: node."""
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    everywhere = nodes.select(F.lit(0).alias("seed_set"), "node")
    return walk(transitions(both, 1.0, 1.0), everywhere, rounds, 1 - damping, tolerance).select("node", F.col("mass").alias("rank"))


def hub_share(mass: DataFrame, fan_in: DataFrame, hub: Column | None = None, quantile: float = 0.95) -> DataFrame:
    """seed_set, hub_share: mass on nodes at or above a quantile of fan-in (or where ``hub`` holds)."""
    limit = quantiles(fan_in, [], "fan_in", [quantile]).select(F.col("quantile").alias("limit"))
    marked = fan_in.join(F.broadcast(limit)).withColumn("is_hub", (F.col("fan_in") >= F.col("limit")) | (hub if hub is not None else F.lit(False)))  # one row
    joined = mass.join(marked.select("node", "is_hub"), "node", "left")
    return joined.groupBy("seed_set").agg((F.sum(F.when(F.col("is_hub"), F.col("mass")).otherwise(0.0)) / F.sum("mass")).alias("hub_share"))
