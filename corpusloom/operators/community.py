"""Communities of a weighted graph: local moving with connected refinement, on one graph per key.

A partition of a graph is found in one task per graph (applyInPandas by key): the
method is sequential by nature. Edges, and not nodes or texts, are all that such
a task gets. Equal input gives equal output; nodes are visited in sorted order.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import slug
from corpusloom.operators.order import arranged

MOST_MEMBERS = 15


def _pieces(nodes: set, near: dict) -> list[set]:
    out, left = [], set(nodes)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            n = todo.pop()
            if n in left:
                left.remove(n)
                part.add(n)
                todo += [m for m in near[n] if m in left]
        out.append(part)
    return out


def partition(edges: list[tuple], resolution: float = 1.0, refine: bool = True, passes: int = 50) -> dict:
    """node -> community number, larger communities first. refine: communities are cut into connected pieces between levels."""
    near: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    inside = {n: {n} for n in near}  # members of each node of the current level
    level = {n: dict(x) for n, x in near.items()}
    loops = dict.fromkeys(level, 0.0)
    total = sum(sum(x.values()) for x in near.values()) or 1.0
    while True:
        home = {n: n for n in level}
        degree = {n: sum(x.values()) + 2 * loops[n] for n, x in level.items()}
        held = dict(degree)
        for _ in range(passes):
            moved = False
            for n in sorted(level):
                links: dict = defaultdict(float)
                for m, w in level[n].items():
                    links[home[m]] += w
                held[home[n]] -= degree[n]
                gain = lambda c, links=links, n=n: links.get(c, 0.0) - resolution * degree[n] * held.get(c, 0.0) / total
                best = max(sorted({*links, home[n]}), key=lambda c: (round(gain(c), 12), c == home[n]))
                if round(gain(best), 12) > round(gain(home[n]), 12):
                    home[n], moved = best, True
                held[home[n]] = held.get(home[n], 0.0) + degree[n]
            if not moved:
                break
        groups: dict = defaultdict(set)
        for n, c in home.items():
            groups[c].add(n)
        parts = [p for c in sorted(groups) for p in (_pieces(groups[c], level) if refine else [groups[c]])]
        if len(parts) == len(level):
            break
        name = {n: min(p) for p in parts for n in p}
        up: dict = {c: defaultdict(float) for c in set(name.values())}
        ring = dict.fromkeys(up, 0.0)
        for n, x in level.items():
            ring[name[n]] += loops[n]
            for m, w in x.items():
                if name[n] == name[m]:
                    ring[name[n]] += w / 2
                else:
                    up[name[n]][name[m]] += w
        members: dict = defaultdict(set)
        for n, x in inside.items():
            members[name[n]] |= x
        level, loops, inside = {n: dict(x) for n, x in up.items()}, ring, members
    found = sorted(inside.values(), key=lambda p: (-len(p), min(p)))
    return {n: k for k, p in enumerate(found) for n in p}


def communities(links: DataFrame, resolution: float = 1.0, refine: bool = True, by: str = "graph") -> DataFrame:
    """graph, node, grp of undirected links (graph, a, b, weight)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = partition(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["weight"].tolist())), resolution, refine)
        return pd.DataFrame({by: pdf[by].iloc[0], "node": list(found), "grp": list(found.values())})

    kind = dict(links.dtypes)
    return links.select(by, "a", "b", "weight").groupBy(by).applyInPandas(run, f"{by} {kind[by]}, node {kind['a']}, grp long")


def hierarchy(links: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """graph, level, node, grp: communities, and those of more than ``most`` members cut once more by their own links."""
    first = communities(links)
    large = first.groupBy("graph", "grp").agg(F.count("*").alias("n")).where(F.col("n") > most).select("graph", "grp")
    m = first.join(large, ["graph", "grp"], "left_semi")
    inner = links.join(m.select("graph", F.col("node").alias("a"), F.col("grp").alias("ga")), ["graph", "a"]).join(m.select("graph", F.col("node").alias("b"), F.col("grp").alias("gb")), ["graph", "b"]).where("ga = gb")
    keyed = inner.select(F.concat_ws("/", F.col("graph").cast("string"), F.col("ga").cast("string")).alias("graph"), "a", "b", "weight")
    second = communities(keyed)
    return first.select(F.col("graph").cast("string").alias("graph"), F.lit(1).alias("level"), "node", "grp").unionByName(second.select("graph", F.lit(2).alias("level"), "node", "grp"))


def ranked(membership: DataFrame, rank: DataFrame) -> DataFrame:
    """membership with each member's place in its group by centrality, then name. rank: node, rank."""
    return arranged(membership.join(rank, "node", "left"), ["grp"], [F.desc(F.round("rank", 12)), F.col("node")])


def isolated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, grp: nodes without a link, by their top directory ('(root)' at the top)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    top = F.when(F.contains("node", F.lit("/")), F.substring_index("node", "/", 1)).otherwise("(root)")
    return nodes.select("node").join(ends, "node", "left_anti").select("node", top.alias("grp"))


def merge_singletons(membership: DataFrame, links: DataFrame) -> DataFrame:
    """node, grp: groups of one join the larger group that they are linked with most, without links the largest; ties to the smaller group.

    Nothing changes where all groups are of one.
    """
    m = membership.select("node", "grp")
    sizes = m.groupBy("grp").agg(F.count("*").alias("n"))
    single = m.join(sizes.where("n = 1").select("grp"), "grp").select("node", F.col("grp").alias("own"))
    big = m.join(sizes.where("n > 1"), "grp")
    largest = sizes.where("n > 1").agg(F.min(F.struct((-F.col("n")).alias("s"), "grp"))["grp"].alias("largest"))
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    pull = single.join(both, single["node"] == both["a"]).join(big.select(F.col("node").alias("b"), "grp"), "b").groupBy(single["node"], "grp").agg(F.sum("weight").alias("w")).where("w > 0")
    best = pull.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("s"), "grp"))["grp"].alias("best"))
    moved = single.join(best, "node", "left").join(F.broadcast(largest))  # one row
    return big.select("node", "grp").unionByName(moved.select("node", F.coalesce("best", "largest", "own").alias("grp")))


def named_groups(membership: DataFrame, unlinked: Column | None = None, prefix: Column | None = None) -> DataFrame:
    """grp, slug, hub, size of groups (grp, node, place): the last directory that all members share and the hub's stem.

    Equal names are told apart by -2, -3, ... in order of size, then hub.
    """
    folder = F.filter(F.split(F.regexp_extract("node", r"^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    rows = membership.select("grp", "node", "place", folder.alias("dirs"), *([unlinked.alias("loose")] if unlinked is not None else [F.lit(False).alias("loose")]), *([prefix.alias("prefix")] if prefix is not None else [F.lit("").alias("prefix")]))
    # what the first and the last of a group's sorted directories share, all between them share
    of = rows.groupBy("grp").agg(F.count("*").alias("size"), F.min_by("node", "place").alias("hub"), F.min("dirs").alias("lo"), F.max("dirs").alias("hi"), F.max("loose").alias("loose"), F.max("prefix").alias("prefix"))
    same = F.aggregate(F.arrays_zip("lo", "hi"), F.struct(F.lit(True).alias("on"), F.lit("").alias("last")), lambda a, x: F.when(a["on"] & x["lo"].eqNullSafe(x["hi"]), F.struct(F.lit(True).alias("on"), x["lo"].alias("last"))).otherwise(F.struct(F.lit(False).alias("on"), a["last"].alias("last"))))
    base = F.regexp_replace(F.substring_index("hub", "/", -1), r"\.py$", "")
    parent = F.coalesce(F.try_element_at(F.split("hub", "/"), F.lit(-2)), F.lit("root"))
    named = of.withColumn("dir", same["last"]).withColumn("stem", F.when(base == "__init__", parent).otherwise(base))
    linked_name = F.when((F.col("dir") != "") & (F.col("dir") != F.col("stem")), F.concat("dir", F.lit("-"), "stem")).otherwise(F.col("stem"))
    loose_name = F.concat(F.lit("unlinked-"), F.when(F.col("dir") != "", F.col("dir")).otherwise(F.col("stem")))
    sluged = named.withColumn("base", slug(F.concat("prefix", F.when(F.col("loose"), loose_name).otherwise(linked_name))))
    k = F.row_number().over(W.partitionBy("base").orderBy(F.desc("size"), "hub"))
    return sluged.withColumn("k", k).select("grp", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string"))).alias("slug"), "hub", "size", "loose")
