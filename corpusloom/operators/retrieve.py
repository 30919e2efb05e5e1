"""Context for a task: entry points, expansion over the graph, extras, final order; for many queries at once.

The scores, shares and limits of the branches are fixed values.

Tables: hits (query_id, doc, score, rank), concepts (doc, tags array, fan_in),
edges (src, dst, weight), members (grp, doc, at), implements (doc, target, at).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import hub_damping
from corpusloom.operators import graph
from corpusloom.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """Switches of retrieval, so that each can be left out."""

    adaptive: bool = True
    keep_strong: bool = True
    expansion: str = "ppr"  # or "walk"
    damp_hubs: bool = True
    drop_tests: bool = True
    most_entries: int = 4
    most_expanded: int = 25
    rounds: int = 100


def entry_points(hits: DataFrame, implements: DataFrame | None, settings: Settings) -> DataFrame:
    """query_id, doc, s, place (order of insertion), is_entry. A hit that only describes others stands for them."""
    h = hits.withColumn("top", F.max("score").over(W.partitionBy("query_id")))
    if implements is None:
        each = h.select("query_id", "rank", F.lit(0).alias("at"), "doc", "score", "top")
    else:
        by = implements.withColumnRenamed("doc", "described").join(h.withColumnRenamed("doc", "described"), "described").select("query_id", "rank", "at", F.col("target").alias("doc"), "score", "top")
        own = h.join(implements.select("doc").distinct(), "doc", "left_anti").select("query_id", "rank", F.lit(0).alias("at"), "doc", "score", "top")
        each = own.unionByName(by)
    first = each.groupBy("query_id", "doc").agg(F.min(F.struct("rank", "at", "score", "top")).alias("f")).select("query_id", "doc", "f.*")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "at", "doc")))
    begun = placed.withColumn("before", F.min("place").over(W.partitionBy("query_id", "rank")) - 1)
    if settings.adaptive:
        begun = begun.where((F.col("score") >= 0.5 * F.col("top")) | (F.col("before") == 0))
    used = begun.where(F.col("before") < settings.most_entries)
    return used.select("query_id", "doc", F.col("score").alias("s"), "place", (F.col("place") <= settings.most_entries).alias("is_entry"))


def _rows(df: DataFrame, score, reason, branch: int, at) -> DataFrame:
    return df.select("query_id", "doc", score.cast("double").alias("score"), reason.alias("reason"), F.lit(branch).alias("branch"), at.cast("long").alias("at"))


def gather(hits: DataFrame, concepts: DataFrame, edges: DataFrame, members: DataFrame, task: str, settings: Settings = Settings(), implements: DataFrame | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, doc, score, reason, position.

    texts: gives query_id, doc, score of pairs (query_id, doc), for the text factor of the walk by mass
    where hits are only those that can be entries or strong.
    """
    if task not in graph.DIRECTIONS:
        raise ValueError(f"task must be one of {sorted(graph.DIRECTIONS)}")
    tests = concepts.where(F.array_contains("tags", "test")).select("doc")
    if settings.drop_tests:
        hits = hits.join(tests, "doc", "left_anti")
        hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    flagged = concepts.where(F.exists("tags", lambda t: t.startswith("security:"))).select("doc")
    placed = cut(entry_points(hits, implements, settings))  # a few rows a query, met by every branch
    entries = placed.where("is_entry").select("query_id", "doc", "place")
    start = entries.select(F.col("query_id").alias("seed_set"), F.col("doc").alias("node"))
    branches = [_rows(placed, 100 + F.col("s"), F.lit("entry point"), 1, F.col("place"))]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    of_entry = lambda e: entries.join(e.select(F.col("src").alias("doc"), F.col("dst").alias("near")), "doc").select("query_id", F.col("near").alias("doc"), "place")
    group_of = members.select("doc", "grp")

    if settings.expansion == "ppr":
        kept = edges
        if settings.drop_tests:
            kept = kept.join(tests.toDF("src"), "src", "left_anti").join(tests.toDF("dst"), "dst", "left_anti")
        damping = concepts.select(F.col("doc").alias("node"), hub_damping(F.col("fan_in")).alias("tw")) if settings.damp_hubs else None
        mass = graph.walk(graph.transitions(kept, *graph.DIRECTIONS[task], damping), start, settings.rounds).select(F.col("seed_set").alias("query_id"), F.col("node").alias("doc"), "mass")
        mass = cut(mass.join(entries, ["query_id", "doc"], "left_anti"))
        if texts is None:
            text = hits.select("query_id", "doc", (F.col("score") / F.max("score").over(W.partitionBy("query_id"))).alias("t"))
        else:
            scored = texts(mass.select("query_id", "doc"))
            scored = scored.join(tests, "doc", "left_anti") if settings.drop_tests else scored
            text = scored.join(hits.groupBy("query_id").agg(F.max("score").alias("top")), "query_id").select("query_id", "doc", (F.col("score") / F.col("top")).alias("t"))
        rated = mass.join(text, ["query_id", "doc"], "left").withColumn("sc", F.col("mass") * (1 + F.coalesce("t", F.lit(0.0)))).where("sc > 0")
        by = W.partitionBy("query_id").orderBy(F.desc("sc"), "doc")
        top = rated.withColumn("k", F.row_number().over(by)).where(F.col("k") <= settings.most_expanded).withColumn("best", F.max("sc").over(W.partitionBy("query_id")))
        branches.append(_rows(top, 10 + 70 * F.col("sc") / F.col("best"), F.lit("graph neighbour of the entry points"), 2, F.col("k")))
    else:
        # each task walks one way: to what the entry points need, or to what needs them
        plan = {"bug": (edges, 2, 60), "security": (back, 2, 70), "refactor": (back, 3, 80)}.get(task)
        if plan:
            way, depth, base = plan
            far = graph.distances(way, start, depth).where("distance > 0").select(F.col("seed_set").alias("query_id"), F.col("node").alias("doc"), "distance")
            branches.append(_rows(far, base - 10 * F.col("distance"), F.concat(F.lit("at distance "), F.col("distance").cast("string")), 2, F.col("distance")))
        if task == "feature":
            branches.append(_rows(of_entry(edges), F.lit(40), F.lit("dependency of an entry point"), 4, F.col("place")))
        if task == "security":
            branches.append(_rows(of_entry(edges).join(flagged, "doc", "left_semi"), F.lit(50), F.lit("flagged dependency"), 4, F.col("place")))
    if task == "feature":
        votes = entries.join(group_of, "doc").groupBy("query_id", "grp").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        two = votes.withColumn("v", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "first"))).where("v <= 2")
        lead = two.join(members.where("at <= 8"), "grp")
        branches.append(_rows(lead, 51 - F.col("at"), F.lit("central member of a group"), 3, F.col("v") * 100 + F.col("at")))
    elif task == "bug":
        branches.append(_rows(of_entry(back).join(tests, "doc", "left_semi"), F.lit(45), F.lit("test of an entry point"), 3, F.col("place")))
    elif task == "security":
        same = entries.join(group_of, "doc").select("query_id", "grp", "place").join(members.select("grp", "doc", "at").join(flagged, "doc", "left_semi"), "grp")
        branches.append(_rows(same, F.lit(55), F.lit("flagged file in the same group"), 3, F.col("place") * 1000 + F.col("at")))
    if settings.keep_strong:
        strong = hits.withColumn("top", F.max("score").over(W.partitionBy("query_id"))).where(F.col("score") >= 0.5 * F.col("top")).join(entries, ["query_id", "doc"], "left_anti")
        if implements is not None:
            strong = strong.join(implements.select("doc").distinct(), "doc", "left_anti")
        branches.append(_rows(strong, 90 + F.col("score") / F.col("top"), F.lit("strong text match"), 5, F.col("rank")))
    rows = reduce(DataFrame.unionByName, branches)
    if settings.drop_tests:
        rows = rows.join(tests, "doc", "left_anti")
    best = rows.groupBy("query_id", "doc").agg(F.max_by("reason", F.struct("score", -F.col("branch"), -F.col("at"))).alias("reason"), F.max("score").alias("score"), F.min(F.struct("branch", "at")).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "doc")
    return best.withColumn("position", F.row_number().over(order)).select("query_id", "doc", "score", "reason", "position")


#: Positions of a query that are summed up in one task.
_CHUNK = 4096


def pack(items: DataFrame, budget: int) -> DataFrame:
    """query_id, doc, position, packed: greedy in order; what would exceed the budget is left out, later and smaller items still fit.

    items: query_id, doc, position, size. Done in rounds, for all queries at once.
    Of what is undecided, an item is large if it takes more than half of the room
    that is left, so at most one of these can still be packed. The others are
    packed in order up to the first event: a large item that fits behind them, which
    is packed and takes half the room, or a small one that does not fit, which
    means that half the room is used. Large items before the event do not fit. So
    a round halves the room, and there are no more rounds than the budget has
    bits. Running sums are made in chunks of positions. Items without a size are
    left out.
    """
    cols = ["query_id", "doc", "position", "size"]
    rows = cut(items.select("query_id", "doc", F.col("position").cast("long").alias("position"), F.col("size").cast("long").alias("size")))  # met several times
    left, taken = rows.where(F.col("size") <= budget).withColumn("room", F.lit(budget).cast("long")), None
    while True:
        large = F.col("size") * 2 > F.col("room")
        left = left.withColumn("chunk", F.floor(F.col("position") / _CHUNK)).withColumn("small", F.when(large, 0).otherwise(F.col("size")))
        chunks = left.groupBy("query_id", "chunk").agg(F.sum("small").alias("sum"))
        ahead = chunks.select("query_id", "chunk", F.coalesce(F.sum("sum").over(W.partitionBy("query_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        inside = F.coalesce(F.sum("small").over(W.partitionBy("query_id", "chunk").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = left.withColumn("inside", inside).join(ahead, ["query_id", "chunk"]).withColumn("before", F.col("ahead") + F.col("inside"))
        fits = F.col("before") + F.col("size") <= F.col("room")
        event = F.min(F.when(large == fits, F.struct("position", fits.alias("packs"), "before", "size"))).alias("event")  # a large one that fits, a small one that does not
        ends = placed.groupBy("query_id").agg(event).select("query_id", "event.position", "event.packs", F.col("event.before").alias("used"), F.col("event.size").alias("event_size")).withColumnRenamed("position", "end")
        both = placed.join(ends, "query_id")
        packed = F.when(F.col("end").isNull() | (F.col("position") < F.col("end")), ~large).otherwise((F.col("position") == F.col("end")) & F.col("packs"))
        rest = F.col("room") - F.col("used") - F.when(F.col("packs"), F.col("event_size")).otherwise(0)
        open_ = (F.col("position") > F.col("end")) & (F.col("size") <= rest)
        round_ = cut(both.where(packed | F.coalesce(open_, F.lit(False))).select(*cols, packed.alias("packed"), rest.alias("room")))
        done = round_.where("packed").select("query_id", "position", "packed")
        taken = done if taken is None else taken.unionByName(done)
        left = round_.where("not packed").select(*cols, "room")
        if left.isEmpty():
            break
    return rows.join(taken, ["query_id", "position"], "left").select("query_id", "doc", "position", F.coalesce("packed", F.lit(False)).alias("packed"))


def as_json(gathered: DataFrame) -> DataFrame:
    """query_id, json: the items of each query in order."""
    item = F.struct("position", "doc", F.round("score", 2).alias("score"), "reason")
    return gathered.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))
