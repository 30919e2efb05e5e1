"""Approximate nearest neighbours with a forest of random-projection trees.

The largest inner product is found as the smallest distance: every vector x gets
one more component, sqrt(M^2 - |x|^2) with M the largest norm of the whole table, so
that all lie on one sphere; queries get 0 there and the length M, which changes no
order of their inner products. Trees are grown and searched in this space, and
scores are taken from the vectors as they are.

Fitting: a bounded sample (``SAMPLE`` vectors with the smallest hashes of their
ids, equal vectors once) is split by hyperplanes between two random points, at
the gap next to the median, ``DEPTH`` times. The forest with its sample is
the only thing that reaches the driver and is broadcast; its size is bounded by
the sample and the number of trees.

Index: every vector goes down every tree and lies in one leaf of each.

Search: all trees of the forest share one priority queue. The branch with the
smallest sum of squared margins is taken next, whichever tree it belongs to. A
query's scores with the sample are known, so the search ends as soon as its leaves
hold ``RECALL`` of the ``AIM`` * k best vectors of the sample: after few leaves in a
cluster, after most of them where vectors spread evenly. All vectors together are
nearer to a query than a sample of them, so their k best lie in the leaves that are
taken first. With ``share`` the search ends when the leaves hold that many times the
sample instead (vectors that several trees find count each time). In either case it
ends when the next branch lies farther off than the k-th best found so far.

Ranking: queries and vectors meet by leaf in a join, so a query meets its leaves'
vectors only; all of them are candidates and are ranked by their exact inner
products in double precision. The k-th best of the sample vectors in a query's
own leaves is a lower bound of its k-th best candidate, so no leaf sends back
what lies below it. Leaves are joined in slices of ``TILE`` vectors by ``QUERIES``
queries, so a task's memory is fixed however crowded a leaf is.

Defined cases: vectors that are null, zero, of another than the commonest
dimension, or hold null or non-finite components take no part; rows that repeat
id and vector count once; another vector under the same id is another query (with
a ranking of its own under the same id) and another candidate (the better of the
two counts), and an id is never its own neighbour; rows with a null id take no
part; ties go to the smaller id; an empty table gives an empty result; further
columns may have any names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.llm import textblocks as tb
from corpusloom.plans.session import checkpoint_ready, cut

TREES, DEPTH, SAMPLE, RECALL, AIM = 8, 7, 16384, 0.95, 2
#: Vectors of a leaf and queries that one task compares; leaves between two looks at whether the search can end.
TILE, QUERIES, LOOK = 4096, 2048, 8


@dataclass
class Forest:
    planes: np.ndarray  # nodes x dimensions
    cuts: np.ndarray  # threshold of each node
    children: list[list[int]]  # of each node; a negative number is ~leaf
    roots: list[int]
    members: list[np.ndarray]  # rows of the sample in each leaf
    sample: np.ndarray
    ids: np.ndarray  # of the sample's rows
    again: np.ndarray  # which rows have the id of an earlier one; an id counts once among the k best
    reach: float  # norm of all vectors

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors x trees) leaf that each vector falls into."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = ~node
                elif len(rows):
                    right = vectors[rows] @ self.planes[node] >= self.cuts[node]
                    stack += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def search(self, margins: np.ndarray, scores: np.ndarray, k: int, recall: float = RECALL, share: float | None = None) -> tuple[list[int], float]:
        """Leaves in the order of the shared queue, and a lower bound of the k-th best score in them.

        margins: of all nodes; scores: of all rows of the sample (-inf for the query's own).
        """
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found, held, pushed, best, looked, met = [], 0, len(queue), np.zeros(0), 0, 0
        seen, wanted = np.zeros(len(self.sample), dtype=bool), np.zeros(len(self.sample), dtype=bool)
        order = np.argpartition(-scores, min(AIM * k, len(scores)) - 1)[: AIM * k] if len(scores) else np.zeros(0, np.int64)
        wanted[order[np.isfinite(scores[order])]] = True
        enough = math.ceil(recall * int(wanted.sum()) - 1e-9)
        sides, costs = (margins >= 0).astype(np.int64).tolist(), (margins * margins).tolist()
        reach = 2 * self.reach * self.reach
        while True:
            done = not queue or (met >= enough if share is None else held >= share * len(self.sample))
            if done or len(found) - looked == LOOK:
                new = np.concatenate([self.members[x] for x in found[looked:]]) if len(found) > looked else np.zeros(0, np.int64)
                new = np.unique(new[~seen[new]])
                seen[new] = True
                best, looked = np.concatenate([best, scores[new]]), len(found)
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
            if done:
                break
            cost, _, node = heapq.heappop(queue)
            if len(best) == k and cost > max(0.0, reach - 2 * float(best.min())):
                queue = []
                continue
            while node >= 0:
                side, pushed, pair = sides[node], pushed + 1, self.children[node]
                heapq.heappush(queue, (cost + costs[node], pushed, pair[1 - side]))
                node = pair[side]
            found.append(~node)
            rows = self.members[~node]
            held += len(rows)
            met += int(wanted[rows].sum())
            wanted[rows] = False
        return found, float(best.min()) if len(best) == k else -np.inf


def lifted(vectors: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with the component that makes their norm ``reach``."""
    return np.hstack([vectors, np.sqrt(np.maximum(reach * reach - (vectors * vectors).sum(axis=1), 0.0))[:, None]])


def grow(sample: np.ndarray, ids: np.ndarray, reach: float, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """A forest over lifted vectors."""
    sample, first = np.unique(sample, axis=0, return_index=True)
    ids = ids[first]
    rng = np.random.default_rng(seed)
    planes, cuts, children, members, roots = [], [], [], [], []

    def split(rows: np.ndarray, level: int) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(8 if level < depth and len(rows) > 1 else 0):
            i, j = rng.choice(len(rows), 2, replace=False)
            plane = sample[rows[i]] - sample[rows[j]]
            length = np.linalg.norm(plane)
            if not np.isfinite(length) or length == 0:
                continue
            plane = plane / length
            on = sample[rows] @ plane
            order = np.sort(on)
            gaps = np.flatnonzero(order[1:] - order[:-1] > 1e-9 * max(1.0, float(np.abs(order).max())))  # no row may lie on a cut, where rounding decides
            if len(gaps):
                at = gaps[np.abs(gaps - (len(order) - 1) / 2).argmin()]
                cut_at = float((order[at] + order[at + 1]) / 2)
                return plane, cut_at, on >= cut_at
        return None

    for _ in range(trees):
        todo = [(np.arange(len(sample)), -1, 0, 0)]
        while todo:
            rows, parent, side, level = todo.pop()
            found = split(rows, level)
            if found is None:
                name = ~len(members)
                members.append(rows)
            else:
                name = len(planes)
                planes.append(found[0])
                cuts.append(found[1])
                children.append([0, 0])
                todo += [(rows[~found[2]], name, 0, level + 1), (rows[found[2]], name, 1, level + 1)]
            if parent < 0:
                roots.append(name)
            else:
                children[parent][side] = name
    dim = sample.shape[1]
    again = np.ones(len(ids), dtype=bool)
    again[np.unique(ids, return_index=True)[1]] = False
    return Forest(np.array(planes).reshape(-1, dim), np.array(cuts), children, roots, members, sample, ids, again, reach)


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _hits(Q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, V: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, exact score) of the candidates at or above their query's bound, k at most for each query."""
    rough = Q @ V.T
    slack = 1e-9 * np.maximum(1.0, np.abs(bounds))
    at_q, at_v = np.nonzero((rough >= np.where(np.isfinite(bounds), bounds - slack, -np.inf)[:, None]) & (ids[None, :] != q_ids[:, None]))
    times = np.bincount(at_q, minlength=len(Q))
    if len(at_q) and times.max() > k:  # equal vectors may come in any number
        keep = []
        ends = np.cumsum(times)
        for r in np.flatnonzero(times):
            part = np.arange(ends[r] - times[r], ends[r])
            if len(part) > k:
                score = (V[at_v[part]] * Q[r]).sum(axis=1)
                part = part[np.lexsort((ids[at_v[part]], -score))[:k]]
            keep.append(part)
        keep = np.concatenate(keep)
        at_q, at_v = at_q[keep], at_v[keep]
    return at_q, at_v, (V[at_v] * Q[at_q]).sum(axis=1)  # one order of summation for all, so equal vectors have equal scores


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = rows[vector_col]
    named = rows.select(rows[id_col].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return named.where(fine).distinct()


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE, recall: float = RECALL, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by ``every``."""
    spark = rows.sparkSession
    checkpoint_ready(spark)
    result = "query_id long, rank int, vec_id long, score double"
    good = usable(rows, id_col, vector_col)
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["asked"]:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    good = good.where(F.size("v") == dim)
    taken = good.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # bounded by `sample`
    reach = float(good.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0])
    forest = spark.sparkContext.broadcast(grow(lifted(_matrix(taken.column("v"), dim), reach), taken.column("id").to_numpy(), reach, trees, depth))

    @tb.lean
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                leaves = forest.value.leaves_of(lifted(_matrix(part.column(1), dim), reach))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)), pa.array(leaves.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["id", "v", "leaves"])

    @tb.lean
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forest.value
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                ids, Q = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                size = reach / np.sqrt((Q * Q).sum(axis=1))
                Q = np.hstack([Q * size[:, None], np.zeros((len(Q), 1))])
                margins, scores = Q @ model.planes.T - model.cuts, Q @ model.sample.T
                scores[(ids[:, None] == model.ids[None, :]) | model.again[None, :]] = -np.inf
                found = [model.search(margins[r], scores[r], k, recall, share) for r in range(len(ids))]
                found = [(leaves, bound / s) for (leaves, bound), s in zip(found, size.tolist())]
                cuts = np.cumsum([0, *(len(x) for x, _ in found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.array([x for ls, _ in found for x in ls], dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([x for _, x in found], pa.float64())], ["id", "v", "leaves", "bound"])

    def rank(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if vectors.num_rows and queries.num_rows:
            ids, V = vectors.column("id").to_numpy(), _matrix(vectors.column("v"), dim)
            q_ids, q_hash, bounds, Q = queries.column("id").to_numpy(), queries.column("h").to_numpy(), queries.column("bound").to_numpy(), _matrix(queries.column("v"), dim)
            for lo in range(0, len(q_ids), 256):
                part = slice(lo, lo + 256)
                at_q, at_v, score = _hits(Q[part], q_ids[part], bounds[part], V, ids, k)
                out.append((q_ids[part][at_q], q_hash[part][at_q], ids[at_v], score))
        return pa.table(dict(zip(("query_id", "h", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    leaves_field = T.StructField("leaves", T.ArrayType(T.IntegerType()))
    routed = cut(good.mapInArrow(route, T.StructType([*good.schema.fields, leaves_field])))
    # a number of tasks of its own, as small rows that cost much work would else be dealt to a single one
    tasks = max(1, min(-(-sizes["asked"] // 128), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    probes = good.where(F.col("id") % every == 0).repartition(tasks, "id", F.xxhash64("v"))
    probes = cut(probes.mapInArrow(probe, T.StructType([*good.schema.fields, leaves_field, T.StructField("bound", T.DoubleType())])))
    # as many rows as the forest has leaves
    vectors_in = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / TILE).alias("slices"))
    queries_in = probes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
    sizes_of = F.broadcast(cut(vectors_in.join(queries_in, "leaf")))
    left = routed.select("id", "v", F.explode("leaves").alias("leaf")).join(sizes_of, "leaf")
    left = left.withColumn("slice", F.pmod(F.xxhash64("id", "v"), "slices")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    right = probes.select("id", "v", "bound", F.xxhash64("v").alias("h"), F.explode("leaves").alias("leaf")).join(sizes_of, "leaf")
    right = right.withColumn("group", F.pmod(F.xxhash64("id", "v"), "groups")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    by, fresh = ["leaf", "slice", "group"], [F.col(c).alias(c) for c in ("leaf", "slice", "group", "id", "v")]
    met = left.select(*fresh).groupBy(*by).cogroup(right.select(*fresh, "bound", "h").groupBy(*by))
    found = met.applyInArrow(rank, "query_id long, h long, vec_id long, score double")
    each = found.groupBy("query_id", "h", "vec_id").agg(F.max("score").alias("score"))  # several trees may find the same
    place = F.row_number().over(W.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
