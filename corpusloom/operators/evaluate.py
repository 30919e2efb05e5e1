"""Evaluation studies: relations of file pairs, rankers for files that change together, summaries and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators import order, quantiles, search
from corpusloom.plans.session import cut, small

#: Messages of sources of an older language version, and words that name broken fixtures.
OLD_MESSAGES = ["Missing parentheses in call to", "leading zeros in decimal integer literals", "multiple exception types must be parenthesized", "invalid hexadecimal literal"]
FIXTURE_WORDS = "bad broken invalid syntax error fail corrupt malformed".split()
#: Beginnings of reasons, and the part of retrieval that they come from.
COMPONENTS = [
    ("entry point", "entry"),
    ("implements requirement", "entry"),
    ("strong text match", "band"),
    ("graph neighbour", "ppr"),
    ("dependency at distance", "walk-dep"),
    ("caller at distance", "walk-caller"),
    ("blast radius", "walk-caller"),
    ("dependency of", "walk-dep"),
    ("central member", "extra-subsystem"),
    ("test exercising", "extra-test"),
    ("security-flagged", "extra-security"),
]


def component_of(reason: Column) -> Column:
    """The part of retrieval that gave a reason; 'other' without a known beginning."""
    return reduce(lambda out, pair: F.when(F.startswith(F.coalesce(reason, F.lit("")), F.lit(pair[0])), pair[1]).otherwise(out), reversed(COMPONENTS), F.lit("other"))


def parse_error_cause(path: Column, error: Column) -> Column:
    low = F.lower(path)
    in_tests = F.exists(F.split(low, "/"), lambda p: F.startswith(p, F.lit("test")))
    names_fault = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in FIXTURE_WORDS))
    old = reduce(lambda a, b: a | b, (F.contains(error, F.lit(m)) for m in OLD_MESSAGES))
    return F.when(in_tests & names_fault, "Intentionally broken test fixtures").when(F.coalesce(old, F.lit(False)), "Python 2 syntax").otherwise("Other")


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, p90 and max of a value by group."""
    v = F.col(value)
    plain = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    at = quantiles.quantiles(rows, by, value, [0.5, 0.9])
    wide = at.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(F.when(F.col("share") == 0.5, F.col("quantile"))).alias("median"), F.max(F.when(F.col("share") == 0.9, F.col("quantile"))).alias("p90"))
    same = reduce(lambda a, b: a & b, (plain[c].eqNullSafe(wide[f"_{c}"]) for c in by), F.lit(True))
    return plain.join(wide, same, "left").select(*by, "n", "mean", "median", "p90", "max")


def macro(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Mean over groups of the groups' means."""
    return rows.groupBy(*by, group).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.count("*").alias("groups"), F.avg("m").alias("macro"))


def pick_one_each(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order with at most one of each group."""
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_k = 1").drop("_k")
    return first.orderBy(*order).limit(n)


def random_key(by: str, item: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), F.col(item).cast("string")).cast("binary"))


def shuffled(rows: DataFrame, by: str, item: str, seed: int = 0) -> DataFrame:
    """by, item and rank in an order that depends on the seed and both names alone."""
    return order.arranged(rows.select(by, item, random_key(by, item, seed).alias("_key")), [by], [F.col("_key"), F.col(item)], place="rank").select(by, item, "rank")


def anchored_pairs(found: DataFrame, missed: DataFrame, pool: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """query_id, kind, src, dst: each found document with each missed one (gold), and with n of its query's pool (random).

    Pairs meet within a query, whose found and missed documents are few; the n
    of a pool are drawn first, so a found document never meets a whole pool.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("doc").cast("string")).cast("binary"))
    drawn = pool.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(key, "doc"))).where(F.col("k") <= n)
    pair = lambda other, kind: found.select("query_id", F.col("doc").alias("src")).join(other.select("query_id", F.col("doc").alias("dst")), "query_id").select("query_id", F.lit(kind).alias("kind"), "src", "dst")
    return pair(missed, "gold").unionByName(pair(drawn, "random"))


def relation_flags(pairs: DataFrame, files: DataFrame, edges: DataFrame, tests: DataFrame, distances: DataFrame) -> DataFrame:
    """pairs (src, dst) with same_dir, same_pkg, import_edge, name_ref (only without an import), call_ref, shared_test and distance.

    files: path, defined, called, words (arrays of names). edges: src, dst.
    tests: path, test (tests that use a file). distances: src, dst, distance.
    """
    a, b = files.select(F.col("path").alias("src"), *[F.col(c).alias(f"a_{c}") for c in ("defined", "called", "words")]), files.select(F.col("path").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in ("defined", "called", "words")])
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    package = lambda p: F.slice(F.split(folder(p), "/"), 1, 2)
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("import_edge", F.lit(True))
    shared = pairs.select("src", "dst").distinct().join(tests.toDF("src", "test"), "src").join(tests.toDF("dst", "test"), ["dst", "test"]).select("src", "dst").distinct().withColumn("shared_test", F.lit(True))
    out = pairs.join(a, "src", "left").join(b, "dst", "left").join(near, ["src", "dst"], "left").join(shared, ["src", "dst"], "left").join(distances.select("src", "dst", "distance"), ["src", "dst"], "left")
    imports = F.coalesce("import_edge", F.lit(False))
    meets = lambda x: F.coalesce(F.arrays_overlap("b_defined", f"a_{x}") | F.arrays_overlap("a_defined", f"b_{x}"), F.lit(False))
    return out.select(
        *pairs.columns, (folder(F.col("src")) == folder(F.col("dst"))).alias("same_dir"), (package(F.col("src")) == package(F.col("dst"))).alias("same_pkg"), imports.alias("import_edge"),
        (~imports & meets("words")).alias("name_ref"), meets("called").alias("call_ref"), F.coalesce("shared_test", F.lit(False)).alias("shared_test"), "distance",
    )


def rankers(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """method, query_id, doc, rank: seven rankings of the files that may change with a seed file.

    candidates: query_id, doc, lexical (score or null), same_dir, distance (null
    beyond reach), weight (of a direct link), same_part, same_group.
    """
    columns = ["lexical", "same_dir", "distance", "weight", "same_part", "same_group"]
    lex = F.desc(F.round(F.coalesce("lexical", F.lit(0.0)), 9))
    place = lambda *by: F.row_number().over(W.partitionBy("query_id").orderBy(*by))
    near = F.when(F.col("distance").isNotNull(), 0).when(F.col("same_part"), 1).when(F.col("same_group"), 1).otherwise(2)
    at = lambda m: F.col(f"_{m}")
    fused = F.round(1 / (60 + at("lexical")) + 1 / (60 + at("graph")), 12)
    orders = [  # all by query, so a pair is sent once
        ("lexical", [lex, "doc"]),
        ("same directory", [F.desc("same_dir"), lex, "doc"]),
        ("community", [F.desc("same_part"), F.desc("same_group"), lex, "doc"]),
        ("graph", [near, F.asc_nulls_last("distance"), F.desc(F.coalesce("weight", F.lit(0.0))), lex, "doc"]),
        ("random", [random_key("query_id", "doc", seed), "doc"]),
        ("hybrid", [F.least(2 * at("graph") - 1, 2 * at("lexical"))]),
        ("fusion", [F.desc(fused), at("lexical"), "doc"]),
    ]
    ranked = reduce(lambda df, m: df.withColumn(f"_{m[0]}", place(*m[1])), orders, candidates.select("query_id", "doc", *columns))
    return unpivoted(ranked, {m: f"_{m}" for m, _ in orders})


def places(order: np.ndarray) -> np.ndarray:
    """The place (from 1) of each item of an order."""
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(1, len(order) + 1)
    return places


def fused_places(first: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places by reciprocal ranks; first: 1, 2, ..., by which ties go."""
    return places(np.argsort(-search.rounded(1 / (60 + first) + 1 / (60 + other), 12), kind="stable"))


def _by_first(pairs: dict[str, np.ndarray], score: str) -> dict[str, np.ndarray]:
    """Pairs in the order of a score."""
    best = np.argsort(-search.rounded(pairs[score], 9), kind="stable")
    return {name: x[best] for name, x in pairs.items()}


def random_places(pairs: dict[str, np.ndarray]) -> np.ndarray:
    return places(np.lexsort((pairs["number"], pairs["key"][:, 1], pairs["key"][:, 0])))


def _given(pairs: dict[str, np.ndarray], number: np.ndarray, value: np.ndarray, without: float) -> np.ndarray:
    """The value of each pair, by number; ``without`` where none is given."""
    by = np.argsort(pairs["number"], kind="stable")
    at = np.searchsorted(pairs["number"][by], number)
    there = at < len(by)
    there[there] = pairs["number"][by][at[there]] == number[there]
    out = np.full(len(by), without)
    out[by[at[there]]] = value[there]
    return out


def seven_places(pairs: dict[str, np.ndarray], given: Callable[[str, float], np.ndarray]) -> dict[str, np.ndarray]:
    """As ``rankers`` without parts, where the group is the folder. pairs: one query's, by lexical; given: distance and weight."""
    lexical, same, distance = np.arange(1, len(pairs["same"]) + 1), pairs["same"], given("distance", np.inf)
    near = np.where(np.isfinite(distance), 0, np.where(same, 1, 2))
    folder, linked = places(np.argsort(~same, kind="stable")), places(np.lexsort((-given("weight", 0.0), distance, near)))
    return {
        "lexical": lexical, "same directory": folder, "community": folder, "graph": linked, "random": random_places(pairs),
        "hybrid": places(np.argsort(np.minimum(2 * linked - 1, 2 * lexical))), "fusion": fused_places(lexical, linked),
    }


def gold_places(blocks: DataFrame, numbers: DataFrame, first: str, ways: list[str], facts: DataFrame, gold: DataFrame, rankings: Callable) -> DataFrame:
    """method, query_id, doc, rank of gold's documents in all rankings of their queries.

    blocks, numbers: of Meeting.blocks. facts: query_id, doc, kind, value, what is known of some pairs; kind
    'out' takes a document out of the rankings. gold: query_id, doc. rankings(pairs by the score ``first``,
    given(kind, without)): ranks by method. Pairs are sent once, packed; a query's are ranked as arrays, in one group.
    """
    wanted = cut(gold.select("query_id", "doc").distinct())
    more = facts.select("query_id", "doc", "kind", F.col("value").cast("double").alias("value")).unionByName(wanted.select("query_id", "doc", F.lit("gold").alias("kind"), F.lit(0.0).alias("value")))
    more = small(cut(more)).join(numbers, "doc").select("query_id", "number", "kind", "value")
    kind = blocks.schema["query_id"].dataType

    def ranks(left: pa.Table, right: pa.Table) -> pa.Table:
        names = np.array(right.column("kind").to_pylist(), object)
        number, value = right.column("number").to_numpy(), right.column("value").to_numpy()
        out = {"query_id": [], "number": [], "method": [], "rank": []}
        if left.num_rows and (names == "gold").any():
            pairs = search.opened(left, ways)
            kept = ~np.isin(pairs["number"], number[names == "out"])
            pairs = _by_first({name: x[kept] for name, x in pairs.items()}, first)
            at = np.flatnonzero(np.isin(pairs["number"], number[names == "gold"]))
            found = rankings(pairs, lambda name, without: _given(pairs, number[names == name], value[names == name], without)) if len(at) else {}
            for method, rank in found.items():
                out["query_id"] += [left.column("query_id")[0].as_py()] * len(at)
                out["number"] += pairs["number"][at].tolist()
                out["method"] += [method] * len(at)
                out["rank"] += rank[at].tolist()
        return pa.table(out, pa.schema([("query_id", left.schema.field("query_id").type), ("number", pa.int64()), ("method", pa.string()), ("rank", pa.int64())]))

    blocks = blocks.join(small(wanted.select("query_id").distinct()), "query_id", "left_semi")
    ranked = blocks.groupBy("query_id").cogroup(more.groupBy("query_id")).applyInArrow(ranks, f"query_id {kind.simpleString()}, number long, method string, rank long")
    return numbers.join(small(cut(ranked)), "number").select("method", "query_id", "doc", "rank")


def unpivoted(ranked: DataFrame, methods: dict[str, str]) -> DataFrame:
    """method, query_id, doc, rank from one column of ranks for each method."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("long").alias("rank")) for m, c in methods.items()])).alias("r")
    return ranked.select("query_id", "doc", each).select("r.method", "query_id", "doc", "r.rank")


def merged(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All keys of several sources, with the columns of each as name_column and has_name."""
    named = [df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key], F.lit(True).alias(f"has_{name}")) for name, df in parts.items()]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    return out.na.fill(False, [f"has_{name}" for name in parts])
