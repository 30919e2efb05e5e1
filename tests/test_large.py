"""Order, quantiles, packing, containment and resampling against plain versions, with one group of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import community, evaluate, order, pages, quantiles, retrieve, stats


def groups(spark, n=3000, seed=1):
    """One group holds all but a few rows; null is a group too; two rows of a group may be equal in all but the id."""
    rng = random.Random(seed)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["x", "y", None]), i, rng.choice([None, *range(50)])) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, id long, v long")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_sums_and_neighbours(spark, parts):
    rows, df = groups(spark)
    out = order.arranged(df, ["g"], [F.desc("v"), F.col("id")], sums={"total": F.coalesce("v", F.lit(0))}, following={"next": "id"}, parts=parts)
    assert out.columns == ["g", "id", "v", "place", "total", "next"]
    got = {r.id: (r.place, r.total, r.next) for r in out.collect()}
    wanted = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        total = 0
        for k, (_, i, v) in enumerate(mine):
            total += v or 0
            wanted[i] = (k + 1, total, mine[k + 1][1] if k + 1 < len(mine) else None)
    assert got == wanted


def test_places_of_one_group_and_of_none(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.place for r in order.arranged(df, [], [F.col("k")], parts=7).orderBy("k").collect()]
    assert got == list(range(1, 1001))
    assert order.arranged(df.limit(0), [], [F.col("k")], following={"n": "id"}).collect() == []


def test_no_task_holds_a_large_group(spark):
    df = spark.range(4000).select(F.lit("all").alias("g"), F.col("id"))
    plan = order.arranged(df, ["g"], [F.col("id")], parts=8)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "windowspecdefinition" in line]
    assert len(windows) == 2
    for line in windows:  # rows are numbered by part; by group alone only the sums of its parts are
        assert "windowspecdefinition(_part#" in line or "_n#" in line


def test_shuffled_and_ranked(spark):
    rows = [("all", i) for i in range(500)]
    a = evaluate.shuffled(spark.createDataFrame(rows, "g string, item int"), "g", "item").collect()
    b = evaluate.shuffled(spark.createDataFrame(rows[::-1], "g string, item int").repartition(7), "g", "item").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sorted(r["rank"] for r in a) == list(range(1, 501))
    m = spark.createDataFrame([(f"n{i}", 0) for i in range(100)], "node string, grp int")
    rank = spark.createDataFrame([(f"n{i}", float(i % 10)) for i in range(90)], "node string, rank double")
    got = [r.node for r in community.ranked(m, rank).orderBy("place").collect()]
    value = lambda n: float(int(n[1:]) % 10) if int(n[1:]) < 90 else None
    assert got == sorted((f"n{i}" for i in range(100)), key=lambda n: (value(n) is None, -(value(n) or 0), n))


@pytest.mark.parametrize(("few", "ranges"), [(1 << 16, 256), (6, 8)])
def test_quantiles_equal_numpy(spark, few, ranges):
    rng = np.random.default_rng(4)
    parts = {"even": rng.normal(size=900), "ties": rng.integers(0, 5, 700).astype(float), "one": np.array([3.5]), "heavy": np.concatenate([np.full(800, 10.0), rng.integers(0, 9, 60)]), None: np.arange(11.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in parts.items() for v in vs] + [("even", None), ("none", None), ("ties", float("nan"))], "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.quantile for r in quantiles.quantiles(df, ["g"], "v", shares, few, ranges).collect()}
    assert set(got) == {(g, s) for g in parts for s in shares}
    for (g, s), q in got.items():
        assert q == pytest.approx(np.quantile(parts[g], s), abs=1e-12)
    whole = {r.share: r.quantile for r in quantiles.quantiles(df.where("not isnan(v)"), [], "v", [0.5], few, ranges).collect()}
    assert whole[0.5] == pytest.approx(np.quantile(np.concatenate(list(parts.values())), 0.5))


def test_summary_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("b", None), (None, 4)], "g string, v long")
    got = {r.g: (r.n, r["mean"], r.median, r.max) for r in evaluate.summary(df, ["g"], "v").collect()}
    assert got == {"a": (3, 13 / 3, 2.0, 10), "b": (0, None, None, None), None: (1, 4.0, 4.0, 4)}


def fold(sizes, budget):
    used, out = 0, []
    for s in sizes:
        out.append(s is not None and used + s <= budget)
        used += s if out[-1] else 0
    return out


def test_packing_equals_the_fold(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "_CHUNK", 16)  # many chunks
    rng, cases = random.Random(8), {}
    budget = 1000
    for q in range(40):
        kind = q % 5
        n = rng.choice([1, 3, 40, 300])
        sizes = [rng.randint(0, (2000, 120, 1200, 6, 700)[kind]) for _ in range(n)]
        if kind == 2:
            sizes = [x for k in range(min(n, 100)) for x in (1, budget - k)]  # what fits falls by one at a time
        cases[q] = sizes
    cases[90], cases[91], cases[92] = [budget, 1, 0], [None, 1000], [501, 499, 1, 0]
    items = spark.createDataFrame([(q, f"d{k}", k + 1, s) for q, sizes in cases.items() for k, s in enumerate(sizes)], "query_id int, doc string, position int, size int")
    got = {}
    for r in retrieve.pack(items, budget).collect():
        got.setdefault(r.query_id, {})[r.position] = r.packed
    for q, sizes in cases.items():
        assert [got[q][k + 1] for k in range(len(sizes))] == fold(sizes, budget), (q, sizes)


def test_passages_of_any_length_are_found(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "cab", "é", "x.y", "\n", "$"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "abc" * 2000]
    passages = ["b", "ab c", "cab", "é é", "x.y $", "abcabc", "", None, "b", "not there", " ".join(["abc", "b", "cab"]), texts[0]]
    p = spark.createDataFrame(list(enumerate(passages)), "i int, t string")
    d = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "j int, t string").repartition(4)
    wanted = {(i, 100 + k) for i, a in enumerate(passages) if a for k, t in enumerate(texts) if t is not None and a in t}
    for most in (1 << 20, 12):  # one automaton, and several
        assert {tuple(r) for r in pages.containing(p, "i", p["t"], d, "j", d["t"], most).collect()} == wanted
    assert pages.containing(p.limit(0), "i", p["t"], d, "j", d["t"]).collect() == []


def test_statistics_share_their_draws(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.gamma(2.0, 3.0, size=(400, 2)))]
    df = spark.createDataFrame(rows, "i long, x double, y double").repartition(5)
    sums = {"x": F.col("x"), "y": F.col("y"), "n": F.lit(1)}
    out = {r.statistic: r for r in stats.bootstrap(df, F.col("i"), sums, {"mean x": F.col("x") / F.col("n"), "mean y": F.col("y") / F.col("n"), "same": (F.col("x") - F.col("x")) / F.col("n"), "difference": (F.col("x") - F.col("y")) / F.col("n")}, 2000).collect()}
    x = np.array([r[1] for r in rows])
    assert out["mean x"].estimate == pytest.approx(x.mean()) and out["mean x"].low < x.mean() < out["mean x"].high
    assert out["mean x"].high - out["mean x"].low == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.1)
    assert out["same"].low == out["same"].high == 0  # within one draw, and not between two
    assert out["difference"].estimate == pytest.approx(out["mean x"].estimate - out["mean y"].estimate)
    keys = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    copies = stats._copies(keys, 2000, 0)
    means = (x @ copies) / copies.sum(axis=0)
    assert out["mean x"].low == pytest.approx(np.quantile(means, 0.025)) and out["mean x"].high == pytest.approx(np.quantile(means, 0.975))
    twice = spark.createDataFrame(rows, "i long, x double, y double").coalesce(1)
    assert stats.bootstrap(twice, F.col("i"), sums, {"m": F.col("x") / F.col("n")}, 50).first().low == pytest.approx(stats.bootstrap(df, F.col("i"), sums, {"m": F.col("x") / F.col("n")}, 50).first().low)


def test_signed_ranks_of_more_rows_than_a_cube_of_longs_holds(spark):
    n = 2_000_000  # differences of -1, 1 and 2, a quarter, a quarter and a half
    d = spark.range(n).select(F.element_at(F.array(F.lit(-1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)), (F.col("id") % 4 + 1).cast("int")).alias("d"))
    got = stats.wilcoxon(d, "d").collect()[0]
    q = n // 4
    assert got.n == n and got.w == q * (2 * q + 1) / 2 + 2 * q * (2 * q + (2 * q + 1) / 2) and got.p == 0.0


def test_draws_by_table_are_those_of_the_distribution_function():
    u = np.uint64
    keys = np.random.default_rng(3).integers(0, 1 << 63, 40).astype(u)
    x = keys[:, None] + np.arange(6100, 9000, dtype=u)[None, :] * u(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(factor)
    plain = np.searchsorted(stats._POISSON, ((x ^ (x >> u(31))) >> u(11)).astype(float) * 2.0**-53, side="right")
    assert np.array_equal(stats._copies(keys, 3000, 2, 100), plain)


def test_interval_draws_once(spark, tmp_path, monkeypatch):
    from corpusloom.plans import more_queries

    rows = [(i // 3, "R" if i % 4 == 0 else "N", 100.0 + i % 7) for i in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = more_queries.bootstrap_ci(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # the resamples are drawn once, and their one row is written
