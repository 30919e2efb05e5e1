"""Resampling and rank tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RESAMPLES = 10_000


#: Rows and resamples of a block of draws (which stays in a core's cache), and the distribution function of a Poisson variable of mean 1.
_ROWS, _BLOCK = 32, 1000
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 20)))))
#: Numbers by the first 16 bits of a draw; -1 where these do not decide.
_BITS = 16
_NUMBERS = np.searchsorted(_POISSON, np.arange(1 << _BITS) / 2.0**_BITS, side="right").astype(np.float64)
_NUMBERS[_NUMBERS != np.searchsorted(_POISSON, np.nextafter(np.arange(1, (1 << _BITS) + 1) / 2.0**_BITS, 0), side="right")] = -1


def _copies(keys: np.ndarray, resamples: int, seed: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """(keys x resamples first to last) Poisson numbers that depend on key, resample and seed alone."""
    u = np.uint64
    x = keys[:, None] + ((np.arange(first, resamples if last is None else last, dtype=u) + u(resamples * seed)) * u(0x9E3779B97F4A7C15))[None, :]
    y = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # finaliser of splitmix64
        x ^= np.right_shift(x, u(shift), out=y)
        x *= u(factor)
    x ^= np.right_shift(x, u(31), out=y)
    out = np.take(_NUMBERS, np.right_shift(x, u(64 - _BITS), out=y).view(np.int64), mode="wrap").ravel()
    open_ = np.flatnonzero(out < 0)
    out[open_] = np.searchsorted(_POISSON, (x.ravel()[open_] >> u(11)).astype(np.float64) * 2.0**-53, side="right")
    return out.reshape(x.shape)


def bootstrap(rows: DataFrame, key: Column, sums: dict[str, Column], statistics: dict[str, Column], resamples: int = RESAMPLES, seed: int = 0, level: float = 0.95) -> DataFrame:
    """statistic, estimate, low, high: intervals of several statistics from one set of resamples.

    sums: name -> value of a row; a statistic is an expression over the sums'
    names (their ratios, means, lifts, and differences between them). Every row
    draws its number of copies in each resample from a Poisson distribution, by
    its key (a 64-bit integer), the resample and the seed alone, in its own task.
    All sums of a resample share the draw, so the difference of two statistics
    is taken within a resample. Only resamples x sums numbers of each task travel.
    A statistic that is null in a resample (an empty divisor) does not count there.
    """
    names = list(sums)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), resamples))
        for pdf in batches:
            keys, values = pdf["_key"].to_numpy().view(np.uint64), pdf[names].to_numpy(dtype=float).T
            for lo in range(0, len(keys), _ROWS):
                own, mine = keys[lo : lo + _ROWS], values[:, lo : lo + _ROWS]
                for k in range(0, resamples, _BLOCK):
                    end = min(k + _BLOCK, resamples)
                    total[:, k:end] += mine @ _copies(own, resamples, seed, k, end)
        yield pd.DataFrame({"k": np.arange(resamples)} | dict(zip(names, total)))

    keyed = rows.select(key.cast("long").alias("_key"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in sums.items()])
    # dealt by a fixed number, as few bytes make much work here and would be put together into few tasks
    dealt = keyed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    drawn = dealt.mapInPandas(draw, "k long, " + ", ".join(f"`{n}` double" for n in names)).groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), v.cast("double").alias("v")) for name, v in statistics.items()])).alias("s")
    tail = (1 - level) / 2
    interval = drawn.select(each).select("s.*").groupBy("statistic").agg(F.percentile("v", tail).alias("low"), F.percentile("v", 1 - tail).alias("high"))  # resamples rows each
    point = keyed.agg(*[F.sum(n).alias(n) for n in names]).select(each).select("s.statistic", F.col("s.v").alias("estimate"))
    return point.join(interval, "statistic")


def bootstrap_ratio(rows: DataFrame, over: str, under: str, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """estimate, low, high (95 %) of sum(over) / sum(under), instances resampled, which draw by their content."""
    found = bootstrap(rows, F.xxhash64(*rows.columns), {"a": F.col(over), "b": F.col(under)}, {"ratio": F.try_divide("a", "b")}, resamples, seed)
    return found.select("estimate", "low", "high")


def upper_tail(z: Column) -> Column:
    """Two-sided normal p of |z| (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _before(counts: DataFrame) -> DataFrame:
    """counts (v, t, ...) with the sum of t over all smaller v: running sums within ranges of v, and over the ranges."""
    cuts = counts.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)])).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
    placed = counts.withColumn("part", part)
    sums = placed.groupBy("part").agg(F.sum("t").alias("all"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")  # one row a range
    inside = F.coalesce(F.sum("t").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inside", inside).join(F.broadcast(ahead), "part").withColumn("before", F.col("ahead") + F.col("inside")).drop("part", "inside", "ahead")


def mann_whitney(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """n1, n2, u (of the rows where group holds), p by the normal approximation with tie correction."""
    r = rows.select(F.col(value).alias("v"), group.alias("g")).where("v is not null and g is not null")
    by_value = r.groupBy("v").agg(F.count("*").alias("t"), F.count_if("g").alias("k"))
    ranked = _before(by_value).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2.0)
    s = ranked.agg(F.sum("k").alias("n1"), (F.sum("t") - F.sum("k")).alias("n2"), F.sum(F.col("k") * F.col("rank")).alias("r1"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1.0)))
    return s.select("n1", "n2", u.alias("u"), upper_tail(F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, F.sqrt(var))).alias("p"))


def wilcoxon(rows: DataFrame, difference: str) -> DataFrame:
    """n (nonzero differences), w (rank sum of the positive ones), p by the normal approximation."""
    d = rows.select(F.col(difference).alias("d")).where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).alias("g"))
    by_value = d.groupBy("v").agg(F.count("*").alias("t"), F.count_if("g").alias("k"))
    ranked = _before(by_value).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2.0)
    s = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") * F.col("rank")), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")), F.lit(0.0)).alias("ties"))
    n = F.col("n").cast("double")  # its cube goes beyond a long from 1.7 million rows on
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return s.select("n", "w", upper_tail(F.try_divide(F.col("w") - n * (n + 1) / 4.0, F.sqrt(var))).alias("p"))
