"""Whitening of vectors along their principal components.

Components become integers, floor(scale * c) + shift, whose sums over all rows
are exact. Rows are centred before anything is multiplied: (n * x - S) / n, where
n * x - S is an exact integer. MLlib's RowMatrix adds up the Gramian matrix of
these rows on the executors; divided by n it is the covariance, dimensions x
dimensions whatever the number of rows. The driver takes its eigenvectors, which
are broadcast, and rows are projected in mapInPandas. The projected rows are
written to the shared checkpoint folder, and their own covariance, centred again
before multiplying, is compared with the identity.

Defined cases: null vectors and those that hold null or non-finite components are dropped;
vectors shorter than the longest are filled up with zeros (before scaling); fewer dimensions
than components give as many components; a component without variance (one row,
equal rows, fewer rows than components; up to 1e-12 of the largest eigenvalue) has whitened null
and does not count for the identity error, and where there is no variance at all explained
and the identity error are null; scaled components beyond 2 ** 40 either way count as that bound;
a deviation beyond 64 bits is null; null and repeated ids stay, and rows that repeat count each; an
empty table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.vector_codes import usable
from corpusloom.plans.session import cut

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Largest scaled component, either way, and share of the largest eigenvalue that counts as none.
MOST, NONE = 1 << 40, 1e-12


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension; shorter rows do not count where they end."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(0, dtype=object)
        for frame in frames:
            n += len(frame)
            for size, same in frame.groupby(frame["x"].map(len)):
                if size > len(total):
                    total = np.concatenate([total, np.zeros(size - len(total), dtype=object)])
                if size:
                    total[:size] += np.stack(same["x"].to_numpy()).astype(object if len(same) > 1 << 20 else np.int64).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(-1, len(total)), "s": [str(v) for v in (n, *total)]})

    added = rows.select("x").mapInPandas(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found = {r["at"]: int(r["s"]) for r in added.collect()}  # one row a dimension
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array column's rows, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row for each usable vector and component."""
    vector = rows[vector_col]
    bounded = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") + shift)
    good = rows.where(usable(vector)).select(rows[id_col].alias("vec_id"), bounded.alias("x"))
    n, sums = _sums(good)
    id_field = good.schema["vec_id"]
    result = T.StructType([id_field, *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    dims = len(sums)
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], result)
    lengths = good.where(F.size("x") < dims).limit(1).count()
    if lengths:  # zeros to the longest vector's length, which count in the sums too
        good = good.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x"))))
        _, sums = _sums(good)

    # (n * x - S) / n without leaving 64 bits: S = n * whole + rest
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    centre = F.zip_with(F.zip_with("x", F.array(*map(F.lit, whole)), lambda x, w: x - w), F.array(*[F.lit(r / n) for r in rest]), lambda x, r: x - r)
    gramian = _gramian(good.select(centre.alias("y")), "y")
    values, vectors = np.linalg.eigh(gramian / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    trace, kept = float(values.sum()), min(components, dims)
    used = values[:kept] > NONE * max(values[0], 0)
    shared = rows.sparkSession.sparkContext.broadcast((vectors[:, :kept] / np.sqrt(np.where(used, values[:kept], 1)), np.array(whole, dtype=np.int64), np.array(rest, dtype=object)))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes, whole, rest = shared.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy()).astype(np.int64) - whole
            y = x - (rest / n).astype(float)
            far = float(np.abs(x).max() + 1) * n
            if far * far * dims < 2**62:
                exact = n * x - rest.astype(np.int64)
                deviation = [int(d) for d in (exact * exact).sum(axis=1)]
            else:
                deviation = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in x]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": pd.array([d if d < 2**63 else None for d in deviation], dtype="Int64"), "w": list(y @ axes)})

    projected = cut(good.mapInPandas(project, T.StructType([id_field, *T.StructType.fromDDL("deviation long, w array<double>")])))
    mean = [projected.agg(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in range(kept)]).first()[k] for k in range(kept)]
    again = _gramian(projected.select(F.zip_with("w", F.array(*map(F.lit, mean)), lambda w, m: w - m).alias("z")), "z") / n
    there = np.flatnonzero(used)
    error = float(np.abs(again[np.ix_(there, there)] - np.eye(len(there))).max()) if len(there) else None
    about = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(bool(used[k])).alias("used"), F.lit(float(values[k]) / trace if trace else None).cast("double").alias("explained")) for k in range(kept)])
    each = projected.select("vec_id", "deviation", F.explode(F.arrays_zip(about.alias("about"), F.col("w"))).alias("c"))
    return each.select("vec_id", F.col("c.about.component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("c.about.used"), F.col("c.w")).alias("whitened"), F.col("c.about.explained"), F.lit(error).cast("double").alias("identity_error"))
