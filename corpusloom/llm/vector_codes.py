"""Product codes of vectors, learned by Lloyd rounds that only move what has changed.

Vectors become integers, floor(scale * x), and are cut into equal parts; every
part position has a codebook of its own, which starts as that part of the
vectors with the smallest ids. A round assigns every part to the nearest entry
and replaces each entry by the floored mean of its parts.

The rounds are delta-maintained: the table of vectors carries the assignments of
the round before, and the driver the running integer sums and counts of all
entries (parts x entries x width numbers, whatever the number of rows). A round
reads the table once and writes it with the new assignments; in the same pass
each task adds up, for the parts whose assignment has changed and for these
alone, plus their components for the new entry and minus them for the old one.
These sums, at most one row per entry of each task, are all that is shuffled.
Sums are integers, so they equal those of a full recount, and a round in which nothing
changes ends the learning, as all further rounds would be alike.

Every round's table lies in the shared checkpoint folder and replaces the one
before it, so a lost executor costs the tasks it had and no earlier round.

Defined cases: null vectors and those that hold null or non-finite components are dropped;
a null id sorts behind all others, and equal ids by their vectors; rows that repeat
count each; with fewer rows than entries there are as many entries as rows, and the
unused numbers never occur; vectors shorter than the longest, and the longest where the
parts do not divide it, are filled up with zeros; components of the scaled vectors beyond
2 ** 27 either way count as that bound, so that no sum of squares leaves 64 bits; null labels are
one group; an empty table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textblocks as tb
from corpusloom.plans.session import checkpoint_ready, remove, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component, either way.
MOST = 1 << 27
#: Vectors that are compared with the codebooks at once.
TILE = 4096


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within MOST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def _parts(batch: pa.RecordBatch, at: int, parts: int, width: int) -> np.ndarray:
    """(rows x parts x width) of a binary column of 32-bit integers."""
    data = pa.concat_arrays([batch.column(at)]).to_pylist()
    return np.frombuffer(b"".join(data), dtype="<i4").reshape(len(data), parts, width).astype(np.int64)


def nearest(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) number of the nearest entry, the first of equals, and its squared distance."""
    codes, errors = np.empty(x.shape[:2], dtype=np.uint8), np.empty(x.shape[:2], dtype=np.int64)
    for lo in range(0, len(x), TILE):
        for p, book in enumerate(books):
            part = x[lo : lo + TILE, p]
            far = np.stack([np.square(part - entry).sum(axis=1) for entry in book], axis=1)
            best = far.argmin(axis=1)
            codes[lo : lo + TILE, p], errors[lo : lo + TILE, p] = best, far[np.arange(len(part)), best]
    return codes, errors


class Codebooks:
    """Entries of all part positions with the sums and counts of their parts."""

    def __init__(self, first: np.ndarray):  # entries x parts x width
        self.books = [first[:, p].copy() for p in range(first.shape[1])]
        self.sums, self.counts = np.zeros(first.transpose(1, 0, 2).shape, dtype=object), np.zeros(first.shape[1::-1], dtype=object)

    def move(self, changes: list) -> None:
        """Adds the changes (part, entry, n, sums) and sets every used entry to its floored mean."""
        for part, entry, n, sums in changes:
            self.sums[part, entry] += np.array(sums, dtype=object)
            self.counts[part, entry] += n
        for p, book in enumerate(self.books):
            for k in range(len(book)):
                if self.counts[p, k]:
                    book[k] = self.sums[p, k] // self.counts[p, k]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def _first_books(good: DataFrame, parts: int, entries: int) -> tuple[Codebooks | None, int]:
    """The codebooks to begin with, and the width of a part."""
    longest = good.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None, 0
    width = max(1, -(-longest // parts))
    first = good.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    filled = np.zeros((len(first), parts * width), dtype=np.int64)
    for k, row in enumerate(first):
        filled[k, : len(row["x"])] = row["x"]
    return Codebooks(filled.reshape(len(first), parts, width)), width


def encode(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row. At most 256 entries."""
    spark = rows.sparkSession
    checkpoint_ready(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/codes-{uuid.uuid4().hex}"
    vector = rows[vector_col]
    good = rows.where(usable(vector)).select(rows[id_col].alias("id"), rows[label_col].alias("label"), integers(vector, scale).alias("x"))
    state, width = _first_books(good, parts, entries)
    if state is None:
        empty = rows.limit(0).select(rows[id_col].alias("vec_id"))
        return empty.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    books = spark.sparkContext.broadcast(state.books)

    @tb.lean
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, filled up with zeros; no part has an entry yet."""
        for b in batches:
            lists = b.column(2)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            full = np.zeros((b.num_rows, parts * width), dtype="<i4")
            full[np.repeat(np.arange(b.num_rows), cuts), np.concatenate([np.arange(0), *(np.arange(n) for n in cuts)])] = flat
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in full], pa.binary()), pa.nulls(b.num_rows, pa.binary())], ["id", "label", "x", "codes"])

    def schema(more: str) -> T.StructType:
        return T.StructType([*good.select("id", "label").schema.fields, *T.StructType.fromDDL(more).fields])

    vectors = schema("x binary, codes binary")
    steps = schema("x binary, codes binary, part int, entry int, n long, sums array<long>, kind string")
    good.mapInArrow(begin, vectors).write.parquet(f"{base}/0/kind=vector")

    def round_of(books, size: int):
        @tb.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The vectors with their new entries, and behind them the task's changes of sums."""
            sums, counts = np.zeros((parts, size, width), dtype=np.int64), np.zeros((parts, size), dtype=np.int64)
            names, given = steps.names, None
            for b in batches:
                given = b.schema
                x = _parts(b, 2, parts, width)
                codes, _ = nearest(x, books.value)
                before = b.column(3)
                fresh = before.null_count == len(before)
                old = np.zeros_like(codes) if fresh else np.frombuffer(b"".join(before.to_pylist()), dtype=np.uint8).reshape(codes.shape)
                for p in range(parts):
                    moved = np.ones(len(x), dtype=bool) if fresh else codes[:, p] != old[:, p]
                    np.add.at(sums[p], codes[moved, p], x[moved, p])
                    np.add.at(counts[p], codes[moved, p], 1)
                    if not fresh:
                        np.subtract.at(sums[p], old[moved, p], x[moved, p])
                        np.subtract.at(counts[p], old[moved, p], 1)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(["vector"] * n, pa.string())], names)
            touched = np.argwhere((counts != 0) | (sums != 0).any(axis=2))
            if len(touched):
                n = len(touched)
                kinds = pa.array(["change"] * n, pa.string())
                lists = pa.array([sums[p, k].tolist() for p, k in touched], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, given.field(0).type), pa.nulls(n, given.field(1).type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(touched[:, 0], pa.int32()), pa.array(touched[:, 1], pa.int32()), pa.array(counts[tuple(touched.T)]), lists, kinds], names)

        return run

    done = 0
    for done in range(1, rounds + 1):
        held = spark.read.schema(vectors).parquet(f"{base}/{done - 1}/kind=vector")
        held.mapInArrow(round_of(books, len(state.books[0])), steps).write.partitionBy("kind").parquet(f"{base}/{done}")
        remove(spark, f"{base}/{done - 1}")
        changes = spark.read.schema(steps).parquet(f"{base}/{done}").where(F.col("kind") == "change").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        # at most parts x entries x width sums
        added = changes.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = added.groupBy("part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums")).collect()
        if not moved:
            break
        state.move([(r["part"], r["entry"], r["n"], [s["s"] for s in r["sums"]]) for r in moved])
        books = spark.sparkContext.broadcast([b.copy() for b in state.books])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = nearest(_parts(b, 2, parts, width), books.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors.sum(axis=1))], ["id", "label", "code", "error"])

    coded = spark.read.schema(vectors).parquet(f"{base}/{done}/kind=vector").mapInArrow(tb.lean(finish), schema("code string, error long"))
    coded.write.parquet(f"{base}/coded")
    remove(spark, f"{base}/{done}")
    coded = spark.read.schema(coded.schema).parquet(f"{base}/coded")
    by_label = small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(state.sha256()).alias("codebooks_sha256"))
