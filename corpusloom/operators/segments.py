"""A search index kept in segments, with upper bounds of blocks of postings.

Files: a segment has its documents (``forward``: doc, hash, lengths and terms) and
its postings in blocks: one row holds what a term has in one block of BLOCK
documents, with the largest weight that any of them can give (``peaks``, by field).
Documents that share rare terms are put into the same blocks: their rows, with
all terms packed, are shuffled once, and the task that reads a range of them makes
its blocks, so postings are not shuffled. A change of the
documents writes one new segment and a table of the documents that are gone from
earlier ones; earlier segments stay as they are. Document frequencies are the
sums over segments without those of the gone. When there are FAN segments of
about one size, they are merged into one, and no other is touched. MANIFEST says
what counts; it is replaced at once, so readers see the state before or after.

``topk`` reads the postings of the queries' terms, brings a document's together and
scores it for all queries in one task, which gives on only the best. For more
queries than a task can hold, and for all scores, ``plan`` reads postings only
where they can matter, at the price of a row for each query, term and block:

1. Bounds of all blocks that have a query's term are read, without their postings.
2. The blocks with the largest sums of bounds are scored whole; the k-th best
   score found is one that the k-th best of all documents reaches at least.
3. A query's terms with the smallest bounds, which together stay below that
   score, cannot bring a document among the k best by themselves. Postings of
   the other terms are read, in blocks whose sum of bounds reaches the score.
4. Documents whose score so far and bounds of the rest reach it are scored whole.

So either way the result is that of a search over all postings.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.functions.text import term_counts
from corpusloom.operators import search
from corpusloom.plans.session import cut, remove, small
from corpusloom.sources import files

VERSION = 4
#: Documents of a block, blocks of a query that are scored first, and segments of one size that are merged.
BLOCK, FIRST_BLOCKS, FAN = 4, 32, 4
#: Scores are compared with this much room for rounding.
_ROOM = 1e-9


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        found = json.loads(files.read_text(spark, f"{path}/MANIFEST") or "{}")
    except json.JSONDecodeError:
        return None
    return found if found.get("version") == VERSION else None


def _counter(n_fields: int):
    """Batches of doc, hash and the fields' texts: doc, hash, lengths, near, terms with blanks between, and their counts by field, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in search.pieces(batch, list(range(2, 2 + n_fields)))):
            n, made = b.num_rows, [term_counts(b.column(2 + f)) for f in range(n_fields)]
            words = pa.chunked_array([m[4] for m in made]).combine_chunks().dictionary_encode()
            of_field = np.split(words.indices.to_numpy(zero_copy_only=False), np.cumsum([len(m[4]) for m in made])[:-1])
            keys = [m[1] * len(words.dictionary) + number[m[2]] for m, number in zip(made, of_field)]
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.zeros((len(key), n_fields), np.int32)
            tf[at, np.repeat(np.arange(n_fields), [len(k) for k in keys])] = np.concatenate([m[3] for m in made])
            doc, term = key // max(1, len(words.dictionary)), key % max(1, len(words.dictionary))
            near, there = np.zeros(n, np.int64), np.isin(np.arange(n), doc)
            if len(doc):
                hashes = pd.util.hash_array(np.array(words.dictionary.to_pylist(), dtype=object)).view(np.int64)
                near[there] = np.minimum.reduceat(hashes[term], np.flatnonzero(np.append(True, doc[1:] != doc[:-1])))
            lengths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_fields), pa.array(np.stack([m[0] for m in made], axis=1).ravel().astype(np.int32)))
            packed = search.packed(np.repeat(doc, n_fields), n, tf.ravel())
            text = pc.binary_join(search.lists(doc, n, words.dictionary.take(pa.array(term))), " ")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lengths, pa.array(near, mask=~there), text, packed], ["doc", "hash", "lengths", "near", "terms", "tf"])

    return run


def _forward(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """doc, hash, lengths (by field), near (documents with equal numbers share a term), terms, tf (by term and field), made where the texts lie. Ids are unique."""
    texts = [F.coalesce(t.cast("string"), F.lit("")) for t in fields.values()]
    base = docs.select(docs[id_col].alias("doc"), F.sha2(F.concat_ws("\x1f", *texts), 256).alias("hash"), *[t.alias(f"t{k}") for k, t in enumerate(texts)])
    numbers = T.ArrayType(T.IntegerType())
    shape = T.StructType([base.schema["doc"], T.StructField("hash", T.StringType()), T.StructField("lengths", numbers), T.StructField("near", T.LongType()), T.StructField("terms", T.StringType()), T.StructField("tf", T.BinaryType())])
    return base.mapInArrow(_counter(len(texts)), shape)


def _poster(weights: list[float], means: list[float]):
    """Batches of doc, lengths and packed terms in order of near: postings in blocks, one row for what a term has in a block. No block goes over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_fields, made = len(weights), TaskContext.get().partitionId() << 32
        for b in (piece for batch in batches for piece in search.pieces(batch, [2, 3])):
            n = (pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False) // (4 * n_fields)).astype(np.int64)
            at = np.repeat(np.arange(b.num_rows), n)
            words = pc.split_pattern(b.column(2).filter(pa.array(n > 0)), " ").flatten().dictionary_encode()
            tf = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32).reshape(-1, n_fields)
            lengths = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_fields)
            size = max(1, len(words.dictionary))
            key = at // BLOCK * size + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            key, tf, at = key[order], tf[order], at[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            if len(first):
                weight = np.array(weights) * tf / ((1 - search.B) + search.B * lengths[at] / np.array(means))
                peaks = np.maximum.reduceat(weight, first, axis=0)
                ends = np.append(first, len(key))
                inner = pa.array(np.arange(len(key) + 1, dtype=np.int32) * n_fields)
                entries = pa.StructArray.from_arrays([b.column(0).take(pa.array(at)), pa.ListArray.from_arrays(inner, pa.array(lengths[at].ravel())), pa.ListArray.from_arrays(inner, pa.array(tf.ravel()))], ["doc", "lengths", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [words.dictionary.take(pa.array(key[first] % size)), pa.array(made + key[first] // size), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * n_fields), pa.array(peaks.ravel())), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)],
                    ["term", "block", "n", "peaks", "entries"],
                )
            made += -(-b.num_rows // BLOCK)

    return run


def _sums(rows: DataFrame, n_fields: int) -> tuple[int, list[int]]:
    row = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("lengths")[k]).alias(f"s{k}") for k in range(n_fields)]).first()
    return row["n"], [int(row[f"s{k}"] or 0) for k in range(n_fields)]


def _means(n: int, sums: list[int]) -> list[float]:
    """A mean of 0 counts as 1, as in the search over texts."""
    return [s / n if n and s else 1.0 for s in sums]


def _weight(tf: Column, length: Column, weight: float, mean: Column | float) -> Column:
    return weight * tf / ((1 - search.B) + search.B * length / mean)


def _write(forward: DataFrame, path: str, number: int, weights: list[float]) -> dict:
    """Writes a segment; gives its entry of the manifest."""
    spark, name = forward.sparkSession, f"segment-{number}-{uuid.uuid4().hex[:8]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = forward.repartitionByRange(parts, "near", "doc").sortWithinPartitions("near", "doc")
    ranged.select("doc", "hash", "lengths", "near", "terms", "tf", F.lit(number).alias("segment")).write.parquet(f"{path}/{name}/forward")
    rows = spark.read.parquet(f"{path}/{name}/forward")
    n, sums = _sums(rows, len(weights))
    means = _means(n, sums)
    doc, numbers = rows.schema["doc"].dataType, T.ArrayType(T.IntegerType())
    entry = T.StructType([T.StructField("doc", doc), T.StructField("lengths", numbers), T.StructField("tf", numbers)])
    shape = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("peaks", T.ArrayType(T.DoubleType())), T.StructField("entries", T.ArrayType(entry))])
    posted = rows.select("doc", "lengths", "terms", "tf").mapInArrow(_poster(weights, means), shape)
    posted.withColumn("segment", F.lit(number)).write.parquet(f"{path}/{name}/postings")
    return {"segment": number, "name": name, "documents": n, "lengths": sums, "means": means, "gone": 0, "gone_lengths": [0] * len(weights)}


def _read(spark: SparkSession, path: str, manifest: dict, what: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{s['name']}/{what}" for s in manifest["segments"]])


def _gone(spark: SparkSession, path: str, manifest: dict) -> DataFrame | None:
    """segment, doc, lengths, terms of the documents that segments hold and the index does not; None without any."""
    if not any(s["gone"] for s in manifest["segments"]):
        return None
    present = [s["segment"] for s in manifest["segments"]]
    return spark.read.parquet(*[f"{path}/{name}" for name in manifest["gone"]]).where(F.col("segment").isin(present))


def _live(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    rows, gone = _read(spark, path, manifest, "forward"), _gone(spark, path, manifest)
    return rows if gone is None else rows.join(small(gone.select("segment", "doc")), ["segment", "doc"], "left_anti")


def _save(spark: SparkSession, path: str, manifest: dict) -> None:
    files.write_text(spark, f"{path}/MANIFEST", json.dumps(manifest, sort_keys=True))


def refresh(docs: DataFrame, id_col: str, fields: dict[str, Column], path: str, digest: str = "", weights: dict[str, float] = search.FIELD_WEIGHTS) -> dict:
    """Makes the index that of docs: built anew where there is none, otherwise by a segment of what is new or changed.

    Gives the numbers of documents added, changed and removed. digest: of the content that the index is made from.
    """
    spark = docs.sparkSession
    manifest, by_field = _manifest(spark, path), [weights[f] for f in fields]
    forward = _forward(docs, id_col, fields)
    if manifest is None or manifest["weights"] != by_field or not manifest["segments"]:
        entry = _write(forward, path, 0, by_field)
        _save(spark, path, {"version": VERSION, "digest": digest, "weights": by_field, "next": 1, "segments": [entry] if entry["documents"] else [], "gone": []})
        return {"added": entry["documents"], "changed": 0, "removed": 0}
    forward = cut(forward)
    live = _live(spark, path, manifest).select("segment", "doc", F.col("hash").alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old"), "changed")
    changes = cut(live.join(forward.select("doc", "hash"), "doc", "full_outer").withColumn("status", status).where("status is not null").select("segment", "doc", "status"))
    counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts:
        old = changes.where("segment is not null")
        if not old.isEmpty():
            name = f"gone-{uuid.uuid4().hex[:8]}"
            _read(spark, path, manifest, "forward").join(old.select("segment", "doc"), ["segment", "doc"], "left_semi").select("segment", "doc", "lengths", "terms").write.parquet(f"{path}/{name}")
            gone = spark.read.parquet(f"{path}/{name}")
            of = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("lengths")[k]) for k in range(len(by_field))]).alias("s")).collect()}  # a row a segment
            for s in manifest["segments"]:
                if s["segment"] in of:
                    s["gone"] += of[s["segment"]]["n"]
                    s["gone_lengths"] = [a + int(b) for a, b in zip(s["gone_lengths"], of[s["segment"]]["s"])]
            manifest["gone"].append(name)
        new = changes.where("status <> 'removed'").select("doc")
        if counts.get("added") or counts.get("changed"):
            manifest["segments"].append(_write(forward.join(new, "doc", "left_semi"), path, manifest["next"], by_field))
            manifest["next"] += 1
        manifest["segments"] = [s for s in manifest["segments"] if s["documents"] > s["gone"]]
    manifest["digest"] = digest
    _save(spark, path, manifest)
    if counts:
        compact(spark, path)
    return {k: counts.get(k, 0) for k in ("added", "changed", "removed")}


def compact(spark: SparkSession, path: str, fan: int = FAN) -> list[str]:
    """Merges segments while there are ``fan`` of about one size (of one power of ``fan`` documents); gives the names of the merged ones."""
    merged: list[str] = []
    while True:
        manifest = _manifest(spark, path)
        sizes: dict[int, list[dict]] = {}
        for s in manifest["segments"]:
            sizes.setdefault(int(math.log(max(1, s["documents"] - s["gone"]), fan) + 1e-9), []).append(s)
        full = next((group for _, group in sorted(sizes.items()) if len(group) >= fan), None)
        if full is None:
            return merged
        rows = _live(spark, path, manifest).where(F.col("segment").isin([s["segment"] for s in full])).select("doc", "hash", "lengths", "near", "terms", "tf")
        entry = _write(rows, path, manifest["next"], manifest["weights"])
        manifest["segments"] = [s for s in manifest["segments"] if s not in full] + [entry]
        manifest["next"] += 1
        _save(spark, path, manifest)
        merged += [s["name"] for s in full]


def clean(spark: SparkSession, path: str) -> None:
    """Deletes what the manifest does not name any more; for when no reader of an earlier state is left."""
    manifest = _manifest(spark, path)
    kept = {s["name"] for s in manifest["segments"]} | set(manifest["gone"])
    place, fs = files._place(spark, path)
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(("segment-", "gone-")) and name not in kept:
            remove(spark, f"{path}/{name}")


def usable(spark: SparkSession, path: str, digest: str) -> bool:
    """Whether there is an index of this version and content."""
    manifest = _manifest(spark, path)
    return manifest is not None and manifest["digest"] == digest


@dataclass
class Reading:
    """What a search reads. bounds: query_id, term, segment, block, weight, bound, n; the others are its rows in order of the steps."""

    bounds: DataFrame
    first: DataFrame
    essential: DataFrame
    rest: DataFrame
    scores: DataFrame

    def read(self) -> DataFrame:
        """One row: entries of blocks that are read at least once for a query, and those that a search over all postings reads."""
        keys = ["query_id", "term", "segment", "block", "n"]
        taken = self.first.select(*keys).unionByName(self.essential.select(*keys)).unionByName(self.rest.select(*keys)).distinct()
        return taken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read")).join(F.broadcast(self.bounds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))))  # one row each


def frequencies(spark: SparkSession, path: str, among: DataFrame) -> DataFrame:
    """term, df of the terms in ``among``: sums over segments without the documents that are gone."""
    manifest = _manifest(spark, path)
    wanted = small(among.select("term").distinct())
    held = _read(spark, path, manifest, "postings").select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    gone = _gone(spark, path, manifest)
    if gone is not None:
        less = gone.select(F.explode(F.split("terms", " ")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("less"))
        held = held.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
    return held.where("df > 0")


def plan(spark: SparkSession, path: str, asked: DataFrame, k: int) -> Reading | None:
    """The search for the k best documents of each query. asked: query_id, term, times. None if the index is empty."""
    manifest = _manifest(spark, path)
    if manifest is None or not manifest["segments"]:
        return None
    weights, segments = manifest["weights"], manifest["segments"]
    n = sum(s["documents"] - s["gone"] for s in segments)
    means = _means(n, [sum(s["lengths"][f] - s["gone_lengths"][f] for s in segments) for f in range(len(weights))])
    postings, gone = _read(spark, path, manifest, "postings"), _gone(spark, path, manifest)
    gone = None if gone is None else small(gone.select("segment", "doc"))
    idf = search.inverse_frequency(F.col("df"), F.lit(n))
    wanted = cut(asked.join(frequencies(spark, path, asked), "term").select("query_id", "term", (F.col("times") * idf).alias("weight")))
    # a weight grows with the mean length by no more than the mean does
    scales = F.create_map(*[x for s in segments for x in (F.lit(s["segment"]), F.array(*[F.lit(max(1.0, m / m0)) for m, m0 in zip(means, s["means"])]))])
    peak = F.aggregate(F.zip_with("peaks", scales[F.col("segment")], lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
    bound = F.col("weight") * peak / (search.K1 + peak)
    posted = postings.join(small(wanted.select("term").distinct()), "term", "left_semi")  # before anything is shuffled
    hits = posted.select("term", "segment", "block", "n", "peaks").join(small(wanted), "term")
    bounds = cut(hits.select("query_id", "term", "segment", "block", "weight", (bound * (1 + _ROOM)).alias("bound"), "n"))
    at, key = ["segment", "block"], ["query_id", "segment", "block"]

    def entries(rows: DataFrame) -> DataFrame:
        """query_id, segment, block, doc, term, part of the score of all postings in the rows' blocks."""
        met = posted.select("term", "segment", "block", "entries").join(rows.select("query_id", "term", "segment", "block", "weight"), ["term", *at])
        e = met.select("query_id", "term", "weight", *at, F.explode("entries").alias("e")).select("query_id", "term", "weight", *at, "e.*")
        if gone is not None:
            e = e.join(gone, ["segment", "doc"], "left_anti")
        v = sum((_weight(F.col("tf")[f], F.col("lengths")[f], w, means[f]) for f, w in enumerate(weights)), F.lit(0.0))
        return e.withColumn("v", v).select(*key, "doc", (F.col("weight") * F.col("v") / (search.K1 + F.col("v"))).alias("part"))

    summed = cut(bounds.groupBy(*key).agg(F.sum("bound").alias("most")))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), *at))
    first_blocks = summed.withColumn("place", best).where(F.col("place") <= FIRST_BLOCKS).select(*key)
    first = bounds.join(first_blocks, key)
    seen = entries(first).groupBy(*key, "doc").agg(F.sum("part").alias("score"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    least = cut(seen.withColumn("place", order).where(F.col("place") == k).select("query_id", (F.col("score") * (1 - _ROOM) - _ROOM).alias("least")))
    floor = F.coalesce("least", F.lit(0.0))
    # terms by their largest bounds, smallest first; those that stay below the floor together are not essential
    of_term = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("top")).join(least, "query_id", "left")
    upto = F.sum("top").over(W.partitionBy("query_id").orderBy("top", "term"))
    marked = of_term.withColumn("essential", upto >= floor).select("query_id", "term", "essential", floor.alias("floor"))
    reach = summed.join(least, "query_id", "left").where(F.col("most") >= floor).select(*key)
    alive = cut(bounds.join(reach, key).join(marked, ["query_id", "term"]))
    essential, others = alive.where("essential"), alive.where("not essential")
    rest_bounds = others.groupBy(*key).agg(F.sum("bound").alias("more"))
    part = entries(essential).groupBy(*key, "doc").agg(F.sum("part").alias("score"))
    floors = marked.select("query_id", "floor").distinct()
    kept = part.join(rest_bounds, key, "left").join(floors, "query_id").where(F.col("score") * (1 + _ROOM) + F.coalesce("more", F.lit(0.0)) >= F.col("floor"))
    kept = cut(kept.select(*key, "doc", "score"))
    rest = others.join(kept.select(*key).distinct(), key)
    added = entries(rest).join(kept.select(*key, "doc"), [*key, "doc"], "left_semi").groupBy(*key, "doc").agg(F.sum("part").alias("added"))
    scores = kept.join(added, [*key, "doc"], "left").select("query_id", "doc", (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score")).where("score > 0")
    return Reading(bounds, first, essential, rest, scores)


def _few_topk(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame | None:
    """topk of queries that are few enough for a task to hold; None for others, or if the index is empty.

    What is shuffled is a row for each document that has a query's term, whatever the number of queries.
    """
    manifest, known = _manifest(spark, path), {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    if manifest is None or not manifest["segments"]:
        return None
    postings, gone = _read(spark, path, manifest, "postings"), _gone(spark, path, manifest)
    kinds = [asked.schema["query_id"].dataType, postings.select("entries.doc").schema["doc"].dataType.elementType]
    few = search._few(asked) if all(kind in known for kind in kinds) else None
    if few is None:
        return None
    ids, vocabulary, times = few
    n, weights = sum(s["documents"] - s["gone"] for s in manifest["segments"]), manifest["weights"]
    means = _means(n, [sum(s["lengths"][f] - s["gone_lengths"][f] for s in manifest["segments"]) for f in range(len(weights))])
    number, df = spark.createDataFrame(list(enumerate(vocabulary)), "t int, term string"), np.zeros(len(vocabulary))
    for r in frequencies(spark, path, asked).join(F.broadcast(number), "term").collect():  # one row for each asked term
        df[r["t"]] = r["df"]
    e = postings.join(F.broadcast(number), "term").select("segment", "t", F.explode("entries").alias("e")).select("segment", "t", "e.*")
    if gone is not None:
        e = e.join(small(gone.select("segment", "doc")), ["segment", "doc"], "left_anti")
    v = sum((_weight(F.col("tf")[f], F.col("lengths")[f], w, means[f]) for f, w in enumerate(weights)), F.lit(0.0))
    vectors = e.select("doc", F.struct("t", v.alias("v")).alias("p")).groupBy("doc").agg(F.collect_list("p").alias("p"))
    rows = vectors.select("doc", F.lit(0).cast("long").alias("n0"), F.col("p.t").alias("t0"), F.col("p.v").alias("c0"))
    shape = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("doc", kinds[1]), T.StructField("score", T.DoubleType())])
    part = lambda counts, lengths: counts[0] / (search.K1 + counts[0])
    scorer = search._scorer(part, times * search._idf(n, df)[:, None], ids, 1, k, [known[kind] for kind in kinds], False)
    return search.best(rows.mapInArrow(scorer, shape), k)


def topk(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame:
    """query_id, doc, score, rank: the k best documents of each query, as the search over texts ranks them."""
    found = _few_topk(spark, path, asked, k)
    if found is not None:
        return found
    found = plan(spark, path, asked, k)
    if found is None:
        return search.best(asked.limit(0).select("query_id", F.lit("").alias("doc"), F.lit(0.0).alias("score")), k)
    return search.best(found.scores, k)


def scores(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame | None:
    """query_id, doc, score of all matching documents; None if the index is empty."""
    found = plan(spark, path, asked, 1 << 62)  # no document is the last of so many, so none is left out
    return None if found is None else found.scores
