"""Near-duplicate classes by MinHash.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set has its
distinct shingles of ``SHINGLE`` words (a shorter text is one shingle, a text
without words has the empty set and is linked with nothing). Two texts are
linked when 100 * intersection >= 75 * union.

1. One pass hashes all shingles, puts the least hash of each of BANDS * ROWS
   bins into the signature (one permutation), fills empty bins by optimal
   densification, and hashes the signature's bands.
2. Equal sets are one class at once (fingerprint of the whole set); only one
   representative of each set goes on.
3. Representatives that share a band's hash share a bucket. Each bucket gives a
   star: an edge from every member to the least one, so n members give n - 1
   candidates. Candidates are confirmed on the full sets, and the classes so far
   are connected components of confirmed links.
4. A star may miss a link between two members that are not alike with the least
   one. The members of buckets that still hold several classes are finished
   exactly: two linked texts share one of their rarest shingles (prefix filter),
   and those that share too few with any other text are out. What is left gets a
   second star around the member that shares most. Then, for each rare shingle,
   members outside the commonest class are compared with all members, in blocks
   of bounded size that give links, not pairs.

A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 40
= 2.5e-7. No bucket is capped. Results do not depend on partitioning.

Defined cases: null text has no words; rows with a null id get null as class and
are not linked; rows that repeat an id count as one document for links; an empty
table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm import textblocks as tb
from corpusloom.operators.components import connected_components
from corpusloom.plans.session import checkpoint_ready, cut

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
#: Texts of one block of outsiders and of one slice that it is compared with.
OUTSIDERS, OTHERS = 256, 2048
_U = np.uint64

_BINS = BANDS * ROWS
_PROBE = np.random.default_rng(17).integers(0, _BINS, (4096, _BINS))
_SEED = tb.mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0xA0761D6478BD642F))


def sets_of(block: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    block = tb.LOWER[block]
    starts, ends, first = tb.words(block, offsets)
    h = tb.hashes(block, starts, ends) if len(starts) else np.zeros(0, _U)
    long = tb.roll(h, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            x = np.sort(long[a : b - SHINGLE + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield tb.roll(h[a:b], b - a)
        else:
            yield h[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures with optimal densification, one row for each nonempty set."""
    out = np.zeros((len(sets), _BINS), dtype=_U)
    full = np.zeros((len(sets), _BINS), dtype=bool)
    for k, x in enumerate(sets):
        bins = ((x >> _U(32)) * _U(_BINS)) >> _U(32)
        at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        out[k, bins[at].astype(np.int64)] = x[at]
        full[k, bins[at].astype(np.int64)] = True
    rows, cols = np.nonzero(~full)
    attempt = 0
    while len(rows):  # each bin has its own fixed order of bins to borrow from
        source = _PROBE[attempt % len(_PROBE), (cols + attempt // len(_PROBE)) % _BINS]
        found = full[rows, source]
        out[rows[found], cols[found]] = out[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
        attempt += 1
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(_SEED, (len(signature), BANDS)).copy()
    for r in range(ROWS):
        out = tb.mix(out * _U(0x2545F4914F6CDD1D) + signature[:, r::ROWS])
    return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(id, text) to id, n, fingerprint of the set, bands (null for empty sets)."""

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tb.column(b.column(1))
            for lo, hi, block, at in tb.blocks(data, offsets):
                sets = list(sets_of(block, at))
                some = [k for k, x in enumerate(sets) if len(x)]
                bands = band_hashes(signatures([sets[k] for k in some])).reshape(-1)
                sizes = np.zeros(len(sets), dtype=np.int64)
                sizes[some] = BANDS
                cuts = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum(sizes, out=cuts[1:])
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands))], ["id", "n", "print", "bands"])

    return docs.mapInArrow(run, "id long, n long, print binary, bands array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (x, y) whose full sets are alike enough. texts: (id, text)."""

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for b in batches:
            xs, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            data, offsets = tb.column(b.column(2))
            other, cuts = tb.column(b.column(3))
            x_sets = (s for _, _, block, at in tb.blocks(data, offsets) for s in sets_of(block, at))
            for k, s in enumerate(x_sets):
                if ys[k] != last_id:
                    last_id = ys[k]
                    last_set = next(sets_of(other[cuts[k] : cuts[k + 1]], np.array([0, cuts[k + 1] - cuts[k]])))
                both = len(np.intersect1d(s, last_set, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(last_set) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([xs[k] for k in keep], pa.int64()), pa.array([ys[k] for k in keep], pa.int64())], ["x", "y"])

    left = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
    both = left.join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")
    return both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def _labelled(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Bucket members with their classes so far."""
    named = classes.select(F.col("node").alias("id"), F.col("component").alias("class"))
    return buckets.join(named, "id", "left").withColumn("class", F.coalesce("class", "id"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Keys of the buckets with several classes."""
    return labelled.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")


def _stars(buckets: DataFrame, first: Column) -> DataFrame:
    """Each member of a bucket beside the bucket's least one by `first`: other, m (and other_class, g)."""
    centre = buckets.groupBy("key").agg(F.min(first).alias("c"))
    named = {"id": "other", "n": "m", "class": "other_class", "g": "g"}
    joined = buckets.join(centre, "key").where("id <> c.id")
    inside = [f for f in joined.schema["c"].dataType.names if f in named]
    return joined.select(*buckets.columns, *[F.col(f"c.{f}").alias(named[f]) for f in inside])


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("id", "other").alias("x"), F.least("id", "other").alias("y")).distinct()


def _rare_shingles(texts: DataFrame) -> DataFrame:
    """id, n, f and key: the shingles by which a text can still be found.

    f is how many of a text's n shingles another of the texts has too. With all
    shingles ordered from rare to common, two linked texts have one in common
    among the first n - ceil(0.75 n) + 1 of each. Those that no other text has
    come first and find nothing, so a text with more than a quarter of them is out.
    """

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = tb.column(b.column(1))
            for lo, hi, block, at in tb.blocks(data, offsets):
                sets = list(sets_of(block, at))
                sizes = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], sizes), pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "key"])

    each = texts.select("id", "text").mapInArrow(run, "id long, n long, key long")
    common = each.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    by_text = W.partitionBy("id")
    shared = each.join(common, "key").withColumn("f", F.count("*").over(by_text)).withColumn("place", F.row_number().over(by_text.orderBy("k", "key")))
    first = F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1")
    return shared.where(F.col("n") - F.col("f") + F.col("place") <= first).select("id", "n", "f", "key")


def _outsiders(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the members outside the commonest class of each key, to any member with the same key.

    Outsiders near the same class are put in blocks; a block is compared with all
    texts that share a key with one of it, in slices, on the full sets.
    """
    common = members.groupBy("key", "class").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "class")).alias("most"))
    outside = members.join(common, "key").where("class <> most.class").select("key", "id", F.col("most.k").alias("k"), F.col("most.class").alias("hub"))
    hubs = outside.groupBy("id").agg(F.max(F.struct("k", "hub")).alias("h")).select("id", F.col("h.hub").alias("hub"))
    many = hubs.groupBy("hub").agg(F.ceil(F.count("*") / OUTSIDERS).alias("parts"))
    blocks = cut(hubs.join(many, "hub").select("id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))
    asked = outside.select("key", "id").join(blocks, "id").select("key", "block").distinct()
    others = cut(members.select("key", "id").join(asked, "key").select("block", "id").distinct())
    slices = others.groupBy("block").agg(F.ceil(F.count("*") / OTHERS).alias("slices"))
    left = blocks.join(texts, "id").join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    right = others.join(texts, "id").join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))

    def compare(few: pa.Table, many: pa.Table) -> pa.Table:
        xs, ys = [], []
        if few.num_rows and many.num_rows:
            ids, sizes, parts = few.column("id").to_numpy(), [], []
            data, offsets = tb.column(few.column("text"))
            for _, _, block, at in tb.blocks(data, offsets):
                for x in sets_of(block, at):
                    sizes.append(len(x))
                    parts.append(x)
            owner, held = np.repeat(np.arange(len(ids)), sizes), np.concatenate(parts)
            order = np.argsort(held, kind="stable")
            owner, held, size = owner[order], held[order], np.array(sizes)
            names = many.column("id").to_numpy()
            data, offsets = tb.column(many.column("text"))
            for lo, _, block, at in tb.blocks(data, offsets):
                for k, y in enumerate(sets_of(block, at)):
                    first, end = np.searchsorted(held, y), np.searchsorted(held, y, "right")
                    n = end - first
                    at_ = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    both = np.bincount(owner[at_], minlength=len(ids))
                    hit = ids[(100 * both >= PERCENT * (size + len(y) - both)) & (ids != names[lo + k])]
                    xs.append(hit)
                    ys.append(np.full(len(hit), names[lo + k]))
        x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (xs, ys))
        return pa.table({"x": np.maximum(x, y), "y": np.minimum(x, y)})

    fresh = [F.col(c).alias(c) for c in ("block", "slice", "id", "text")]  # both sides come from the same tables
    pair = left.select(*fresh).groupBy("block", "slice").cogroup(right.select(*fresh).groupBy("block", "slice"))
    return pair.applyInArrow(compare, "x long, y long").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, class of each representative that is not alone)."""
    spark = docs.sparkSession
    checkpoint_ready(spark)
    tb.small_batches(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sketches = cut(sketch(rows))
    one = sketches.where(F.col("id").isNotNull() & F.col("bands").isNotNull()).groupBy("print").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    exploded = one.select("id", "n", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    buckets = cut(exploded.join(shared, "key"))

    wanted = buckets.select("id").distinct()
    store = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/near-{uuid.uuid4().hex}"
    texts = rows.join(wanted, "id")
    texts.write.parquet(store)
    texts = spark.read.schema("id long, text string").parquet(store)

    fits = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    pairs = _pairs(_stars(buckets, F.struct("id", "n")).where(fits))
    pairs = cut(pairs)
    confirmed = cut(_confirm(pairs, texts))
    classes = connected_components(confirmed, "x", "y")

    # what is left: buckets with several classes, and of these the rows that can have a link at all
    mixed = _mixed(_labelled(buckets, classes))
    open_ = cut(buckets.join(mixed, "key", "left_semi"))
    rare = cut(_rare_shingles(texts.join(open_.select("id").distinct(), "id", "left_semi")))
    able = rare.groupBy("id").agg(F.first("f").alias("f"))
    open_ = open_.join(able, "id")
    enough = 100 * F.least("f", "g") >= PERCENT * (F.col("n") + F.col("m") - F.least("f", "g"))
    best = F.struct((-F.col("f") / F.col("n")).alias("u"), "id", "n", "class", F.col("f").alias("g"))
    found = _stars(_labelled(open_, classes), best).where((F.col("class") != F.col("other_class")) & enough)
    new = _pairs(found).join(pairs, ["x", "y"], "left_anti")
    confirmed = cut(confirmed.unionByName(_confirm(new, texts)))
    classes = connected_components(confirmed, "x", "y")

    rest = _labelled(rare, classes)
    rest = cut(rest.join(_mixed(rest), "key", "left_semi"))
    confirmed = confirmed.unionByName(_outsiders(rest, texts))
    classes = connected_components(confirmed, "x", "y")
    _delete(spark, store)
    return sketches, classes


def _delete(spark, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketches, classes = links(docs, id_col, text_col)
    same = sketches.where(F.col("id").isNotNull() & F.col("bands").isNotNull()).groupBy("print").agg(F.min("id").alias("rep"))
    named = same.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.join(named, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class; rows with a null id stay."""
    gone = classify(docs, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    key = plain[f"c{docs.columns.index(id_col)}"]
    return plain.join(gone, key == gone["doc_id"], "left_anti").toDF(*docs.columns)
