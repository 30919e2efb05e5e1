"""Full-text ranking: term statistics, BM25, field-weighted BM25F, TF-IDF cosine.

Every function is batched over queries: query rows carry ``query_id``, and all
queries of a batch run in one plan. Postings are joined by term; only what has a
query's term is ever scored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.functions.text import term_counts, terms
from corpusloom.plans.session import cut, small

#: Saturation, length normalisation, weights of fields, and the cut of entry points.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"name": 3.0, "doc": 2.0, "body": 1.0}
ENTRY_SHARE, MOST_ENTRIES = 0.5, 4


def term_frequency(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """doc, term, tf."""
    exploded = docs.select(docs[id_col].alias("doc"), F.explode(terms(text)).alias("term"))
    return exploded.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_frequency(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf; n counts all documents, also those without terms."""
    n = docs.agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", inverse_frequency(F.col("df"), F.col("n_docs")).alias("idf"))  # one row


def query_terms(queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    """query_id, term, times."""
    exploded = queries.select(queries[id_col].alias("query_id"), F.explode(terms(text)).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def best(scores: DataFrame, k: int | None, by: str = "query_id", item: str = "doc", score: str = "score") -> DataFrame:
    """Ranks scores within a query, ties to the smaller document; scores are compared to nine digits."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round(score, 9)), item))
    ranked = scores.withColumn("rank", place)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _grid(docs: DataFrame, id_col: str, fields: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """doc, field, weight, terms, length: one row for each field of a document."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(weights[name]).alias("weight"), terms(text).alias("terms")) for name, text in fields.items()])
    return docs.select(docs[id_col].alias("doc"), F.explode(each).alias("f")).select("doc", "f.field", "f.weight", "f.terms", F.size("f.terms").alias("length"))


def _statistics(grid: DataFrame) -> DataFrame:
    """field, n_docs, mean: over all documents, so an empty field counts as length 0; a mean of 0 counts as 1. One row per field."""
    mean = F.avg("length")
    return grid.groupBy("field").agg(F.count("*").alias("n_docs"), F.when(mean == 0, 1.0).otherwise(mean).alias("mean"))


#: Rows of query terms up to which they are broadcast.
MOST_ASKED = 1 << 16


def _hint(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what has no more rows than the query terms, if these are few; otherwise the planner chooses."""
    return F.broadcast if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else lambda df: df


def _counted(grid: DataFrame, among: DataFrame | None, hint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """doc, field, weight, length, term, tf.

    With ``among`` (term) other terms are left out before anything is shuffled. The
    rest is dealt by document, so that counts, sums of fields and scores of a
    document are all made in one place without another shuffle.
    """
    each = grid.select("doc", "field", "weight", "length", F.explode("terms").alias("term"))
    if among is not None:
        each = each.join(hint(among.select("term").distinct()), "term", "left_semi").repartition("doc")
    return each.groupBy("doc", "field", "weight", "length", "term").agg(F.count("*").alias("tf"))


def _normalised() -> Column:
    return (1 - B) + B * F.col("length") / F.col("mean")


def bm25(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, plus_one: bool = True) -> DataFrame:
    """query_id, doc, score > 0 of all matching documents. asked: query_terms."""
    grid, hint = _grid(docs, id_col, {"all": text}, {"all": 1.0}), _hint(asked)
    tf = _counted(grid, asked, hint).join(F.broadcast(_statistics(grid)), "field")  # one row
    idf = tf.groupBy("term", "n_docs").agg(F.count("*").alias("df")).select("term", inverse_frequency(F.col("df"), F.col("n_docs")).alias("idf"))
    hits = tf.join(hint(asked.join(idf, "term")), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * ((K1 + 1) if plus_one else 1.0) / (F.col("tf") + K1 * _normalised())
    return hits.groupBy("query_id", "doc").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def field_postings(docs: DataFrame, id_col: str, fields: dict[str, Column], weights: dict[str, float] = FIELD_WEIGHTS, among: DataFrame | None = None, hint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """doc, field, term, n_docs, v: length-normalised weighted frequency of a term (of those in ``among``) in a field."""
    grid = _grid(docs, id_col, fields, weights)
    tf = _counted(grid, among, hint).join(F.broadcast(_statistics(grid)), "field")  # one row per field
    return tf.select("doc", "field", "term", "n_docs", (F.col("weight") * F.col("tf") / _normalised()).alias("v"))


def bm25f_parts(docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame) -> DataFrame:
    """query_id, doc, term, v (all fields), part (of the score)."""
    hint = _hint(asked)
    postings = field_postings(docs, id_col, fields, among=asked, hint=hint).groupBy("doc", "term").agg(F.sum("v").alias("v"), F.first("n_docs").alias("n_docs"))
    idf = postings.groupBy("term", "n_docs").agg(F.count("*").alias("df")).select("term", inverse_frequency(F.col("df"), F.col("n_docs")).alias("idf"))
    return postings.join(hint(asked.join(idf, "term")), "term").select("query_id", "doc", "term", "v", (F.col("times") * F.col("idf") * F.col("v") / (K1 + F.col("v"))).alias("part"))


def bm25f(docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame) -> DataFrame:
    return bm25f_parts(docs, id_col, fields, asked).groupBy("query_id", "doc").agg(F.sum("part").alias("score")).where(F.col("score") > 0)


def search(docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame, metadata: Column | None = None) -> DataFrame:
    """BM25F where the documents' full text (field ``body``) is there, else BM25 over their metadata, with a warning."""
    if "body" in fields:
        return bm25f(docs, id_col, fields, asked)
    warnings.warn("no full text: search goes over metadata only", stacklevel=2)
    return bm25(docs, id_col, metadata if metadata is not None else F.concat_ws(" ", *fields.values()), asked)


def field_share(docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, doc, field, share: how much of a hit's score comes from a field."""
    parts = bm25f_parts(docs, id_col, fields, asked).join(hits.select("query_id", "doc"), ["query_id", "doc"])
    by_field = parts.join(field_postings(docs, id_col, fields, among=asked).select("doc", "term", "field", F.col("v").alias("fv")), ["doc", "term"])
    total = F.sum("got").over(W.partitionBy("query_id", "doc"))
    summed = by_field.groupBy("query_id", "doc", "field").agg(F.sum(F.col("part") * F.col("fv") / F.col("v")).alias("got"))
    return summed.select("query_id", "doc", "field", (F.col("got") / total).alias("share"))


def tfidf_vectors(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, term, w: (1 + ln tf) * ln((1 + n) / (1 + df)), of length 1 for each document."""
    n = docs.agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").join(F.broadcast(n)).select("doc", "term", ((1 + F.log("tf")) * F.log((1 + F.col("n_docs")) / (1 + F.col("df")))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))
    return raw.withColumn("norm", norm).where("norm > 0").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def _tfidf_lengths(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tf; term, idf; doc, length > 0, which needs all terms of a document, and so one sum for each."""
    tf = term_frequency(docs, id_col, text)
    n = docs.agg(F.count("*").alias("n_docs"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))).alias("idf"))
    w = (1 + F.log("tf")) * F.col("idf")
    return tf, idf, tf.join(idf, "term").groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("length")).where("length > 0")


def tfidf_cosine(docs: DataFrame, id_col: str, text: Column, asked: DataFrame) -> DataFrame:
    """query_id, doc, score: cosine, with the documents' statistics for the queries too."""
    tf, idf, lengths = _tfidf_lengths(docs, id_col, text)
    q = asked.join(idf, "term").select("query_id", "term", ((1 + F.log("times")) * F.col("idf")).alias("qw"))
    q = q.withColumn("norm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(W.partitionBy("query_id")))).where("norm > 0")
    w = (1 + F.log("tf")) * F.col("idf")
    hits = tf.join(_hint(asked)(q.join(idf, "term")), "term").groupBy("query_id", "doc").agg(F.sum(w * F.col("qw") / F.col("norm")).alias("dot"))
    return hits.join(lengths, "doc").select("query_id", "doc", (F.col("dot") / F.col("length")).alias("score")).where("score > 0")


#: Cells (terms x queries) of the weights that a task of the search for the best holds, and cells of a block of documents.
MOST_CELLS, _BLOCK = 1 << 23, 1 << 21


#: Documents of a batch that are worked on together, and bytes of their texts, beyond which they are fewer.
_DOCS, _BYTES = 2048, 4 << 20


def pieces(batch: pa.RecordBatch, texts: list[int]) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most _DOCS rows and about _BYTES bytes of the texts (numbers of columns)."""
    sizes = sum((pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
    upto, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = min(lo + _DOCS, max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _BYTES, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def lists(at: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """n lists of the values; at: the list of each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), values)


def packed(at: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """n lists of 32-bit integers as binaries: one value for a row instead of many."""
    ends = (4 * np.searchsorted(at, np.arange(n + 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _unpacked(terms: pa.Array, tf: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each posting's row, term and count of packed terms and counts."""
    n = (pc.binary_length(tf).to_numpy(zero_copy_only=False) // 4).astype(np.int64)
    words = pc.split_pattern(terms.filter(pa.array(n > 0)), " ").flatten()
    return np.repeat(np.arange(len(n)), n), words, np.frombuffer(b"".join(tf.to_pylist()), np.int32)


def _finder(vocabulary: list[str], n_fields: int, whole: int | None = None):
    """Batches of doc and the fields' texts: doc, the fields' lengths in terms, and each field's asked terms (by number) with their counts.

    With ``whole`` (number of a field) all its distinct terms, with blanks between, and their counts, packed, follow. A text is cut into terms where it lies, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts = pa.array(vocabulary, pa.string()), list(range(1, n_fields + 1))
        names = ["doc", *[f"n{f}" for f in range(n_fields)], *[f"{c}{f}" for f in range(n_fields) for c in "tc"], *(["terms", "tf"] if whole is not None else [])]
        for b in (piece for batch in batches for piece in pieces(batch, texts)):
            lengths, found, rest, n = [], [], [], b.num_rows
            for f in range(n_fields):
                length, at, term, times, words = term_counts(b.column(1 + f))
                number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)[term]
                there, times = number >= 0, times.astype(np.int32)
                lengths.append(pa.array(length, pa.int64()))
                found += [lists(at[there], n, pa.array(number[there], pa.int32())), lists(at[there], n, pa.array(times[there]))]
                rest += [pc.binary_join(lists(at, n, words.take(pa.array(term))), " "), packed(at, n, times)] if f == whole else []
            yield pa.RecordBatch.from_arrays([b.column(0), *lengths, *found, *rest], names)

    return run


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Values in units of a digit, rounded as Spark rounds: halves up, by the shortest decimal form."""
    y = x * 10.0**digits
    out = np.floor(y + 0.5)
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-2):
        out[k] = float(Decimal(repr(float(x[k]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _nine(scores: np.ndarray) -> np.ndarray:
    return rounded(scores, 9)


def _scorer(part: Callable[[list[np.ndarray], np.ndarray], np.ndarray], weights: np.ndarray, ids: list, n_fields: int, k: int, types: list[pa.DataType], more: bool):
    """Batches of _finder: the k best documents of each query (number, document, score) among those of a task.

    part: the fields' counts (documents x terms) and lengths (fields x documents) to the terms' parts of the score.
    """
    n_terms, n_queries = weights.shape
    step = max(1, min(1024, _BLOCK // max(n_terms, n_queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, kept, new = np.zeros(n_queries), pd.DataFrame({"q": [], "doc": [], "score": []}), []

        def settle():
            nonlocal kept, new
            rows = pd.concat([kept, *new]) if len(kept) else pd.concat(new)
            rows = rows.assign(nine=-_nine(rows["score"].to_numpy())).sort_values(["q", "nine", "doc"], kind="stable")
            place = rows.groupby("q").cumcount()
            last = rows[place == k - 1]
            kept, new = rows[place < k].drop(columns="nine"), []
            low = kept.groupby("q")["score"].min()
            full = last["q"].to_numpy().astype(int)
            least[full] = np.maximum(0.0, low.loc[last["q"]].to_numpy() - 3e-9)  # what may round to the same digits stays

        waiting = 0
        for b in batches:
            docs = b.column(0).to_pandas()
            lengths = np.array([b.column(1 + f).to_numpy(zero_copy_only=False) for f in range(n_fields)], dtype=float)
            scale = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) if more else None
            for lo in range(0, b.num_rows, step):
                n = min(step, b.num_rows - lo)
                counts = _counts(b, n_fields, n_terms, lo, n)
                scores = part(counts, lengths[:, lo : lo + n]) @ weights
                if more:
                    scores /= scale[lo : lo + n, None]
                d, q = np.nonzero((scores > 0) & (scores >= least))
                if len(d):
                    new.append(pd.DataFrame({"q": q, "doc": docs.to_numpy()[lo + d], "score": scores[d, q]}))
                    waiting += len(d)
                if waiting > 4 * k * n_queries:
                    settle()
                    waiting = 0
        if new:
            settle()
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([ids[int(q)] for q in kept["q"]], types[0]), pa.array(kept["doc"].tolist(), types[1]), pa.array(kept["score"].to_numpy(dtype=float))], ["query_id", "doc", "score"])

    return run


def _few(asked: DataFrame) -> tuple[list, list[str], np.ndarray] | None:
    """Queries, terms and times (terms x queries), if they are few enough for a task to hold."""
    rows = asked.select("query_id", "term", "times").limit(MOST_ASKED + 1).collect()
    ids, vocabulary = sorted({r[0] for r in rows if r[0] is not None}), sorted({r[1] for r in rows})
    if not rows or len(rows) > MOST_ASKED or len(ids) * len(vocabulary) > MOST_CELLS or any(r[0] is None for r in rows):
        return None
    times, q, t = np.zeros((len(vocabulary), len(ids))), {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(vocabulary)}
    for r in rows:
        times[t[r[1]], q[r[0]]] = r[2]
    return ids, vocabulary, times


class Meeting:
    """Documents that meet queries in the tasks where their rows lie; texts are cut into terms once, and their asked terms are written.

    A task holds all queries' weights. Too many queries for that, and ids that are
    null, repeat or are neither numbers nor strings, take the plain way, whose
    shuffle and memory grow with documents times the queries' terms.

    whole: a field that TF-IDF ranks, so that all its terms are counted in the same pass.
    """

    def __init__(self, docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame, whole: str | None = None):
        self.docs, self.id_col, self.fields, self.asked = docs, id_col, fields, asked
        known = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
        self.types = [known.get(df.schema[c].dataType) for df, c in ((asked, "query_id"), (docs, id_col))]
        few = _few(asked) if all(self.types) else None
        self.plain = few is None
        if self.plain:
            return
        self.ids, self.vocabulary, self.times = few
        names = range(len(fields))
        texts = docs.select(docs[id_col].alias("doc"), *[text.cast("string").alias(f"w{f}") for f, text in zip(names, fields.values())])
        self.kinds = [asked.schema["query_id"].dataType, texts.schema["doc"].dataType]
        numbers = T.ArrayType(T.IntegerType())
        shape = [T.StructField("doc", self.kinds[1]), *[T.StructField(f"n{f}", T.LongType()) for f in names], *[T.StructField(f"{c}{f}", numbers) for f in names for c in "tc"]]
        columns = [f.name for f in shape]
        shape += _PACKED if whole else []
        counted = cut(texts.mapInArrow(_finder(self.vocabulary, len(fields), list(fields).index(whole) if whole else None), T.StructType(shape)))
        facts = counted.agg(F.count("*"), F.count_distinct("doc"), *[F.avg(f"n{f}") for f in names]).first()
        self.plain = facts[0] != facts[1]
        self.found = _measured(counted, columns) if whole and not self.plain else counted
        cores = docs.sparkSession.sparkContext.defaultParallelism
        self.dealt = self.found.repartition(max(cores, self.found.rdd.getNumPartitions()))  # joins may have left the rows in one part, and pairs are many
        self.n_docs, self.means = facts[0], np.array([m if m else 1.0 for m in facts[2:]])

    def _way(self, how: Callable, names: list[str]) -> tuple[Callable, np.ndarray, list[int]]:
        """The function of the fields' counts and lengths, the weights, and the fields' numbers. how(n_docs, df, means, times): the first two."""
        at = [list(self.fields).index(name) for name in names]
        each = F.explode(F.array_distinct(F.flatten(F.array(*[f"t{f}" for f in at])))).alias("t")
        df = np.zeros(len(self.vocabulary))
        for r in self.found.select(each).groupBy("t").count().collect():  # one row for each asked term
            df[r[0]] = r[1]
        return *how(self.n_docs, df, self.means[at][:, None], self.times), at

    def _shape(self, *scores: str) -> T.StructType:
        return T.StructType([T.StructField("query_id", self.kinds[0]), T.StructField("doc", self.kinds[1]), *[T.StructField(c, T.DoubleType()) for c in scores]])

    def _plainly(self, kind: str, names: list[str]) -> DataFrame:
        if kind == "bm25":
            return bm25(self.docs, self.id_col, self.fields[names[0]], self.asked)
        return bm25f(self.docs, self.id_col, {name: self.fields[name] for name in names}, self.asked)

    def top(self, how: Callable, k: int, plain: Callable[[], DataFrame], names: list[str] | None = None, by_length: bool = False) -> DataFrame:
        """query_id, doc, score, rank: the k best documents of each query, as ``best(plain(), k)``.

        Only the k best of a task go on, so what is shuffled and held does not grow with documents times queries.
        by_length: scores are divided by the lengths of the vectors of the field ``whole``.
        """
        if self.plain:
            return best(plain(), k)
        names = names or list(self.fields)
        part, weights, at = self._way(how, names)
        rows = self.found.select("doc", *[f"n{f}" for f in at], *[f"{c}{f}" for f in at for c in "tc"], *(["length"] if by_length else []))
        rows = rows.where("length > 0") if by_length else rows
        return best(rows.mapInArrow(_scorer(part, weights, self.ids, len(at), k, self.types, by_length), self._shape("score")), k)

    def every(self, ways: dict[str, tuple[str, list[str]]]) -> DataFrame:
        """query_id, doc and a column for each way (bm25 or bm25f, fields): all scores > 0, null where a way has none.

        Pairs come out of the tasks that hold the documents, one row for all ways, without a shuffle.
        """
        if self.plain:
            each = [self._plainly(*way).withColumnRenamed("score", name) for name, way in ways.items()]
            return reduce(lambda a, b: a.join(b, ["query_id", "doc"], "full_outer"), each)
        made = [self._way(HOW[kind](names), names) for kind, names in ways.values()]
        return self.dealt.mapInArrow(_all_scorer(made, self.ids, len(self.fields), self.types, list(ways)), self._shape(*ways))

    def some(self, ways: dict[str, tuple[str, list[str]]], pairs: DataFrame) -> DataFrame:
        """As every, of the given pairs (query_id, doc) alone; only their documents are scored."""
        if self.plain:
            return self.every(ways).join(pairs.select("query_id", "doc").distinct(), ["query_id", "doc"], "left_semi")
        wanted = cut(pairs.where("query_id is not null").groupBy("doc").agg(F.collect_set("query_id").alias("wanted")))
        rows = self.found.join(small(wanted), "doc").repartition(self.docs.sparkSession.sparkContext.defaultParallelism)
        made = [self._way(HOW[kind](names), names) for kind, names in ways.values()]
        return rows.mapInArrow(_all_scorer(made, self.ids, len(self.fields), self.types, list(ways), chosen=True), self._shape(*ways))

    def blocks(self, ways: dict[str, tuple[str, list[str]]], seed: int = 0, label: Column | None = None, labels: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(blocks, numbers) of all pairs that the first way scores above 0, packed by query; not for ``plain``.

        numbers: doc, number (in the order of documents). blocks: query_id, base, at (number - base,
        32-bit), the scores of each way (doubles, 0 without one), key (16 bytes of evaluate.random_key)
        and same (a byte: whether the document's label is that of the query, by ``labels``).
        """
        parts = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.found.rdd.getNumPartitions())
        label = (label if label is not None else F.lit(None)).cast("string").alias("_label")
        ordered = cut(self.found.select("*", label).repartitionByRange(parts, "doc").sortWithinPartitions("doc").withColumn("_number", F.monotonically_increasing_id()))
        made = [self._way(HOW[kind](names), names) for kind, names in ways.values()]
        own = [(labels or {}).get(q) for q in self.ids]
        shape = T.StructType([T.StructField("query_id", self.kinds[0]), T.StructField("base", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("at", *ways, "key", "same")]])
        return ordered.mapInArrow(_blocker(made, self.ids, len(self.fields), self.types, list(ways), seed, own), shape), ordered.select("doc", F.col("_number").alias("number"))

    def strong(self, kind: str, names: list[str], apart: DataFrame, share: float = ENTRY_SHARE, least: int = MOST_ENTRIES) -> DataFrame:
        """query_id, doc, score: at least what scores ``share`` of a query's best or is among its ``least`` best, with the documents of ``apart`` (doc) or without them.

        So ranks among these rows are those among all, for the rows that matter.
        """
        if self.plain:
            return self._plainly(kind, names)
        rows = self.dealt.join(apart.select("doc").distinct().withColumn("apart", F.lit(True)), "doc", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
        return rows.mapInArrow(_all_scorer([self._way(HOW[kind](names), names)], self.ids, len(self.fields), self.types, ["score"], (share, least)), self._shape("score"))


def _counts(b: pa.RecordBatch, n_fields: int, n_terms: int, lo: int, n: int) -> list[np.ndarray]:
    """Counts (documents x terms) of each field for n rows of a batch of _finder."""
    out = []
    for f in range(n_fields):
        t, c = b.column(1 + n_fields + 2 * f).slice(lo, n), b.column(2 + n_fields + 2 * f).slice(lo, n)
        out.append(np.zeros((n, n_terms)))
        at = np.repeat(np.arange(n), pc.list_value_length(t).to_numpy(zero_copy_only=False))
        out[-1][at, t.flatten().to_numpy(zero_copy_only=False)] = c.flatten().to_numpy(zero_copy_only=False)
    return out


def _all_scorer(ways: list[tuple[Callable, np.ndarray, list[int]]], ids: list, n_fields: int, types: list[pa.DataType], names: list[str], limits: tuple[float, int] | None = None, chosen: bool = False):
    """Batches of _finder: query, document and all scores > 0.

    limits (share, least), with a last column that says whether a document is
    apart: of both kinds of documents by themselves, what reaches neither the
    share of the best score so far nor the ``least`` best so far is left out.
    chosen: a last column has the queries that a document is wanted for.
    """
    n_terms, n_queries = ways[0][1].shape
    step = max(1, min(1024, _BLOCK // max(n_terms, n_queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(ids, types[0])
        seen = {kind: np.zeros((limits[1], n_queries)) for kind in (True, False)} if limits else {}
        for b in batches:
            lengths = np.array([b.column(1 + f).to_numpy(zero_copy_only=False) for f in range(n_fields)], dtype=float)
            apart = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) if limits else None
            for lo in range(0, b.num_rows, step):
                n = min(step, b.num_rows - lo)
                counts = _counts(b, n_fields, n_terms, lo, n)
                scores = [part([counts[f] for f in at], lengths[at, lo : lo + n]) @ weights for part, weights, at in ways]
                there = np.any([s > 0 for s in scores], axis=0)
                if chosen:
                    wanted = b.column(b.num_columns - 1).slice(lo, n)
                    q = pc.fill_null(pc.index_in(wanted.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False)
                    mine = np.zeros((n, n_queries + 1), bool)  # the last column takes what is no query
                    mine[np.repeat(np.arange(n), pc.list_value_length(wanted).to_numpy(zero_copy_only=False)), q] = True
                    there &= mine[:, :-1]
                for kind in seen:
                    of = apart[lo : lo + n] == kind
                    if of.any():
                        seen[kind] = np.sort(np.concatenate([seen[kind], scores[0][of]]), axis=0)[-limits[1] :]
                        there[of] &= scores[0][of] >= np.minimum(limits[0] * seen[kind][-1], seen[kind][0]) - 3e-9  # what may round to the same digits stays
                d, q = np.nonzero(there)
                if len(d):
                    values = [s[d, q] for s in scores]
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), b.column(0).slice(lo, n).take(pa.array(d)).cast(types[1]), *[pa.array(v, pa.float64(), mask=v <= 0) for v in values]], ["query_id", "doc", *names])

    return run


def _blocker(ways: list[tuple[Callable, np.ndarray, list[int]]], ids: list, n_fields: int, types: list[pa.DataType], names: list[str], seed: int, own: list):
    """Batches of _finder with labels and numbers last: blocks of Meeting.blocks, one for each query and some documents."""
    n_terms, n_queries = ways[0][1].shape
    step = max(1, min(2048, 2 * _BLOCK // max(n_terms, n_queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heads = pa.array(ids, types[0]), [f"{seed}|{q}|".encode() for q in ids]
        own_code = {x: i for i, x in enumerate({x for x in own if x is not None})}
        mine = np.array([own_code.get(x, -1) for x in own])
        for b in batches:
            lengths = np.array([b.column(1 + f).to_numpy(zero_copy_only=False) for f in range(n_fields)], dtype=float)
            texts = [str(x).encode() for x in b.column(0).to_pylist()]
            codes = np.array([own_code.get(x, -2) for x in b.column(b.num_columns - 2).to_pylist()])
            numbers = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for lo in range(0, b.num_rows, step):
                n = min(step, b.num_rows - lo)
                counts = _counts(b, n_fields, n_terms, lo, n)
                scores = [(part([counts[f] for f in at], lengths[at, lo : lo + n]) @ weights).T for part, weights, at in ways]
                q, d = np.nonzero(scores[0] > 0)
                here = np.unique(q)
                if not len(here):
                    continue
                ends = np.append(np.searchsorted(q, here), len(q))
                values = [(numbers[lo + d] - numbers[lo]).astype(np.int32), *[np.maximum(s[q, d], 0.0) for s in scores]]
                keys = b"".join([md5(heads[i] + texts[lo + j]).digest() for i, j in zip(q.tolist(), d.tolist())])
                same = (codes[lo + d] == mine[q]).astype(np.uint8)
                columns = [(x.tobytes(), x.dtype.itemsize) for x in values] + [(keys, 16), (same.tobytes(), 1)]
                packs = [pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)]) for data, width in columns]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(here)), pa.array(np.full(len(here), numbers[lo])), *packs], ["query_id", "base", "at", *names, "key", "same"])

    return run


def opened(blocks: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The pairs of one query in the order of their documents: number, the named scores, key (two columns of 64 bits) and same."""
    joined = lambda name, kind: np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)
    at = joined("at", np.int32)
    sizes = pc.binary_length(blocks.column("at")).to_numpy() // 4
    number = np.repeat(blocks.column("base").to_numpy(), sizes) + at
    order = np.argsort(number, kind="stable")
    out = {"number": number[order], "key": joined("key", ">u8").reshape(-1, 2)[order].astype(np.uint64), "same": joined("same", np.uint8)[order] > 0}
    return out | {name: joined(name, np.float64)[order] for name in names}


def _idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _bm25_how(names: list[str]) -> Callable:
    def how(n_docs, df, means, times):
        def part(counts, lengths):
            norm = ((1 - B) + B * lengths[0] / means[0])[:, None]
            return counts[0] * (K1 + 1) / (counts[0] + K1 * norm)

        return part, times * _idf(n_docs, df)[:, None]

    return how


def _bm25f_how(names: list[str]) -> Callable:
    boost = [FIELD_WEIGHTS[name] for name in names]

    def how(n_docs, df, means, times):
        def part(counts, lengths):
            v = sum(w * c / ((1 - B) + B * n / m)[:, None] for w, c, n, m in zip(boost, counts, lengths, means))
            return v / (K1 + v)

        return part, times * _idf(n_docs, df)[:, None]

    return how


HOW = {"bm25": _bm25_how, "bm25f": _bm25f_how}


def bm25_top(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, k: int) -> DataFrame:
    """The k best of bm25."""
    return Meeting(docs, id_col, {"all": text}, asked).top(_bm25_how(["all"]), k, lambda: bm25(docs, id_col, text, asked))


def bm25f_top(docs: DataFrame, id_col: str, fields: dict[str, Column], asked: DataFrame, k: int) -> DataFrame:
    """The k best of bm25f."""
    return Meeting(docs, id_col, fields, asked).top(_bm25f_how(list(fields)), k, lambda: bm25f(docs, id_col, fields, asked))


#: Most frequent terms that every task knows; the others of a document are joined.
MOST_COMMON = 1 << 18


_PACKED = [T.StructField("terms", T.StringType()), T.StructField("tf", T.BinaryType())]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed terms and counts: terms and the numbers of their documents in a batch."""
    for b in batches:
        words = pc.value_counts(_unpacked(b.column(0), b.column(1))[1])
        yield pa.RecordBatch.from_arrays([words.field(0), words.field(1)], ["term", "n"])


def _summer(common: list[str], idf: np.ndarray):
    """Batches of documents with packed terms and counts last: the squares of the common terms' weights summed (own), and lists of the other terms and their counts, in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(common, pa.string())
        for b in batches:
            at, words, tf = _unpacked(b.column(b.num_columns - 2), b.column(b.num_columns - 1))
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            there = place >= 0
            own = np.bincount(at[there], ((1 + np.log(tf[there])) * idf[place[there]]) ** 2, minlength=b.num_rows)
            rest = [lists(at[~there], b.num_rows, x) for x in (words.filter(pa.array(~there)), pa.array(tf[~there], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(own, pa.float64()), *rest], [*b.schema.names[:-2], "own", "terms", "tf"])

    return run


def _measured(counted: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and length, that of a document's TF-IDF vector as _tfidf_lengths. counted: columns with doc, which does not repeat, and packed terms and tf.

    Rows of documents stay where they are; the terms that few documents have are summed apart,
    and what is joined is one number for a document that has any.
    """
    n = counted.count()
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))).alias("idf")
    known = cut(counted.select("terms", "tf").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).select("term", "df", idf))
    common = known.orderBy(F.desc("df"), "term").limit(MOST_COMMON).select("term", "idf").toPandas()
    shape = T.StructType([*[counted.schema[c] for c in columns], T.StructField("own", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    parts = cut(counted.select(*columns, "terms", "tf").mapInArrow(_summer(common["term"].tolist(), common["idf"].to_numpy(dtype=float)), shape))
    if len(common) < MOST_COMMON:
        return parts.select(*columns, F.sqrt("own").alias("length"))
    each = parts.select("doc", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("doc", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
    w = (1 + F.log("tf")) * F.col("idf")
    rest = each.join(known.hint("shuffle_hash"), "term").groupBy("doc").agg(F.sum(w * w).alias("rest"))
    joined = parts.select(*columns, "own").join(rest.hint("shuffle_hash"), "doc", "left")  # hashed: long rows are not sorted
    return cut(joined.select(*columns, F.sqrt(F.col("own") + F.coalesce("rest", F.lit(0.0))).alias("length")))


def _tfidf_norms(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """doc, length > 0 as _tfidf_lengths, for ids that do not repeat: texts are cut into terms once, and only uncommon terms are joined."""
    texts = docs.select(docs[id_col].alias("doc"), text.cast("string").alias("w"))
    numbers = T.ArrayType(T.IntegerType())
    shape = T.StructType([texts.schema["doc"], T.StructField("n0", T.LongType()), T.StructField("t0", numbers), T.StructField("c0", numbers), *_PACKED])
    return _measured(cut(texts.mapInArrow(_finder([], 1, 0), shape)), ["doc"]).where("length > 0")


def _tfidf_how(n_docs, df, means, times):
    idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)), 0.0)[:, None]
    part = lambda counts, lengths: np.where(counts[0] > 0, 1 + np.log(np.maximum(counts[0], 1)), 0.0)
    asked_for = np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0.0) * idf
    norm = np.sqrt((asked_for**2).sum(axis=0))
    return part, idf * asked_for / np.where(norm > 0, norm, 1.0)


def tfidf_top(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, k: int) -> DataFrame:
    """The k best of tfidf_cosine."""
    return Meeting(docs, id_col, {"all": text}, asked, "all").top(_tfidf_how, k, lambda: tfidf_cosine(docs, id_col, text, asked), by_length=True)


def three_tops(docs: DataFrame, id_col: str, metadata: Column, fields: dict[str, Column], asked: DataFrame, k: int) -> list[DataFrame]:
    """The k best of bm25 over metadata, of bm25f over fields and of tfidf_cosine over their ``body``; texts are read and cut into terms once for all three."""
    met = Meeting(docs, id_col, {"metadata": metadata} | fields, asked, "body")
    return [
        met.top(_bm25_how(["metadata"]), k, lambda: bm25(docs, id_col, metadata, asked), ["metadata"]),
        met.top(_bm25f_how(list(fields)), k, lambda: bm25f(docs, id_col, fields, asked), list(fields)),
        met.top(_tfidf_how, k, lambda: tfidf_cosine(docs, id_col, fields["body"], asked), ["body"], by_length=True),
    ]


def boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """Scores times a document's boost (1 without one); 0 drops the document. boosts: doc, boost."""
    joined = scores.join(boosts, "doc", "left")
    return joined.withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0))).drop("boost").where("score > 0")


def entries(ranked: DataFrame, share: float = ENTRY_SHARE, most: int = MOST_ENTRIES) -> DataFrame:
    """Hits that score at least a share of the best; at least one, at most ``most``."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return ranked.withColumn("top", top).where(((F.col("score") >= share * F.col("top")) | (F.col("rank") == 1)) & (F.col("rank") <= most)).drop("top")


def strong_band(ranked: DataFrame, share: float = ENTRY_SHARE) -> DataFrame:
    """All strong hits, put between 90 and 91."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return ranked.withColumn("top", top).where(F.col("score") >= share * F.col("top")).withColumn("band", 90 + F.col("score") / F.col("top")).drop("top")
