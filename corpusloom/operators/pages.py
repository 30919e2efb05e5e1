"""Links, directories and passages of document sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the passages of one automaton.
MOST_BYTES = 32 << 20


def html_links(pages: DataFrame, id_col: str, html: Column) -> DataFrame:
    """page, ordinal, target of each <a href>."""
    found = F.regexp_extract_all(html, F.lit(r'<a [^>]*?href="([^"]*)"'), 1)
    return pages.select(pages[id_col].alias("page"), F.posexplode(found).alias("ordinal", "target")).withColumn("ordinal", F.col("ordinal").cast("long"))


def broken(links: DataFrame, known: DataFrame, target: str = "target", key: str = "key") -> DataFrame:
    """Links whose target is not known."""
    return links.join(known.select(F.col(key).alias(target)).distinct(), target, "left_anti")


def validate(docs: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """One row: documents without a type, links without a target, and whether all is well. docs: path, type."""
    untyped = docs.agg(F.count_if(F.coalesce("type", F.lit("")) == "").alias("untyped"))
    missing = broken(links, known).agg(F.count("*").alias("broken"))
    return untyped.join(F.broadcast(missing)).withColumn("valid", (F.col("untyped") == 0) & (F.col("broken") == 0))  # one row each


def rollup(paths: DataFrame, path: Column) -> DataFrame:
    """parent, children, entries: every directory with its number of distinct children and of entries below it."""
    parts = F.split(path, "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.array_join(F.slice(parts, 1, n), "/").alias("child")))
    each = paths.select(F.explode(pairs).alias("p")).groupBy("p.parent", "p.child").agg(F.count("*").alias("n"))
    return each.groupBy("parent").agg(F.count("*").alias("children"), F.sum("n").alias("entries"))


def containing(passages: DataFrame, passage_id: str, passage: Column, docs: DataFrame, doc_id: str, text: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """passage id and document id where the document contains the passage, of any length.

    An automaton of all passages (Aho-Corasick) goes over each text once, in the
    task that reads it; texts are never moved. Passages are dealt into as many
    automata as keep each within ``most_bytes``, and texts are read once for each.
    Null and empty passages are in no document.
    """
    p = passages.select(passages[passage_id].alias("pid"), passage.cast("string").alias("passage")).where("passage <> ''")
    p = p.groupBy("passage").agg(F.collect_set("pid").alias("pids"))
    d = docs.select(docs[doc_id].alias("did"), text.cast("string").alias("text")).where(F.col("text").isNotNull())
    n_bytes = p.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    shards = -(-n_bytes // most_bytes)
    fields = T.StructType([d.schema["did"], T.StructField("passage", T.StringType())])
    found = None
    for shard in range(shards):
        mine = p.where(F.pmod(F.xxhash64("passage"), F.lit(shards)) == shard).select("passage")
        met = d.mapInArrow(_finder([r[0] for r in mine.toLocalIterator()]), fields)  # at most about `most_bytes`
        found = met if found is None else found.unionByName(met)
    ids = p.select("passage", F.explode("pids").alias("pid"))
    if found is None:
        return ids.join(d.limit(0)).select("pid", "did")
    return found.join(ids, "passage").select("pid", "did").distinct()


def _finder(patterns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern in patterns:
            automaton.add_word(pattern, pattern)
        if patterns:
            automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                in_text = {pattern for _, pattern in automaton.iter(text)} if patterns else ()
                rows += [k] * len(in_text)
                hits += sorted(in_text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], ["did", "passage"])

    return run


def term_links(left: DataFrame, left_id: str, left_terms: Column, right: DataFrame, right_id: str, right_terms: Column, least: int = 5) -> DataFrame:
    """left, right, shared: equal terms of at least ``least`` letters."""
    a = left.select(left[left_id].alias("left"), F.explode(F.array_distinct(left_terms)).alias("term")).where(F.length("term") >= least)
    b = right.select(right[right_id].alias("right"), F.explode(F.array_distinct(right_terms)).alias("term")).where(F.length("term") >= least)
    return a.join(b, "term").groupBy("left", "right").agg(F.count("*").alias("shared"))


def cochange(commits: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """a < b, together, of_a, of_b, jaccard over commits (commit, file) of least to most files."""
    rows = commits.select("commit", "file").distinct()
    sizes = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("commit")
    kept = rows.join(sizes, "commit")
    each = kept.groupBy("file").agg(F.count("*").alias("n"))
    pairs = kept.toDF("commit", "a").join(kept.toDF("commit", "b"), "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    both = pairs.join(each.toDF("a", "of_a"), "a").join(each.toDF("b", "of_b"), "b")
    return both.select("a", "b", "together", "of_a", "of_b", (F.col("together") / (F.col("of_a") + F.col("of_b") - F.col("together"))).alias("jaccard"))
