"""Search with an index in files: built, refreshed after changes, and asked for the best documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search, segments
from corpusloom.plans import text_queries as tq
from corpusloom.plans.session import checkpoint_ready, cut, remove


def _place(spark: SparkSession) -> str:
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"


def _best(spark: SparkSession, d: str, path: str) -> DataFrame:
    found = cut(segments.topk(spark, path, tq.asked(spark, d), tq.TOP))  # ten rows a query; the index goes
    remove(spark, path)
    return tq.named(found, "score")


def earlier(docs: DataFrame) -> DataFrame:
    """doc_id, text as of an earlier state: a tenth has other texts, a tenth is not there yet, and as many are there that have gone since."""
    kind = F.pmod("doc_id", F.lit(10))
    old = docs.where(kind != 3).select("doc_id", F.when(kind == 1, F.concat(F.lit("an older draft of this passage\n"), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    return old.unionByName(docs.where(kind == 2).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


def index_topk(spark, d):
    """The search of bm25f_topk through an index of all documents, with postings read where they can matter."""
    path, docs = _place(spark), tq.documents(spark, d)
    segments.refresh(docs, "doc_id", tq.fields(docs), path)
    return _best(spark, d, path)


def index_refreshed(spark, d):
    """The same through an index of an earlier state that has been brought up to date by a segment of its own."""
    path, docs = _place(spark), tq.documents(spark, d)
    old = earlier(docs)  # made again where it is read: whole texts are not written
    segments.refresh(old, "doc_id", tq.fields(old), path)
    segments.refresh(docs, "doc_id", tq.fields(docs), path)
    return _best(spark, d, path)


QUERIES = {f.__name__: f for f in (index_topk, index_refreshed)}
SQL = {name: tq.SQL["bm25f_topk"] for name in QUERIES}
