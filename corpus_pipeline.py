"""A training corpus in five stages over the documents table.

Each stage reads what the one before has written and keeps the columns of
documents; the last one adds the token ids and the place in the mix.

Defined cases: null and empty texts, and texts without a letter, go in the first
stage; rows with a null id are kept like others where their text stays (they win
against no other id, and are linked with nothing); of rows that repeat, one
stays; very long texts go through whole; an empty table gives an empty result;
further columns of documents, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, language_id, mixing, near_dedup, piece_transducer
from corpusloom.plans.session import checkpoint_ready, remove, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, or that no learned language supports, go."""
    return language_id.keep_known(docs, least=language_id.SUPPORT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the schedule that mixes the sources."""
    return mixing.interleave(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, position in the mix, n_tokens and ids of each document.

    Files do not keep the order of rows, so the schedule, which follows from the
    ids and sources alone, is made again for the output.
    """
    placed = mixing.with_position(docs)
    return piece_transducer.tokenised(placed, piece_transducer.read_model(), ["doc_id", "lang", "source", "position"])


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece", tokens),
]

#: SQL cannot express the stages of language ID and of tokenising.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_ready(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:  # what the stage has read is not needed any more
            remove(spark, f"{base}/{k - 1}")
    return docs
