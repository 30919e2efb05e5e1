"""Incremental refresh as a stream: new versions of documents arrive as files and replace older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import content_hash


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "path", text: str = "text") -> StreamingQuery:
    """Appends rows whose content is new under their key, with the batch as version; rereading a batch adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("hash", content_hash(F.col(text))).dropDuplicates([key, "hash"])
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            old = current(spark, target, key).select(key, "hash")
            new = new.join(old, [key, "hash"], "left_anti")
        new.withColumn("version", F.lit(number)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str = "path") -> DataFrame:
    """The latest version of each key."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy(key).agg(F.max(F.struct("version", "hash")).alias("v")).select(key, "v.*")
    return rows.join(newest, [key, "version", "hash"], "left_semi")
