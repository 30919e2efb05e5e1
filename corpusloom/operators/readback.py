"""The import graph, read back from the rendered documents.

Source-file documents list what a file depends on and what uses it, each with a
weight and names. Both lists are lines of the same edges, so they must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import body, sections

_LINE = r"- \[[^\]]*\]\(/files/([^)\s]+)\.md\): uses (.*) \(weight (\d+)\)"


def _lines(docs: DataFrame, text: Column, heading: str) -> DataFrame:
    """path, other, weight, names of the edges that a section lists."""
    said = F.coalesce(F.try_element_at(sections(text), F.lit(heading)), F.lit(""))
    rows = docs.select(F.regexp_extract("path", r"^/files/(.+)\.md$", 1).alias("path"), F.explode(F.split(said, "\n")).alias("line")).where(F.col("line").rlike(_LINE))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    return rows.select("path", part(1).alias("other"), part(3).cast("double").alias("weight"), F.regexp_extract_all(part(2), F.lit("`([^`]+)`"), 1).alias("names"))


def edges(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """src, dst, weight, names of what documents (path, text) say they depend on."""
    return _lines(docs, body(docs["text"]) if text is None else text, "Depends on").select(F.col("path").alias("src"), F.col("other").alias("dst"), "weight", "names")


def used(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """src, dst, weight, names of what documents say they are used by."""
    return _lines(docs, body(docs["text"]) if text is None else text, "Used by").select(F.col("other").alias("src"), F.col("path").alias("dst"), "weight", "names")


def asymmetric(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """src, dst, fault of edges that one side does not list, or lists otherwise, and of those that lead to no document."""
    a = edges(docs, text).select("src", "dst", F.col("weight").alias("wa"), F.col("names").alias("na"))
    b = used(docs, text).select("src", "dst", F.col("weight").alias("wb"), F.col("names").alias("nb"))
    both = a.join(b, ["src", "dst"], "full_outer")
    fault = F.when(F.col("wb").isNull(), "not listed by the target").when(F.col("wa").isNull(), "not listed by the source").when(F.col("wa") != F.col("wb"), "weights differ").when(F.col("na") != F.col("nb"), "names differ")
    known = docs.select(F.regexp_extract("path", r"^/files/(.+)\.md$", 1).alias("end")).where("end <> ''").distinct()
    ends = both.select("src", "dst", F.explode(F.array("src", "dst")).alias("end")).join(known, "end", "left_anti").select("src", "dst", F.lit("no such document").alias("fault"))
    return both.withColumn("fault", fault).where("fault is not null").select("src", "dst", "fault").unionByName(ends)
