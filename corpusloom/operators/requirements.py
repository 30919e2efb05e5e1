"""Requirement texts and the code that implements them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import slug

#: File stems that say nothing, and least lengths of symbol names and stems.
GENERIC_STEMS = "utils util base core main init test tests types common helpers config settings models setup conftest compat constants".split()
SYMBOL, STEM = 4, 5


def requirements(texts: DataFrame) -> DataFrame:
    """source, slug, title (first '# ' heading, else the file's name), description and text of .md and .txt files (source, text)."""
    base = F.regexp_replace(F.substring_index("source", "/", -1), r"\.[^.]*$", "")
    heading = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    told = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?m)^#.*$", ""), r"\s+", " "))  # heading lines are left out
    kept = texts.where(F.col("source").rlike(r"\.(md|txt)$")).withColumn("text", F.coalesce("text", F.lit("")))
    return kept.select("source", slug(base).alias("slug"), F.when(heading != "", heading).otherwise(base).alias("title"), F.left(told, F.lit(200)).alias("description"), F.regexp_replace("text", r"\A\s+|\s+\z", "").alias("text"))


def _runs(text: Column) -> Column:
    """Path-like and dotted runs of a text with all their parts from each start to each end, which is where a path or module can stand."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./\-]+"), 0))


def links(required: DataFrame, files: DataFrame, generic: list[str] = GENERIC_STEMS) -> DataFrame:
    """slug, path, reasons: 'path' (the path or dotted module stands in the text), `name` (a symbol), 'file name' (a stem).

    files: path, module, symbols (array of names), is_test. A path can only stand
    inside a run of path characters, so runs that hold a file's base name, or a
    module's last part, are found by an equi-join on words and the whole name is
    checked afterwards; no text meets all files.
    """
    code = files.where(~F.col("is_test")).select("path", "module", "symbols")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), 0))
    said = required.select("slug", F.explode(words).alias("word"))
    names = code.select("path", F.explode(F.array_distinct("symbols")).alias("word")).where((F.length("word") >= SYMBOL) & ~F.startswith("word", F.lit("_")))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", "")
    stems = code.select("path", stem.alias("word")).where((F.length("word") >= STEM) & ~F.col("word").isin(*generic))
    by_symbol = said.join(names, "word").select("slug", "path", F.concat(F.lit("`"), "word", F.lit("`")).alias("reason"))
    by_stem = said.join(stems, "word").select("slug", "path", F.lit("file name").alias("reason"))

    runs = required.select("slug", F.explode(_runs(F.col("text"))).alias("run"))
    parts = F.array_distinct(F.filter(F.split("run", r"[/.]"), lambda x: x != ""))
    pieces = runs.select("slug", "run", F.explode(parts).alias("last"))
    dotted = F.size(F.split("module", r"\.")) > 1
    wanted = code.select("path", F.col("path").alias("whole"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", "").alias("last"))
    wanted = wanted.unionByName(code.where(F.col("module").isNotNull() & dotted).select("path", F.col("module").alias("whole"), F.substring_index("module", ".", -1).alias("last")))
    # a name may also begin or end inside a longer word; those are looked for in the word's own affixes
    affixes = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda n: F.left(x, n))
    pieces = pieces.select("slug", "run", F.explode(affixes(F.col("last"))).alias("last")).distinct()
    by_path = pieces.join(wanted, "last").where(F.contains("run", "whole")).select("slug", "path", F.lit("path").alias("reason"))
    return by_path.unionByName(by_symbol).unionByName(by_stem).groupBy("slug", "path").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
