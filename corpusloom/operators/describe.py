"""One-line descriptions of files and groups, made from facts by column functions.

Their wording is a fixed value of the documents' format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that underline a title; most names and characters that a description lists.
UNDERLINE = r"^\s*([=~\-^*#+`'\".:_])\1{2,}\s*$"
NAMED, WIDTH = 4, 240


def plural(n: Column, word: str, many: str | None = None) -> Column:
    """'1 file', '3 files'."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(many or word + "s"))


def clean_docstring(doc: Column, module: Column, path: Column) -> Column:
    """First paragraph without lines that underline a title and without a leading line that only names the module."""
    lines = F.filter(F.split(F.trim(F.coalesce(doc, F.lit(""))), r"\r?\n"), lambda x: ~x.rlike(UNDERLINE))
    base = F.substring_index(path, "/", -1)
    own = F.array(module, F.substring_index(module, ".", -1), path, base, F.regexp_replace(base, r"\.py$", ""))
    bare = lambda x: F.trim(F.translate(x, "`*:'\"", "     "))
    names_itself = (bare(lines[0]) != "") & F.array_contains(own, bare(lines[0]))
    kept = F.when((F.size(lines) > 0) & names_itself, F.slice(lines, 2, F.size(lines))).otherwise(lines)
    paragraph = F.element_at(F.split(F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+", ""), r"\n\s*\n"), 1)
    return F.left(F.trim(F.regexp_replace(paragraph, r"\s+", " ")), F.lit(WIDTH))


def _listed(names: Column, word: str, many: str) -> Column:
    shown = F.array_join(F.slice(names, 1, NAMED), ", ")
    return F.concat(plural(F.size(names), word, many), F.lit(" ("), shown, F.when(F.size(names) > NAMED, ", …").otherwise(""), F.lit(")"))


def of_file(path: Column, module: Column, doc: Column, symbols: Column, is_test: Column, is_package: Column, parser: Column, parse_error: Column) -> Column:
    """What a file is for: its docstring, or what it defines."""
    said = F.rtrim(clean_docstring(doc, module, path), F.lit("."))
    classes = F.transform(F.filter(symbols, lambda s: s["kind"] == "class"), lambda s: s["name"])
    functions = F.transform(F.filter(symbols, lambda s: (s["kind"] == "function") & ~F.startswith(s["name"], F.lit("_"))), lambda s: s["name"])
    kind = F.when(is_test, "Test module").when(is_package, "Package initializer").otherwise("Module")
    parts = F.filter(F.array(F.when(F.size(classes) > 0, _listed(classes, "class", "classes")), F.when(F.size(functions) > 0, _listed(functions, "public function", "public functions"))), lambda x: x.isNotNull())
    made = F.when(F.size(parts) == 0, F.concat(kind, F.lit(" with no top-level definitions."))).otherwise(F.concat(kind, F.lit(" defining "), F.array_join(parts, " and "), F.lit(".")))
    text = F.when(said != "", F.concat(F.upper(F.left(said, F.lit(1))), F.substr(said, F.lit(2)), F.lit("."))).otherwise(made)
    return F.when((parser == "failed") & parse_error.isNotNull(), F.concat(F.lit("Could not be parsed: "), parse_error, F.lit("."))).otherwise(text)


def of_group(size: Column, tests: Column, hub: Column, first: Column, hub_doc: Column, children: Column) -> Column:
    """What a group of files is: its hub, its most central members (array ``first``) and its parts."""
    quoted = F.array_join(F.transform(F.slice(first, 1, 3), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    return F.concat(
        plural(size, "file"), F.lit(" centred on `"), hub, F.lit("`"),
        F.when(tests > 0, F.concat(F.lit(" ("), plural(tests, "test file"), F.lit(")"))).otherwise(""),
        F.lit(". Most central: "), quoted, F.lit("."),
        F.when(F.coalesce(hub_doc, F.lit("")) != "", F.concat(F.lit(" Hub purpose: "), F.rtrim(hub_doc, F.lit(".")), F.lit("."))).otherwise(""),
        F.when(children > 0, F.concat(F.lit(" Split into "), children.cast("string"), F.lit(" components."))).otherwise(""),
    )


def described(rows: DataFrame, made: Column, cache: DataFrame | None = None, describer: Callable[[DataFrame], DataFrame] | None = None, key: str = "hash") -> DataFrame:
    """rows with ``description``: the cached one of equal content, else the describer's, else the made one.

    cache: key, description. describer: takes the rows without a cached one and
    gives key, description (a service, a model); what it leaves out is made.
    """
    out = rows.withColumn("_made", made)
    if cache is not None:
        out = out.join(cache.select(key, F.col("description").alias("_known")).dropDuplicates([key]), key, "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("string"))
    if describer is not None:
        told = describer(out.where("_known is null").drop("_made", "_known")).select(key, F.col("description").alias("_told")).dropDuplicates([key])
        out = out.join(told, key, "left")
    else:
        out = out.withColumn("_told", F.lit(None).cast("string"))
    return out.withColumn("description", F.coalesce("_known", "_told", "_made")).drop("_made", "_known", "_told")
