"""Module names, import resolution and the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import prefixes

DEPTH, MOST_REFERENCES = 3, 50


def module_names(files: DataFrame) -> DataFrame:
    """path, module, aliases, is_package of (path). A directory with __init__.py is a package directory."""
    package_dirs = files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("dir")).where("dir <> ''").distinct()
    named = files.select("path", F.col("path").rlike(r"(^|/)__init__\.py$").alias("is_package"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/?__init__$", "").alias("stem"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"))
    above = named.where("dir <> ''").select("path", F.explode(prefixes(F.col("dir"), "/")).alias("p"), F.size(F.split("dir", "/")).alias("depth"))
    known = above.join(package_dirs.withColumnRenamed("dir", "prefix").withColumn("is_pkg_dir", F.lit(True)), F.col("p.prefix") == F.col("prefix"), "left")
    # the deepest directory that is no package ends the dotted name
    start = known.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("is_pkg_dir").isNull(), F.col("p.depth"))), F.lit(0)).alias("start"))
    parts = F.split("stem", "/")
    full = named.join(start, "path", "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("parts", F.when(F.col("stem") == "", F.array().cast("array<string>")).otherwise(parts))
    module = F.array_join(F.slice("parts", F.col("start") + 1, F.greatest(F.size("parts") - F.col("start"), F.lit(0))), ".")
    last = F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit(""))
    dotted = F.array_join("parts", ".")
    out = full.withColumn("module", F.when(module == "", last).otherwise(module))
    src = F.when(F.try_element_at("parts", F.lit(1)) == "src", F.array_join(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), "."))
    aliases = F.array_sort(F.array_distinct(F.filter(F.array(dotted, src), lambda a: a.isNotNull() & (a != "") & (a != F.col("module")))))
    return out.select("path", "module", aliases.alias("aliases"), "is_package")


def module_index(names: DataFrame) -> DataFrame:
    """module, path: canonical names before aliases; of canonical names the last path, of aliases the first."""
    canonical = names.where("module <> ''").groupBy("module").agg(F.max("path").alias("path")).withColumn("kind", F.lit(0))
    aliases = names.select(F.explode("aliases").alias("module"), "path").groupBy("module").agg(F.min("path").alias("path")).withColumn("kind", F.lit(1))
    return canonical.unionByName(aliases).groupBy("module").agg(F.min_by("path", "kind").alias("path"))


def longest_prefix(names: DataFrame, column: str, index: DataFrame, separator: str = ".") -> DataFrame:
    """names' distinct values with the longest prefix that the index (key) has: all prefixes, one equi-join, the deepest."""
    each = names.select(column).distinct().withColumn("p", F.explode(prefixes(F.col(column), separator)))
    hits = each.join(index.select("key"), F.col("p.prefix") == F.col("key"))
    return hits.groupBy(column).agg(F.max_by(F.col("key"), F.col("p.depth")).alias("prefix"))


def reexport_sources(wanted: DataFrame, exports: DataFrame, defined: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, name, source: where a name that a package re-exports is defined.

    wanted: path, name. exports: path, name, target (one hop). defined: path, name.
    At most ``depth`` hops; the last reached target counts if the chain is longer.
    """
    hops = exports.join(defined, ["path", "name"], "left_anti").where("target <> path").groupBy("path", "name").agg(F.min("target").alias("target"))
    state = wanted.select("path", "name", F.col("path").alias("at"), F.lit(None).cast("string").alias("source"))
    for _ in range(depth):
        nxt = state.join(hops.select(F.col("path").alias("at"), "name", "target"), ["at", "name"], "left")
        state = nxt.select("path", "name", F.coalesce("target", "at").alias("at"), F.coalesce("target", "source").alias("source"))
    return state.where("source is not null and source <> path").select("path", "name", "source")


def import_edges(names: DataFrame, imports: DataFrame, references: DataFrame, exports: DataFrame | None = None, defined: DataFrame | None = None) -> DataFrame:
    """src, dst, weight, names.

    imports: path, module, name (null for a plain import), alias. references:
    path, name, n. Weight: 1 + references to the imported names, at most 50 of
    them; a package that only passes names on gets 1 and no names.
    """
    index = module_index(names)
    by_name = imports.where("name is not null")
    sub = by_name.where("name <> '*'").join(index, F.concat_ws(".", by_name["module"], by_name["name"]) == index["module"]).select(by_name["path"].alias("src"), index["path"].alias("dst"), "name")
    packages = by_name.join(index.withColumnRenamed("path", "dst"), "module").select(by_name["path"].alias("src"), "dst", "name")
    packages = packages.join(sub.select("src", "name"), ["src", "name"], "left_anti").select("src", "dst", "name")
    targets, low = sub.unionByName(packages), None
    if exports is not None:
        found = reexport_sources(packages.where("name <> '*'").select(F.col("dst").alias("path"), "name").distinct(), exports, defined)
        through = packages.join(found.select(F.col("path").alias("dst"), "name", "source"), ["dst", "name"]).where("source <> src")
        direct = packages.join(through.select("src", "dst", "name"), ["src", "dst", "name"], "left_anti")
        targets = sub.unionByName(direct.select("src", "dst", "name")).unionByName(through.select("src", F.col("source").alias("dst"), "name"))
        low = through.select("src", "dst").distinct()
    plain = imports.where("name is null")
    hit = longest_prefix(plain, "module", index.select(F.col("module").alias("key")))
    local = F.coalesce("alias", F.element_at(F.split("module", r"\."), -1))
    whole = plain.join(hit, "module").join(index.select(F.col("module").alias("prefix"), F.col("path").alias("dst")), "prefix").select(plain["path"].alias("src"), "dst", local.alias("name"))
    targets = targets.unionByName(whole).where("src <> dst").distinct()
    counted = targets.join(references.select(F.col("path").alias("src"), "name", "n"), ["src", "name"], "left")
    refs = F.sum(F.when(F.col("name") != "*", F.coalesce("n", F.lit(0))).otherwise(0))
    edges = counted.groupBy("src", "dst").agg((1.0 + F.least(refs, F.lit(MOST_REFERENCES))).alias("weight"), F.array_sort(F.collect_set("name")).alias("names"))
    if low is not None:
        extra = low.where("src <> dst").join(edges, ["src", "dst"], "left_anti").select("src", "dst", F.lit(1.0).alias("weight"), F.array().cast("array<string>").alias("names"))
        edges = edges.unionByName(extra)
    return edges


def external_imports(names: DataFrame, imports: DataFrame) -> DataFrame:
    """path, top: first component of modules of which nothing is known."""
    index = module_index(names)
    missing = imports.join(longest_prefix(imports, "module", index.select(F.col("module").alias("key"))), "module", "left_anti")
    return missing.select("path", F.substring_index("module", ".", 1).alias("top")).where("top <> ''").distinct()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
