"""Linked documents of a code base: source files, groups, requirements, indexes and the root.

Every function gives rows (path, type, title, description, tags, body) that
``sources.files.render`` turns into text. Sections that list other documents are
ordered aggregates of joins. Titles of sections and the wording of their lines are
fixed values: what reads the documents (links, weights, symbols) relies on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.describe import plural

#: Most names of an edge, methods of a class, and hot spots that are listed.
NAMES, METHODS, HOT = 8, 25, 8


def link(label: Column, target: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))


def file_path(path: Column) -> Column:
    return F.concat(F.lit("/files/"), path, F.lit(".md"))


def group_path(slug: Column, parent: Column) -> Column:
    return F.concat(F.lit("/subsystems/"), F.when(parent.isNotNull(), F.concat(parent, F.lit("/"))).otherwise(""), slug, F.lit(".md"))


def section(title: str, text: Column, otherwise: str | None = None) -> Column:
    """'# title' and text; without text nothing, or ``otherwise``."""
    body = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.lit(otherwise))
    return F.when(body.isNotNull(), F.concat(F.lit(f"# {title}\n\n"), body))


def bullets(rows: DataFrame, by: str, order: list[Column], line: Column, name: str) -> DataFrame:
    """by, name: the lines of each key in order, as a list."""
    placed = rows.select(by, F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.concat(F.lit("- "), line).alias("line")).alias("l"))
    return placed.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias(name))


def dependencies(edges: DataFrame, near: str, far: str) -> DataFrame:
    """near, place, line for each edge (src, dst, weight, names): heaviest first, then by name."""
    names = F.array_join(F.transform(F.slice("names", 1, NAMES), lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    line = F.concat(link(F.col(far), file_path(F.col(far))), F.lit(": uses "), F.when(F.size("names") > 0, names).otherwise("re-exported names only"), F.lit(" (weight "), F.col("weight").cast("long").cast("string"), F.lit(")"))
    return bullets(edges, near, [-F.col("weight"), F.col(far)], line, "lines").withColumnRenamed(near, "path")


def symbol_lines(symbols: Column) -> Column:
    """A line for each top-level definition, and one for a class's methods."""

    def lines(s: Column) -> Column:
        head = F.when(s["kind"] == "class", F.concat(F.lit("- `class "), s["name"], F.lit("`"))).otherwise(F.concat(F.lit("- `def "), s["name"], F.lit("()`")))
        first = F.concat(head, F.lit(" (L"), s["line"].cast("string"), F.lit(")"), F.when(s["doc"] != "", F.concat(F.lit(": "), s["doc"])).otherwise(""))
        shown = F.array_join(F.transform(F.slice(s["methods"], 1, METHODS), lambda m: F.concat(F.lit("`"), m, F.lit("`"))), ", ")
        second = F.concat(F.lit("  - methods: "), shown, F.when(F.size(s["methods"]) > METHODS, " …").otherwise(""))
        return F.when(F.size(s["methods"]) > 0, F.array(first, second)).otherwise(F.array(first))

    return F.array_join(F.flatten(F.transform(symbols, lines)), "\n")


def source_files(files: DataFrame, edges: DataFrame, externals: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Documents of files.

    files: path, description, symbols, findings, is_test, auth, subsystem, component
    (null without), group_line, loc, centrality, hash. edges: src, dst, weight,
    names. externals: path, top. required: path, title, slug.
    """
    out = files.join(dependencies(edges, "src", "dst").withColumnRenamed("lines", "down"), "path", "left")
    out = out.join(dependencies(edges, "dst", "src").withColumnRenamed("lines", "up"), "path", "left")
    out = out.join(externals.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_set("top")), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ").alias("outside")), "path", "left")
    if required is None:
        out = out.withColumn("needed", F.lit(None).cast("string"))
    else:
        out = out.join(bullets(required, "path", [F.col("slug")], link(F.col("title"), F.concat(F.lit("/requirements/"), "slug", F.lit(".md"))), "needed"), "path", "left")
    rules = F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"] != "info"), lambda f: F.concat(F.lit("security:"), f["rule"]))))
    tags = F.concat(F.array(F.lit("python")), F.when(F.col("is_test"), F.array(F.lit("test"))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("subsystem:"), "subsystem")), F.when(F.col("auth"), F.array(F.lit("area:auth"))).otherwise(F.array().cast("array<string>")), rules)
    notes = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("- L"), f["line"].cast("string"), F.lit(" · **"), f["severity"], F.lit("** · "), f["rule"], F.lit(": "), f["detail"])), "\n")
    body = F.concat_ws(
        "\n\n",
        section("Summary", F.col("description")),
        section("Subsystem", F.col("group_line")),
        section("Symbols", symbol_lines(F.col("symbols"))),
        section("Depends on", F.col("down"), "None."),
        section("Used by", F.col("up"), "None."),
        section("External dependencies", F.col("outside")),
        section("Security notes", notes),
        section("Requirements", F.col("needed")),
    )
    return out.select(file_path(F.col("path")).alias("path"), F.lit("Source File").alias("type"), F.col("path").alias("title"), "description", tags.alias("tags"), body.alias("body"))


def groups(membership: DataFrame, named: DataFrame, files: DataFrame, between: DataFrame) -> DataFrame:
    """Documents of subsystems (level 1) and components (level 2).

    named: slug, level, parent (null at level 1), title, description, size, hub,
    cohesion. membership: slug, path, place. files: path, description, findings.
    between: src, dst (slugs of one level), edges, weight.
    """
    target = group_path(F.col("slug"), F.col("parent"))
    known = named.select("slug", F.col("title").alias("o_title"), target.alias("o_path"))
    members = bullets(membership.join(files, "path"), "slug", [F.col("place")], F.concat(link(F.col("path"), file_path(F.col("path"))), F.lit(": "), F.col("description")), "members")

    def side(near: str, far: str, name: str) -> DataFrame:
        rows = between.join(known.withColumnRenamed("slug", far), far)
        line = F.concat(link(F.col("o_title"), F.col("o_path")), F.lit(": "), F.col("edges").cast("string"), F.lit(" import edges (weight "), F.col("weight").cast("long").cast("string"), F.lit(")"))
        return bullets(rows, near, [-F.col("weight"), F.col(far)], line, name).withColumnRenamed(near, "slug")

    found = membership.join(files.select("path", F.explode("findings").alias("f")).where("f.severity <> 'info'"), "path").groupBy("slug", "f.rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("at"))
    where = F.array_join(F.transform("at", lambda p: link(p, file_path(p))), ", ")
    notes = bullets(found, "slug", [-F.col("n"), F.col("rule")], F.concat(F.col("rule"), F.lit(" ×"), F.col("n").cast("string"), F.lit(": "), where), "notes")
    tags_of = found.groupBy("slug").agg(F.array_sort(F.collect_set(F.concat(F.lit("security:"), "rule"))).alias("flags"))
    child_line = F.concat(link(F.col("title"), target), F.lit(" ("), plural(F.col("size"), "file"), F.lit("): "), F.col("description"))
    children = bullets(named.where("parent is not null").withColumn("of", F.col("parent")), "of", [F.col("slug")], child_line, "children").withColumnRenamed("of", "slug")
    up = named.where("parent is not null").select("slug", F.col("parent").alias("p")).join(known.select(F.col("slug").alias("p"), link(F.col("o_title"), F.col("o_path")).alias("up")), "p").drop("p")
    out = named
    for part in (members, side("src", "dst", "down"), side("dst", "src", "use"), notes, tags_of, children, up):
        out = out.join(part, "slug", "left")
    label = F.when(F.col("level") == 1, "subsystems").otherwise("sibling components")
    peers = lambda title, text: F.concat(F.lit(f"# {title} "), label, F.lit("\n\n"), F.coalesce(text, F.lit("None.")))
    body = F.concat_ws(
        "\n\n",
        section("Summary", F.col("description")),
        section("Parent", F.col("up")),
        section("Components", F.col("children")),
        section("Members", F.concat(F.lit("Ranked by centrality in the dependency graph.\n\n"), "members")),
        peers("Depends on", F.col("down")),
        peers("Used by", F.col("use")),
        section("Security notes", F.col("notes")),
    )
    kind = F.when(F.col("level") == 1, "Subsystem").otherwise("Component")
    tags = F.concat(F.array(F.lower(kind)), F.coalesce("flags", F.array().cast("array<string>")))
    return out.select(target.alias("path"), kind.alias("type"), "title", "description", tags.alias("tags"), body.alias("body"))


def requirement_docs(required: DataFrame, links: DataFrame) -> DataFrame:
    """Documents of requirements (slug, title, description, text) with the files (slug, path, reasons) that implement them, best matched first."""
    line = F.concat(link(F.col("path"), file_path(F.col("path"))), F.lit(" (matched: "), F.array_join("reasons", ", "), F.lit(")"))
    by = bullets(links, "slug", [-F.size("reasons"), F.col("path")], line, "lines")
    deeper = F.regexp_replace("text", r"(?m)^(#+)", "#$1")
    body = F.concat_ws("\n\n", section("Implemented by", F.col("lines"), "No code matched yet."), section("Text", deeper))
    return required.join(by, "slug", "left").select(F.concat(F.lit("/requirements/"), "slug", F.lit(".md")).alias("path"), F.lit("Requirement").alias("type"), "title", "description", F.array(F.lit("requirement")).alias("tags"), body.alias("body"))


def directory_indexes(files: DataFrame) -> DataFrame:
    """An index of each directory: its files (path, description) and directories."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("dir"), F.array_join(F.slice(parts, 1, n), "/").alias("child"), parts[n - 1].alias("label"), (n == F.size(parts)).alias("leaf")))
    each = files.select("description", F.explode(steps).alias("s")).select("s.*", F.when(F.col("s.leaf"), F.col("description")).alias("description")).distinct()
    line = F.when(F.col("leaf"), F.concat(link(F.col("label"), file_path(F.col("child"))), F.lit(": "), F.col("description"))).otherwise(link(F.concat("label", F.lit("/")), F.concat(F.lit("/files/"), "child", F.lit("/index.md"))))
    lists = bullets(each, "dir", [F.col("child")], line, "lines")
    at_top = F.col("dir") == ""
    path = F.when(at_top, "/files/index.md").otherwise(F.concat(F.lit("/files/"), "dir", F.lit("/index.md")))
    return lists.select(path.alias("path"), F.lit("Index").alias("type"), F.concat(F.lit("Files in "), F.when(at_top, "/").otherwise(F.col("dir"))).alias("title"), F.concat(F.lit("Source files under "), F.when(at_top, "the repository root").otherwise(F.col("dir")), F.lit(".")).alias("description"), F.array().cast("array<string>").alias("tags"), section("Contents", F.col("lines")).alias("body"))


def group_index(named: DataFrame) -> DataFrame:
    """The index of all subsystems, larger ones first."""
    top = named.where("level = 1")
    line = F.concat(link(F.col("title"), group_path(F.col("slug"), F.col("parent"))), F.lit(" ("), plural(F.col("size"), "file"), F.lit(", cohesion "), F.col("cohesion").cast("string"), F.lit("): "), F.col("description"))
    one = bullets(top.withColumn("all", F.lit(1)), "all", [-F.col("size"), F.col("slug")], line, "lines")
    n = top.agg(F.count("*").alias("n"))
    return one.join(F.broadcast(n)).select(F.lit("/subsystems/index.md").alias("path"), F.lit("Index").alias("type"), F.lit("Subsystems").alias("title"), F.concat(plural(F.col("n"), "subsystem"), F.lit(" found by community detection on the import graph.")).alias("description"), F.array().cast("array<string>").alias("tags"), section("Subsystems", F.col("lines")).alias("body"))  # one row each


def root(name: str, files: DataFrame, edges: DataFrame, named: DataFrame, digest: DataFrame) -> DataFrame:
    """The entry document: counts, subsystems, what did not parse, and the files with most severe findings."""
    totals = files.agg(F.count("*").alias("files")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(named.agg(F.count_if(F.col("level") == 1).alias("subsystems"), F.count_if(F.col("level") == 2).alias("components"))))
    line = F.concat(link(F.col("title"), group_path(F.col("slug"), F.col("parent"))), F.lit(" ("), plural(F.col("size"), "file"), F.lit("): "), F.col("description"))
    subsystems = bullets(named.where("level = 1").withColumn("all", F.lit(1)), "all", [-F.col("size"), F.col("slug")], line, "subs")
    broken = bullets(files.where("parse_error is not null").withColumn("all", F.lit(1)), "all", [F.col("path")], F.concat(link(F.col("path"), file_path(F.col("path"))), F.lit(" · parser: "), F.col("parser"), F.lit(" · "), F.col("parse_error")), "unparsed")
    high = F.filter("findings", lambda f: f["severity"] == "high")
    hot = files.select("path", F.size(high).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform(high, lambda f: f["rule"]))), ", ").alias("rules")).where("n > 0").orderBy(F.desc("n"), "path").limit(HOT)
    hot = bullets(hot.withColumn("all", F.lit(1)), "all", [-F.col("n"), F.col("path")], F.concat(link(F.col("path"), file_path(F.col("path"))), F.lit(": "), F.col("rules")), "hot")
    one = totals.withColumn("all", F.lit(1))
    for part in (subsystems, broken, hot):
        one = one.join(part, "all", "left")
    one = one.join(F.broadcast(digest))  # one row
    overview = F.concat(F.lit(f"`{name}`: "), plural(F.col("files"), "Python file"), F.lit(", "), plural(F.col("edges"), "internal import edge"), F.lit(", "), plural(F.col("subsystems"), "subsystem"), F.lit(" ("), plural(F.col("components"), "component"), F.lit(")."))
    body = F.concat_ws("\n\n", section("Overview", overview), section("Subsystems", F.col("subs")), section("Parse failures", F.col("unparsed")), section("Security hotspots", F.col("hot")))
    return one.select(F.lit("/index.md").alias("path"), F.lit("Index").alias("type"), F.lit(name).alias("title"), F.concat(F.lit(f"Code knowledge of {name}, digest "), "digest", F.lit(".")).alias("description"), F.array().cast("array<string>").alias("tags"), body.alias("body"))


def pack_text(packed: DataFrame, head: Column) -> DataFrame:
    """query_id, text: a head and the packed blocks (query_id, position, block, packed) in order, and how many were left out."""
    rows = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("packed"), F.struct("position", "block")))).alias("b"), F.count_if(~F.col("packed")).alias("out"))
    left = F.when(F.col("out") > 0, F.concat(F.lit("_"), plural(F.col("out"), "lower-ranked item"), F.lit(" omitted to fit the budget._")))
    return rows.select("query_id", F.concat(F.concat_ws("\n\n", head, F.lit("## Relevant files"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), left), F.lit("\n")).alias("text"))
