"""From a code tree to published documents, and from those to context for a task."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import facts as facts_
from corpusloom.functions.text import area_tag, is_test_path, relative_module, sections
from corpusloom.operators import community, describe, graph, incremental, modules, render, requirements, retrieve, search, segments
from corpusloom.plans.session import cut
from corpusloom.sources import files, git

#: Rounds of PageRank, which only orders the members of groups here.
ROUNDS = 25
DEFAULTS = {"docs": None, "exclude": [], "max_size": community.MOST_MEMBERS}


def describe_files(f: DataFrame, names: DataFrame) -> DataFrame:
    out = f.join(names, "path").withColumn("is_test", is_test_path(F.col("path")))
    made = describe.of_file(F.col("path"), F.col("module"), F.col("doc_full"), F.col("symbols"), F.col("is_test"), F.col("is_package"), F.col("parser"), F.col("parse_error"))
    return describe.described(out, made, key="sha").withColumn("auth", area_tag(F.concat_ws(" ", "path", F.transform("symbols", lambda s: s["name"]))))


def group(f: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(slug, path, place of both levels; named groups): communities, large ones cut once more, files without links by directory."""
    links = cut(graph.undirected(edges).withColumn("graph", F.lit("0")))
    found = cut(community.hierarchy(links, most))
    loose = community.isolated(f.select(F.col("path").alias("node")), links)
    rank = cut(graph.pagerank(links, f.select(F.col("path").alias("node")), rounds=ROUNDS, tolerance=None))
    top = found.where("level = 1").select("node", F.concat(F.lit("c"), F.col("grp").cast("string")).alias("grp"))
    top = top.withColumn("unlinked", F.lit(False)).unionByName(loose.select("node", F.concat(F.lit("d"), "grp").alias("grp"), F.lit(True).alias("unlinked")))
    ranked = cut(community.ranked(top, rank))
    named = community.named_groups(ranked, F.col("unlinked"))
    up = ranked.join(named.select("grp", "slug"), "grp").select("node", "slug")
    low = found.where("level = 2").select("node", F.col("graph").alias("parent"), F.col("grp"))
    low = low.join(up.withColumnRenamed("slug", "parent_slug"), "node").select("node", "parent_slug", F.concat_ws("/", "parent_slug", F.col("grp").cast("string")).alias("grp"))
    whole = low.groupBy("parent_slug").agg(F.count_distinct("grp").alias("n")).where("n > 1").select("parent_slug")
    low = cut(community.ranked(low.join(whole, "parent_slug"), rank))
    sub = community.named_groups(low, prefix=F.concat("parent_slug", F.lit("--")))
    parents = low.select("grp", F.col("parent_slug").alias("parent")).distinct()
    all_named = named.withColumn("level", F.lit(1)).withColumn("parent", F.lit(None).cast("string")).unionByName(sub.join(parents, "grp").withColumn("level", F.lit(2)))
    placed = ranked.select("grp", "node", "place").unionByName(low.select("grp", "node", "place"))
    members = cut(placed.join(all_named.select("grp", "slug", "level", "parent"), "grp").select("slug", "level", "parent", F.col("node").alias("path"), "place"))
    return members, cut(all_named.drop("grp"))


def documents(spark: SparkSession, tree: DataFrame, needs: DataFrame | None, most: int, name: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, facts, one row of statistics) of a code tree (path, content)."""
    f = cut(facts_.cached_facts(tree, cache))
    names = modules.module_names(f.select("path"))
    d = cut(describe_files(f, names))
    said = f.select("path", F.explode("imports").alias("m")).join(names.select("path", F.col("module").alias("own"), "is_package"), "path")
    whole = F.when(F.col("m.level") > 0, relative_module(F.col("own"), F.col("is_package"), F.col("m.level"), F.col("m.module"))).otherwise(F.col("m.module"))
    rows = cut(said.select("path", whole.alias("module"), "m.alias", F.explode_outer("m.names").alias("name")))
    edges = cut(modules.import_edges(names, rows, f.select("path", F.explode("refs").alias("name", "n"))))
    outside = modules.external_imports(names, rows.select("path", "module").distinct())
    members, groups_ = group(d, edges, most)
    children = members.where("level = 2").groupBy(F.col("parent").alias("slug")).agg(F.count_distinct("slug").alias("children"))
    of = members.join(d.select("path", "is_test", "doc"), "path").groupBy("slug").agg(F.count_if("is_test").alias("tests"), F.min_by("doc", "place").alias("hub_doc"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "path")))).alias("first"))
    fit = graph.cohesion(graph.undirected(edges), members.where("level = 1").select(F.col("path").alias("node"), F.col("slug").alias("grp"))).select(F.col("grp").alias("slug"), "cohesion")
    about = describe.of_group(F.col("size"), F.col("tests"), F.col("hub"), F.transform("first", lambda x: x["path"]), F.col("hub_doc"), F.coalesce("children", F.lit(0)))
    named = groups_.join(of, "slug").join(children, "slug", "left").join(fit, "slug", "left").select("slug", "level", "parent", F.col("slug").alias("title"), about.alias("description"), "size", "hub", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "loose")
    named = cut(named)
    pairs = None
    for level in (1, 2):
        m = members.where(F.col("level") == level).select(F.col("path").alias("node"), F.col("slug").alias("grp"))
        part = graph.group_edges(edges, m).where("src_group <> dst_group").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst"), "edges", "weight")
        pairs = part if pairs is None else pairs.unionByName(part)
    home = members.where("level = 1").select("path", F.col("slug").alias("subsystem")).join(members.where("level = 2").select("path", F.col("slug").alias("component")), "path", "left")
    at = lambda slug, parent: render.link(slug, render.group_path(slug, parent))
    line = F.concat(F.lit("Part of "), at(F.col("subsystem"), F.lit(None).cast("string")), F.when(F.col("component").isNotNull(), F.concat(F.lit(", component "), at(F.col("component"), F.col("subsystem")))).otherwise(""), F.lit("."))
    placed = d.join(home, "path", "left").withColumn("group_line", line)
    n_needs = 0
    required = linked = None
    if needs is not None:
        required = cut(requirements.requirements(needs))
        n_needs = required.count()
        linked = cut(requirements.links(required, d.select("path", "module", F.transform("symbols", lambda s: s["name"]).alias("symbols"), "is_test")))
    docs = render.source_files(placed, edges, outside, linked.join(required.select("slug", "title"), "slug") if linked is not None else None)
    docs = docs.unionByName(render.groups(members.select("slug", "path", "place"), named, d, pairs)).unionByName(render.directory_indexes(d)).unionByName(render.group_index(named))
    if required is not None:
        docs = docs.unionByName(render.requirement_docs(required, linked))
    docs = docs.unionByName(render.root(name, d, edges, named, incremental.digest(f, [], "path", "sha").select("digest")))
    severe = F.size(F.filter("findings", lambda x: x["severity"] != "info"))
    stats = f.agg(F.count("*").alias("files"), F.count("parse_error").alias("parse_errors"), F.count_if(F.col("parser") == "tokens").alias("parser_fallbacks"), F.count_if(F.col("parser") == "failed").alias("parse_failed"), F.sum(severe).alias("security_findings"), F.sum("loc").alias("loc"))
    groups_count = named.agg(F.count_if(F.col("level") == 1).alias("subsystems"), F.count_if(F.col("level") == 2).alias("components"), F.count_if(F.col("loose")).alias("unlinked_groups"))
    disconnected = graph.disconnected_groups(graph.undirected(edges), members.join(named.where("not loose").select("slug"), "slug").where("level = 1").select(F.col("path").alias("node"), F.col("slug").alias("grp"))).agg(F.count("*").alias("disconnected_communities"))
    for more in (edges.agg(F.count("*").alias("edges")), groups_count, disconnected):
        stats = stats.join(F.broadcast(more))  # one row each
    return docs, f, stats.withColumn("requirements", F.lit(n_needs))


def scan(spark: SparkSession, root: str, out: str, dry_run: bool = False, tree: DataFrame | None = None, **given) -> tuple[DataFrame, DataFrame]:
    """(changes, statistics): publishes the documents of a code tree at ``out``. Options not given are those of the last scan.

    tree: path, content of the sources, where they are not those below the root.
    """
    began = time.monotonic()
    options = files.sticky_options(spark, f"{out}/options.json", DEFAULTS, given)
    tree = files.code_tree(spark, root, tuple(options["exclude"])) if tree is None else files.sources_only(tree, tuple(options["exclude"]))
    needs = files.requirement_texts(spark, f"{root}/{options['docs']}") if options["docs"] else None
    cache_name = files.read_text(spark, f"{out}/facts/CURRENT")
    cache = spark.read.parquet(f"{out}/facts/{cache_name}") if cache_name else None
    docs, f, stats = documents(spark, tree, needs, options["max_size"], root.rstrip("/").rsplit("/", 1)[-1], cache)
    docs = cut(docs)
    text = files.render(docs, ["type", "title", "description", "tags"])
    changes = files.publish(docs.drop("body").join(text, "path"), f"{out}/documents", dry_run)
    if not dry_run:
        files.replace_table(f, f"{out}/facts")
        published = files.current_table(spark, f"{out}/documents", files.PUBLISHED)
        searchable = _searchable(published)
        digest = incremental.digest(published, [], "path", "hash").first()["digest"]
        segments.refresh(searchable, "path", _fields(searchable), f"{out}/index", digest)
    changed = changes.agg(F.count_if(F.col("status") != "removed").alias("changed_documents"))
    stats = stats.join(F.broadcast(docs.agg(F.count("*").alias("documents")))).join(F.broadcast(changed))  # one row each
    stats = stats.join(F.broadcast(facts_.cache_hits(tree, cache)))  # one row
    return changes, stats.withColumn("seconds_total", F.lit(round(time.monotonic() - began, 3)))


def code_tag() -> str:
    """Twelve digits of the hash of this package's sources, so that what it has made is known to be of this code."""
    place = Path(__file__).parents[1]
    digest = hashlib.sha256()
    for path in sorted(place.rglob("*.py")):
        digest.update(f"{path.relative_to(place)}\0".encode() + path.read_bytes())
    return digest.hexdigest()[:12]


def bundle(spark: SparkSession, repo: str, commit: str, store: str, **given) -> tuple[str, bool, dict]:
    """(folder, whether it was there, statistics of its scan) of the documents of a repository's commit.

    Kept by repository, commit, this package's code and the options. A folder counts once
    its scan is written down at its end, so one that was broken off is made again.
    """
    sha = git.resolved(repo, commit)
    name = repo.rstrip("/").rsplit("/", 1)[-1]
    options = hashlib.sha256(json.dumps(given, sort_keys=True).encode()).hexdigest()[:8]
    folder = f"{store}/{name}__{sha[:12]}__{code_tag()}__{options}"
    kept = files.read_text(spark, f"{folder}/STATS")
    if kept is not None:
        return folder, True, json.loads(kept)
    _, stats = scan(spark, repo, folder, tree=files.git_tree(spark, repo, sha), **given)
    row = stats.first().asDict()
    files.write_text(spark, f"{folder}/STATS", json.dumps(row | {"commit": sha}, sort_keys=True))
    return folder, False, row | {"commit": sha}


def check(spark: SparkSession, root: str, out: str) -> bool:
    """Whether the published documents are what a scan would make now."""
    changes, _ = scan(spark, root, out, dry_run=True)
    return changes.isEmpty()


def _searchable(published: DataFrame) -> DataFrame:
    return published.where(F.col("type").isin("Source File", "Requirement")).withColumn("parts", sections(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")))


def _fields(docs: DataFrame) -> dict:
    said = lambda name: F.coalesce(F.try_element_at(docs["parts"], F.lit(name)), F.lit(""))
    symbols = F.array_join(F.regexp_extract_all(said("Symbols"), F.lit(r"`(?:class |def )(\w+)"), 1), " ")
    return {"name": F.concat_ws(" ", docs["title"], symbols), "doc": F.concat_ws(" ", docs["description"], F.array_join(docs["tags"], " ")), "body": F.concat_ws(" ", said("Symbols"), said("Text"))}


def context(spark: SparkSession, out: str, queries: DataFrame, task: str, budget: int = 16000, settings: retrieve.Settings = retrieve.Settings()) -> DataFrame:
    """query_id, text: the context pack of each query (query_id, text) from the published documents and their index."""
    published = cut(files.current_table(spark, f"{out}/documents", files.PUBLISHED))
    digest = incremental.digest(published, [], "path", "hash").first()["digest"]
    docs = _searchable(published)
    asked = search.query_terms(queries, "query_id", queries["text"])
    found = segments.scores(spark, f"{out}/index", asked) if segments.usable(spark, f"{out}/index", digest) else None
    found = search.search(docs, "path", _fields(docs), asked) if found is None else found
    hits = cut(search.best(found, None))
    rows = published.where("type = 'Source File'")
    weights = rows.select("path", F.explode(F.regexp_extract_all(F.coalesce(F.try_element_at(sections(F.col("text")), F.lit("Depends on")), F.lit("")), F.lit(r"(\]\(/[^)\s]+\)[^\n]*\(weight \d+\))"), 1)).alias("line"))
    edges = weights.select(F.col("path").alias("src"), F.regexp_extract("line", r"\]\((/[^)\s]+)\)", 1).alias("dst"), F.regexp_extract("line", r"\(weight (\d+)\)", 1).cast("double").alias("weight"))
    edges = cut(edges.join(rows.select(F.col("path").alias("dst")), "dst", "left_semi"))
    subs = rows.select(F.col("path").alias("doc"), F.explode("tags").alias("t")).where(F.startswith("t", F.lit("subsystem:"))).select("doc", F.substr("t", F.lit(11)).alias("grp"))
    fan = graph.fan(edges).select(F.col("node").alias("doc"), "fan_in")
    concepts = rows.select(F.col("path").alias("doc"), "tags").join(fan, "doc", "left").na.fill(0, ["fan_in"])
    members = subs.join(fan, "doc", "left").withColumn("at", F.row_number().over(W.partitionBy("grp").orderBy(F.desc_nulls_last("fan_in"), "doc"))).select("grp", "doc", "at")
    needs = published.where("type = 'Requirement'").select(F.col("path").alias("doc"), F.posexplode(F.regexp_extract_all(F.coalesce(F.try_element_at(sections(F.col("text")), F.lit("Implemented by")), F.lit("")), F.lit(r"\]\((/files/[^)\s]+)\)"), 1)).alias("at", "target"))
    got = retrieve.gather(hits, concepts, edges, members, task, settings, cut(needs))
    shown = F.array_join(F.slice(F.split(F.coalesce(F.try_element_at(sections(F.col("text")), F.lit("Symbols")), F.lit("")), "\n"), 1, 10), "\n")
    block = F.concat(F.lit("### "), "title", F.lit("  \n*"), "reason", F.lit("*\n\n"), "description", F.when(shown != "", F.concat(F.lit("\n\nSymbols:\n"), shown)).otherwise(""))
    items = got.join(published.select(F.col("path").alias("doc"), "title", "description", "text"), "doc").select("query_id", "doc", "position", block.alias("block")).withColumn("size", F.length("block"))
    packed = retrieve.pack(items.select("query_id", "doc", "position", "size"), budget).join(items.select("query_id", "position", "block"), ["query_id", "position"])
    texts = queries.select("query_id", F.col("text").alias("query"))
    out_rows = render.pack_text(packed, F.lit("# Context pack"))
    return out_rows.join(texts, "query_id").select("query_id", F.concat(F.lit(f"- Task: {task}\n- Query: "), "query", F.lit("\n\n"), "text").alias("text"))
