"""Evaluation studies over documents, benchmark passages and the code base made from documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import front, text
from corpusloom.operators import community, evaluate, fusion, graph, metrics, requirements, retrieve, search, stats
from corpusloom.plans import code_queries as cq
from corpusloom.plans import context_queries as xq
from corpusloom.plans import graph_queries as gq
from corpusloom.plans import text_queries as tq
from corpusloom.plans.session import cut, small, table

CONFIGS = {f"adaptive={a} strong={s} tests={t}": retrieve.Settings(adaptive=bool(a), keep_strong=bool(s), drop_tests=not t, expansion="walk") for a in (0, 1) for s in (0, 1) for t in (0, 1)}


def length_summary(spark, d):
    docs = table(spark, d, "documents")
    out = evaluate.summary(docs.select("lang", F.length("text").alias("n")), ["lang"], "n")
    return out.select("lang", F.col("n"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "median", "p90", "max")])


def macro_recall(spark, d):
    return evaluate.macro(tq.judged(spark, d), ["method"], "n_gold", "recall10").withColumn("macro", F.round("macro", 6))


def picked_documents(spark, d):
    """Ten documents, longest first, at most one of each source."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return evaluate.pick_one_each(docs, "source", [F.desc("size"), F.asc("doc_id")], 10)


def random_ranking(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    return evaluate.shuffled(docs, "source", "doc_id").withColumn("rank", F.col("rank").cast("long"))


def anchored_pairs(spark, d):
    r = cut(tq.rankings(spark, d))
    gold = cut(tq.gold(spark, d))
    ranked = r.where("method = 'bm25f'").select("query_id", "doc")
    found = gold.join(ranked, ["query_id", "doc"], "left_semi")
    missed = gold.join(ranked, ["query_id", "doc"], "left_anti")
    pool = r.select("query_id", "doc").distinct().join(gold, ["query_id", "doc"], "left_anti")
    return evaluate.anchored_pairs(found, missed, pool, 3).select(F.col("query_id").alias("item_id"), "kind", "src", "dst")


def _modules(spark, d) -> DataFrame:
    return cq._modules(spark, d).select("i", "path")


def relation_flags(spark, d):
    """Each module with the next one and the one after."""
    f = cut(cq.facts(spark, d))
    e = cut(cq._edges(f))
    m = _modules(spark, d)
    steps = m.select("i", F.col("path").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    pairs = steps.select((F.col("i") + F.col("step")).alias("to"), "src").join(m.select(F.col("i").alias("to"), F.col("path").alias("dst")), "to").select("src", "dst")
    parsed = f.select("path", F.transform("symbols", lambda s: s["name"]).alias("defined"), F.map_keys("refs").alias("words"), "called")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = pairs.select(F.col("src").alias("seed_set"), F.col("src").alias("node")).distinct()
    far = graph.distances(both, seeds, 3).select(F.col("seed_set").alias("src"), F.col("node").alias("dst"), "distance")
    users = e.where(F.col("src").rlike(r"7\.py$")).select(F.col("dst").alias("path"), F.col("src").alias("test"))
    return evaluate.relation_flags(pairs, parsed, e, users, far).withColumn("distance", metrics.distance_bucket(F.col("distance")))


def parse_error_causes(spark, d):
    """Errors of files whose paths and messages follow from their numbers."""
    docs = table(spark, d, "documents").select("doc_id")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("tests/Bad/x", "src/bad/x", "pkg/testing/ok", "lib/syntax"))), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(".py"))
    error = F.element_at(F.array(F.lit("Missing parentheses in call to 'print'"), F.lit("invalid syntax"), F.lit("leading zeros in decimal integer literals are not permitted")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(evaluate.parse_error_cause(path, error).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


def reason_components(spark, d):
    """Items of each part of retrieval, for one task."""
    out = retrieve.gather(*xq._tables(spark, d), "feature", retrieve.Settings(expansion="walk"))
    return out.groupBy(evaluate.component_of(F.col("reason")).alias("component")).agg(F.count("*").alias("n"))


def merged_instances(spark, d):
    """Documents, labels and embeddings by id: what each id has."""
    parts = {
        "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"),
        "labels": table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality")),
        "embeddings": table(spark, d, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.max("label").alias("label")),
    }
    return evaluate.merged(parts, "id")


def seeded_walk(spark, d):
    """The four best documents of a passage, what they depend on within two steps, then the other matches; ten of each passage."""
    docs = tq.documents(spark, d)
    met = search.Meeting(docs, "doc_id", {"metadata": tq.metadata(docs)}, tq.asked(spark, d))
    matches = cut(search.best(met.every({"score": ("bm25", ["metadata"])}), None))
    _, _, edges, _ = xq._tables(spark, d, hits=matches)
    near = graph.distances(edges, matches.where("rank <= 4").select(F.col("query_id").alias("seed_set"), F.col("doc").alias("node")), 2)
    reached = near.select(F.col("seed_set").alias("query_id"), F.col("node").alias("doc"), "distance").join(matches.where("rank <= 4").select("query_id", "doc", F.col("rank").alias("seed")), ["query_id", "doc"], "left")
    head = reached.select("query_id", "doc", F.row_number().over(W.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("seed"), "doc")).alias("rank"))
    candidates = matches.select("query_id", "doc", "rank").unionByName(head.join(matches.select("query_id", "doc"), ["query_id", "doc"], "left_anti").select("query_id", "doc", (F.col("rank") + 1_000_000_000).alias("rank")))
    return tq.named(fusion.complete(head, candidates).where("rank <= 10"))


def ablations(spark, d):
    """Items and recall within ten of eight settings of one task."""
    tables, gold, out = xq._tables(spark, d), cut(tq.gold(spark, d)), None
    for name, settings in CONFIGS.items():
        got = retrieve.gather(*tables, "bug", settings).select("query_id", "doc", "position")
        items = got.agg(F.count("*").alias("items"))
        hits = gold.join(got, ["query_id", "doc"], "left").groupBy("query_id").agg((F.count_if(F.col("position") <= 10) / F.count("*")).alias("r"))
        row = hits.agg(F.round(F.avg("r"), 6).alias("recall10")).join(F.broadcast(items)).select(F.lit(name).alias("config"), "items", "recall10")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def cochange_rankers(spark, d):
    """Seven rankings of files for the best file of each requirement, against the files that implement it."""
    f = cut(cq._described(cq.facts(spark, d)))
    e = cut(cq._edges(f))
    docs = cq._code_fields(f).join(cq.sources(spark, d).select(F.col("path").alias("doc_id"), F.col("text").alias("body")), "doc_id")
    q = requirements.requirements(cq._needs(spark, d)).select("slug", "text")
    met, body = search.Meeting(docs, "doc_id", {"name": docs["name"], "doc": docs["doc"], "body": docs["body"]}, search.query_terms(q, "slug", q["text"])), ["name", "doc", "body"]
    seeds = cut(met.top(search.HOW["bm25f"](body), 1, lambda: met.every({"score": ("bm25f", body)})).select("query_id", F.col("doc").alias("seed")))  # one row a query
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    far = graph.distances(both, seeds.select(F.col("query_id").alias("seed_set"), F.col("seed").alias("node")), 3).select(F.col("seed_set").alias("query_id"), F.col("node").alias("doc"), "distance")
    links = both.join(small(seeds.select(F.col("seed").alias("src")).distinct()), "src", "left_semi").groupBy(F.col("src").alias("seed"), F.col("dst").alias("doc")).agg(F.sum("weight").alias("weight"))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    gold = cq._needed(spark, d, f).select(F.col("slug").alias("query_id"), F.col("path").alias("doc")).join(seeds, "query_id").where("doc <> seed").select("query_id", "doc")
    if met.plain:
        c = met.every({"lexical": ("bm25f", body)}).join(small(seeds.withColumn("seed_dir", folder(F.col("seed")))), "query_id").where("doc <> seed")
        c = c.join(small(far), ["query_id", "doc"], "left").join(small(cut(links)), ["seed", "doc"], "left").withColumn("same_dir", folder(F.col("doc")) == F.col("seed_dir"))
        ranked = evaluate.rankers(c.withColumn("same_part", F.lit(False)).withColumn("same_group", F.col("same_dir")))
    else:
        fact = lambda rows, kind, value: rows.select("query_id", "doc", F.lit(kind).alias("kind"), value.cast("double").alias("value"))
        linked = seeds.join(links, "seed")
        facts = fact(seeds.withColumnRenamed("seed", "doc"), "out", F.lit(0)).unionByName(fact(far, "distance", F.col("distance"))).unionByName(fact(linked, "weight", F.col("weight")))
        folders = {r[0]: r[1] for r in seeds.select("query_id", folder(F.col("seed"))).collect()}  # one row a query
        blocks, numbers = met.blocks({"lexical": ("bm25f", body)}, label=folder(F.col("doc")), labels=folders)
        ranked = evaluate.gold_places(blocks, numbers, "lexical", ["lexical"], facts, gold, evaluate.seven_places)
    methods = spark.createDataFrame([(m,) for m in ("lexical", "same directory", "community", "graph", "random", "hybrid", "fusion")], "method string")
    return metrics.per_query(metrics.gold_ranks(ranked, gold, methods)).groupBy("method").agg(*metrics.means())


def group_names(spark, d):
    """Names of groups of four modules each."""
    m = _modules(spark, d).select(F.expr("i div 4").alias("grp"), F.col("path").alias("node"), F.row_number().over(W.partitionBy(F.expr("i div 4")).orderBy("i")).alias("place"))
    return community.named_groups(m).select("grp", "slug", "hub", F.col("size").cast("long").alias("size"))


def isolated_groups(spark, d):
    f = cq.facts(spark, d)
    links = graph.undirected(cq._edges(f))
    return community.isolated(f.select(F.col("path").alias("node")), links).groupBy("grp").agg(F.count("*").alias("n"))


def community_invariants(spark, d):
    """What holds for any partition found: each node once, groups hang together, no worse than the regions."""
    from corpusloom.plans.more_queries import _links

    links = _links(spark, d)
    m = cut(community.communities(links).select("node", "grp"))
    ours, given = graph.modularity(links, m), graph.modularity(links, gq.regions(spark, d)).withColumnRenamed("modularity", "given")
    parts = graph.disconnected_groups(links, m).agg(F.count("*").alias("disconnected"))
    one = m.agg(F.count("*").alias("nodes"), (F.count("*") == F.count_distinct("node")).alias("once"))
    for more in (ours, given, parts):
        one = one.join(F.broadcast(more))  # one row each
    return one.select("nodes", "once", "disconnected", (F.col("modularity") >= F.col("given")).alias("no_worse"))


def _numbered(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.col("doc_id").cast("string").alias("n"))


def patch_gold(spark, d):
    """Python files that patches touch."""
    i = _numbered(spark, d)
    part = lambda name, suffix: F.concat(F.lit(f"diff --git a/{name}"), "n", F.lit(f"{suffix} b/{name}"), "n", F.lit(f"{suffix}\n--- a/{name}"), "n", F.lit(f"{suffix}\n+++ b/{name}"), "n", F.lit(f"{suffix}\n@@ -1 +1 @@\n-x\n+y\n"))
    patch = F.concat(part("src/a", ".py"), F.when(F.col("i") % 2 == 0, part("doc/b", ".md")).otherwise(part("src/c", ".py")))
    return i.select("i", F.array_join(text.patch_files(patch), ",").alias("files"))


def markdown_parse(spark, d):
    """Front matter, sections and links of documents made from their numbers."""
    i = _numbered(spark, d)
    doc = F.concat(F.lit("---\ntype: Note\ntitle: \"Note "), "n", F.lit("\"\n---\n\n# One\n\nsee [a](/x/"), "n", F.lit(".md) and [b](http://c.d)\n\n# Two\n\nfirst\n\n# Two\n\nlast "), "n", F.lit("\n"))
    front, body = text.front_matter(doc), text.body(doc)
    parts = text.sections(body)
    return i.select("i", text.field(front, "type").alias("type"), text.field(front, "title").alias("title"), parts["One"].alias("one"), parts["Two"].alias("two"), F.array_join(text.markdown_links(body), ",").alias("links"))


def names_and_addresses(spark, d):
    """Slugs, addresses of remotes, absolute names of relative imports and prefixes of paths."""
    i = _numbered(spark, d)
    remote = F.concat(F.element_at(F.array(F.lit("git@host.org:team/repo"), F.lit("https://host.org/team/repo"), F.lit("ssh://git@host.org/team/repo")), (F.col("i") % 3 + 1).cast("int")), "n", F.when(F.col("i") % 2 == 0, ".git").otherwise(""))
    level = (F.col("i") % 3 + 1).cast("int")
    module = text.relative_module(F.concat(F.lit("top.mid.m"), "n"), F.col("i") % 5 == 0, level, F.when(F.col("i") % 4 != 0, F.concat(F.lit("x"), "n")))
    path = F.concat(F.lit("a/b"), "n", F.lit("/c.py"))
    return i.select("i", text.slug(F.concat(F.lit("  The _Name_ No. "), "n", F.lit(" !"))).alias("slug"), text.web_address(remote).alias("address"), module.alias("module"), text.under(path, F.lit("a/b1/")).alias("under"))


def failure_modes(spark, d):
    """Why gold was missed, for cases that follow from their numbers, and buckets of distances."""
    i = F.col("i")
    mode = metrics.failure_class(i % 2 == 0, i % 3 != 0, i % 5 != 0, i % 20, 10, i % 7 == 0)
    far = metrics.distance_bucket(F.when(i % 6 != 5, i % 6))
    return _numbered(spark, d).select(mode.alias("mode"), far.alias("distance")).groupBy("mode", "distance").agg(F.count("*").alias("n"))


def hub_share(spark, d):
    """Share of a walk's mass on the nations with most ways in."""
    e = gq.edges(spark, d)
    mass = graph.walk(graph.transitions(e, *graph.DIRECTIONS["bug"]), gq.seeds(spark, d), gq.ROUNDS, tolerance=None)
    return graph.hub_share(mass, graph.fan(e).select("node", "fan_in")).select("seed_set", F.round("hub_share", 6).alias("hub_share"))


def front_fields(spark, d):
    """Headers of five forms with documents' own first lines as values, read back by path; a malformed one and none give null."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.first_line(F.col("text")).alias("line"))
    n = F.col("doc_id").cast("string")
    quoted = F.regexp_replace(F.to_json(F.array("line")), r"\A\[|\]\z", "")
    single = F.concat(F.lit("'"), F.replace("line", F.lit("'"), F.lit("''")), F.lit("'"))
    flow = F.concat(F.lit("type: Note\ntitle: "), quoted, F.lit("\ntags: "), F.to_json(F.array("lang", "line")), F.lit("\nmeta: {size: "), n, F.lit(", done: true}"))
    block = F.concat(F.lit("# made\ntype: 'Note'  # of one kind\ntitle: "), single, F.lit("\ntags:\n  - "), single, F.lit("\n  - "), quoted, F.lit("\nmeta:\n  size: "), n, F.lit("\n  owner:\n    name: x\n  done: false"))
    plain = F.concat(F.lit("type: Plain\ntitle: Note "), n, F.lit("\ntags:\n- a:b\n- c\nmeta:\n- size: 1\n  done: ~\n- size: "), n)
    broken = F.concat(F.lit("type: Note\ntitle: \"open "), n)
    form = F.element_at(F.array(flow, block, plain, broken), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    header = F.when(F.pmod("doc_id", F.lit(5)) < 4, F.concat(F.lit("---\n"), form, F.lit("\n---\n\nbody"))).otherwise("no header")
    read = docs.select("doc_id", front.front(header).alias("f"))
    return read.select(
        "doc_id", front.value(F.col("f"), "$.type").alias("type"), front.value(F.col("f"), "$.title").alias("title"), F.size(F.coalesce(front.value(F.col("f"), "$.tags", "array<string>"), F.array().cast("array<string>"))).cast("long").alias("tags"),
        front.value(F.col("f"), "$.tags[1]").alias("second"), F.coalesce(front.value(F.col("f"), "$.meta.size", "long"), front.value(F.col("f"), "$.meta[1].size", "long")).alias("size"), front.value(F.col("f"), "$.meta.done", "boolean").alias("done"),
    )


#: Few resamples, so that SQL can draw the same; the statistics are those of returned lines, orders resampled.
SHARED, SHARED_SEED = 40, 3


def bootstrap_shared(spark, d):
    """Intervals of two shares, a mean, a lift and a difference from one set of resamples of the orders."""
    back = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(back * F.col("l_extendedprice")).alias("r"), F.sum("l_extendedprice").alias("t"), F.sum(back).alias("m"), F.count("*").alias("n"))
    price, lines = F.try_divide("r", "t"), F.try_divide("m", "n")
    found = stats.bootstrap(orders, F.col("l_orderkey"), {c: F.col(c) for c in ("r", "t", "m", "n")}, {"share of price": price, "share of lines": lines, "mean price": F.try_divide("t", "n"), "lift": F.try_divide(price, lines), "difference": price - lines}, SHARED, SHARED_SEED)
    return found.select("statistic", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


#: The two settings of search that the loop compares: over metadata documents, and over weighted fields.
SEARCHES = ("metadata", "fields")
METHODS = ["random", "file bm25", "bm25 graph", *[f"{m} [{c}]" for c in SEARCHES for m in ("search", "context by task", "context bug", "fusion context", "fusion search")]]


def _thirteen(every: DataFrame, ways: dict, heads: dict[str, DataFrame]) -> DataFrame:
    """The rankings of all pairs as rows: a row for each pair with its three scores and its places in the heads of rankings, sent once, by query."""
    pairs = every.where("file is not null").select("query_id", "doc", *ways, *[F.lit(None).cast("int").alias(h) for h in heads])
    placed = [r.select("query_id", "doc", *[F.lit(None).cast("double").alias(c) for c in ways], *[F.col("rank").cast("int").alias(h) if h == head else F.lit(None).cast("int").alias(h) for h in heads]) for head, r in heads.items()]
    rows = reduce(DataFrame.unionByName, placed, pairs).repartition("query_id")
    wide = rows.groupBy("query_id", "doc").agg(*[F.max(c).alias(c) for c in (*ways, *heads)]).where("file is not null")
    score = lambda c: F.desc_nulls_last(F.round(c, 9))
    behind = lambda c: F.when(F.col(c).isNull(), F.col("_file bm25"))  # noqa: E731 - what a head has not comes behind it, by file
    fused = lambda m: [F.desc(F.round(1 / (60 + F.col("_file bm25")) + 1 / (60 + F.col(m)), 12)), "_file bm25"]
    orders = {"file bm25": [score("file"), "doc"], "random": [evaluate.random_key("query_id", "doc"), "doc"], "bm25 graph": [F.asc_nulls_last("walk"), "_file bm25"]}
    for name in SEARCHES:
        orders |= {f"search [{name}]": [score(name), behind(name), "doc"], f"context by task [{name}]": [F.asc_nulls_last(f"task {name}"), "_file bm25"], f"context bug [{name}]": [F.asc_nulls_last(f"bug {name}"), "_file bm25"]}
        orders |= {f"fusion context [{name}]": fused(f"_context by task [{name}]"), f"fusion search [{name}]": fused(f"_search [{name}]")}
    for method, order in orders.items():
        wide = wide.withColumn(f"_{method}", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return evaluate.unpivoted(wide, {m: f"_{m}" for m in METHODS})


def _thirteen_places(pairs: dict[str, np.ndarray], given: Callable[[str, float], np.ndarray]) -> dict[str, np.ndarray]:
    """The same of one query, as arrays. pairs: by file."""
    file = np.arange(1, len(pairs["file"]) + 1)
    headed = lambda head: evaluate.places(np.argsort(given(head, np.inf), kind="stable"))  # noqa: E731 - what a head has not comes behind it, by file
    out = {"random": evaluate.random_places(pairs), "file bm25": file, "bm25 graph": headed("walk")}
    for name in SEARCHES:
        found = pairs[name] > 0
        out[f"search [{name}]"] = evaluate.places(np.lexsort((pairs["number"], np.where(found, 0, file), np.where(found, -search.rounded(pairs[name], 9), np.inf))))
        out |= {f"context by task [{name}]": headed(f"task {name}"), f"context bug [{name}]": headed(f"bug {name}")}
        out |= {f"fusion context [{name}]": evaluate.fused_places(file, out[f"context by task [{name}]"]), f"fusion search [{name}]": evaluate.fused_places(file, out[f"search [{name}]"])}
    return out


def evaluation_loop(spark, d):
    """Thirteen rankings of every passage's documents against those that contain it, in one table.

    Candidates are the documents that share a term with the passage; every ranking
    is completed by BM25 over whole texts. The task of a passage is feature for even ids, else bug.
    """
    docs, texts = tq.documents(spark, d), ["name", "doc", "body"]
    met = search.Meeting(docs, "doc_id", tq.fields(docs) | {"metadata": tq.metadata(docs)}, tq.asked(spark, d))
    ways = {"file": ("bm25", ["body"]), "metadata": ("bm25", ["metadata"]), "fields": ("bm25f", texts)}
    apart = xq.tests(table(spark, d, "labels"))
    strong = {name: cut(search.best(met.strong(*ways[name], apart), None)) for name in SEARCHES}
    tables = xq._tables(spark, d, hits=strong["fields"])
    plain = lambda: search.bm25(docs, "doc_id", docs["text"], tq.asked(spark, d))
    first = cut(met.top(search.HOW["bm25"](["body"]), 4, plain, names=["body"]).select("query_id", "doc", F.col("rank").alias("seed")))  # four rows a query
    near = graph.distances(tables[2], first.select(F.col("query_id").alias("seed_set"), F.col("doc").alias("node")), 2)
    reached = near.select(F.col("seed_set").alias("query_id"), F.col("node").alias("doc"), "distance").join(first, ["query_id", "doc"], "left")
    heads = {"walk": reached.select("query_id", "doc", F.row_number().over(W.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("seed"), "doc")).alias("rank"))}
    even = F.pmod("query_id", F.lit(2)) == 0
    for name in SEARCHES:
        parts = {task: cut(retrieve.gather(strong[name], *tables[1:], task, retrieve.Settings(expansion="walk")).select("query_id", "doc", F.col("position").alias("rank"))) for task in ("feature", "bug")}
        heads |= {f"task {name}": parts["feature"].where(even).unionByName(parts["bug"].where(~even)), f"bug {name}": parts["bug"]}
    gold = cut(tq.gold(spark, d))
    if met.plain:
        ranked = _thirteen(met.every(ways), ways, heads)
    else:
        facts = [r.select("query_id", "doc", F.lit(head).alias("kind"), F.col("rank").cast("double").alias("value")) for head, r in heads.items()]
        blocks, numbers = met.blocks(ways)
        ranked = evaluate.gold_places(blocks, numbers, "file", list(ways), reduce(DataFrame.unionByName, facts), gold, _thirteen_places)
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    return metrics.per_query(metrics.gold_ranks(ranked, gold, methods)).groupBy("method").agg(*metrics.means())


QUERIES = {
    f.__name__: f
    for f in (
        length_summary, macro_recall, picked_documents, random_ranking, anchored_pairs, relation_flags, parse_error_causes, reason_components, merged_instances, seeded_walk, ablations,
        cochange_rankers, group_names, isolated_groups, community_invariants, patch_gold, markdown_parse, names_and_addresses, failure_modes, hub_share,
        front_fields, bootstrap_shared, evaluation_loop,
    )
}


def _gather(adaptive: int, strong: int, tests: int) -> str:
    """Items (q, doc, position) of the task bug with the given switches, as CTEs after those of the text ranking."""
    drop = "ANTI JOIN tests USING (doc)" if not tests else ""
    enough = "WHERE score >= 0.5 * top OR rank = 1" if adaptive else ""
    band = "UNION ALL SELECT q, doc, 90 + score / top, 5, rank FROM h ANTI JOIN en USING (q, doc) WHERE score >= 0.5 * top" if strong else ""
    return f"""h0 AS (SELECT q, doc, score, rank FROM rb {drop}),
      h AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank, max(score) OVER (PARTITION BY q) AS top FROM h0),
      en AS (SELECT q, doc, score, rank AS place FROM (SELECT * FROM h {enough}) WHERE rank <= 4),
      br AS (SELECT q, doc, 100 + score AS score, 1 AS branch, place AS at_ FROM en {band} {xq._bfs_sql('src', 'dst', 2, 60)}
             UNION ALL SELECT q, src, 45, 3, place FROM en JOIN ed ON dst = doc SEMI JOIN tests ON tests.doc = src),
      z AS (SELECT q, doc, max(score)::DOUBLE AS score, min((branch, at_)) AS first FROM br {drop} GROUP BY q, doc),
      gt AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, first, doc) AS position FROM z)"""


def _context(p: str, hits: str, task: str) -> str:
    """Items (q, doc, rank) of a task with the walk, from ranked hits, as CTEs with a prefix."""
    own = lambda sql: sql.replace("FROM en", f"FROM {p}en").replace("JOIN en ", f"JOIN {p}en ")
    more = {
        "bug": xq._bfs_sql("src", "dst", 2, 60) + " UNION ALL SELECT q, src, 45, 3, place FROM en JOIN ed ON dst = doc SEMI JOIN tests ON tests.doc = src",
        "feature": xq._FEATURE[xq._FEATURE.index(" UNION ALL SELECT q, dst, 40, 4") : xq._FEATURE.index("), br2 AS")],
    }[task]
    return f"""{p}h AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank, max(score) OVER (PARTITION BY q) AS top FROM {hits} ANTI JOIN tests USING (doc)),
      {p}en AS (SELECT q, doc, score, rank AS place FROM {p}h WHERE rank <= 4 AND (score >= 0.5 * top OR rank = 1)),
      {p}br AS (SELECT q, doc, 100 + score AS score, 1 AS branch, place AS at_ FROM {p}en UNION ALL SELECT q, doc, 90 + score / top, 5, rank FROM {p}h ANTI JOIN {p}en USING (q, doc) WHERE score >= 0.5 * top {own(more)}),
      {p}z AS (SELECT q, doc, max(score)::DOUBLE AS score, min((branch, at_)) AS first FROM {p}br ANTI JOIN tests USING (doc) GROUP BY q, doc),
      {p}gt AS MATERIALIZED (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, first, doc) AS rank FROM {p}z)"""


def _complete(name: str, head: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT f.q, f.doc, row_number() OVER (PARTITION BY f.q ORDER BY h.rank NULLS LAST, f.rank, f.doc) AS rank FROM fb f LEFT JOIN ({head}) h ON h.q = f.q AND h.doc = f.doc)"


def _fused(name: str, other: str) -> str:
    return f"{name} AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(1.0::DOUBLE / (60 + fb.rank) + 1.0::DOUBLE / (60 + o.rank), 12) DESC, fb.rank, doc) AS rank FROM fb JOIN {other} o USING (q, doc))"


def _loop_sql() -> str:
    okapi = tq._BM25.replace(tq._METADATA, "text")
    for name in ("m0", "mtf", "mdf", "a", "ra"):  # CTEs of the same form beside those of the metadata
        okapi = re.sub(rf"\b{name}\b(?! USING)", f"w{name}", okapi) if name != "a" else okapi.replace("\na AS", "\nwa AS").replace("FROM a)", "FROM wa)")
    okapi = okapi.replace("JOIN mdf USING", "JOIN wmdf USING").replace("JOIN m0 USING", "JOIN wm0 USING")
    parts = [_TABLES, tq._BM25, okapi, "fb AS MATERIALIZED (SELECT q, doc, rank FROM wra)", tq._GOLD,
             "ws AS (SELECT q, doc, rank AS seed FROM fb WHERE rank <= 4)", "ww AS (SELECT q, doc, 0 AS d FROM ws UNION ALL SELECT q, dst, 1 FROM ws JOIN ed ON src = doc UNION ALL SELECT q, e2.dst, 2 FROM ws JOIN ed e1 ON e1.src = doc JOIN ed e2 ON e2.src = e1.dst)",
             "wn AS (SELECT q, doc, min(d) AS d FROM ww GROUP BY ALL)", _complete("bg", "SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY d, seed NULLS LAST, doc) AS rank FROM wn LEFT JOIN ws USING (q, doc)"),
             "rd AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY md5('0|' || q || '|' || doc), doc) AS rank FROM fb)"]
    tables = ["rd", "fb", "bg"]
    for p, hits in (("c1", "ra"), ("c2", "rb")):
        parts += [_context(f"{p}f_", hits, "feature"), _context(f"{p}b_", hits, "bug"), _complete(f"{p}s", f"SELECT q, doc, rank FROM {hits}"),
                  _complete(f"{p}t", f"SELECT * FROM {p}f_gt WHERE q % 2 = 0 UNION ALL SELECT * FROM {p}b_gt WHERE q % 2 <> 0"), _complete(f"{p}b", f"SELECT * FROM {p}b_gt"), _fused(f"{p}ft", f"{p}t"), _fused(f"{p}fs", f"{p}s")]
        tables += [f"{p}s", f"{p}t", f"{p}b", f"{p}ft", f"{p}fs"]
    r = " UNION ALL ".join(f"SELECT '{m}' AS method, q, doc, rank FROM {t}" for m, t in zip(METHODS, tables))
    parts += [f"r AS ({r})", "ms AS (SELECT DISTINCT method FROM r)", tq._ALL[tq._ALL.index("gr AS") :].strip()]
    return "WITH " + ", ".join(x.strip().rstrip(",") for x in parts) + f" SELECT method, {tq._MEANS} FROM pq GROUP BY method"


def _poisson_sql(key: str, k: str) -> str:
    """The number of copies that a row draws in a resample."""
    whole, to = "18446744073709551616::UHUGEINT", lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    x = to(f"{key}::UHUGEINT + ({k} + {SHARED * SHARED_SEED})::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT % {whole}")
    steps = f"(SELECT x2 AS x FROM (SELECT {to(f'xor(x1, x1 >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT')} AS x2 FROM (SELECT {to(f'xor(x0, x0 >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT')} AS x1 FROM (SELECT {x} AS x0))))"
    cdf = ", ".join(repr(float(c)) + "::DOUBLE" for c in stats._POISSON)
    return f"(SELECT len(list_filter([{cdf}], lambda c: c <= (xor(x, x >> 31) >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE)) FROM {steps})"


_TABLES = xq._T[: xq._T.index("h0 AS (")].rstrip().rstrip(",")
_ABLATION = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_gather(a, s, t)} SELECT 'adaptive={a} strong={s} tests={t}' AS config, (SELECT count(*) FROM gt) AS items, (SELECT round(avg(r), 6) FROM (SELECT count(*) FILTER (position <= 10) / count(*) AS r FROM gold LEFT JOIN gt USING (q, doc) GROUP BY q)) AS recall10)"
    for a in (0, 1) for s in (0, 1) for t in (0, 1)
)
_BRANCHES = "CASE branch WHEN 1 THEN 'entry' WHEN 5 THEN 'band' WHEN 4 THEN 'walk-dep' WHEN 3 THEN 'extra-subsystem' END"
_FEATURE_ROWS = xq._FEATURE[: xq._FEATURE.index("z AS (")]

SQL = {
    "length_summary": "SELECT lang, count(text) AS n, round(avg(length(text)), 4) AS mean, round(quantile_cont(length(text), 0.5)::DOUBLE, 4) AS median, round(quantile_cont(length(text), 0.9)::DOUBLE, 4) AS p90, max(length(text))::DOUBLE AS max FROM documents GROUP BY lang",
    "macro_recall": f"WITH {tq._EVAL}, mg AS (SELECT method, n_gold, avg(recall10) AS m FROM pq GROUP BY ALL) SELECT method, count(*) AS groups, round(avg(m), 6) AS macro FROM mg GROUP BY method",
    "picked_documents": "SELECT doc_id, source, size FROM (SELECT doc_id, source, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY coalesce(length(text), 0) DESC, doc_id) AS k FROM documents) WHERE k = 1 ORDER BY size DESC, doc_id LIMIT 10",
    "random_ranking": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || source || '|' || doc_id), doc_id) AS rank FROM documents",
    "anchored_pairs": f"""WITH {tq._EVAL}, fo AS (SELECT DISTINCT q, doc FROM gold SEMI JOIN (SELECT * FROM r WHERE method = 'bm25f') x USING (q, doc)), mi AS (SELECT q, doc FROM gold ANTI JOIN (SELECT * FROM r WHERE method = 'bm25f') x USING (q, doc)),
      po AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY md5('0|' || q || '|' || doc), doc) AS k FROM (SELECT DISTINCT q, doc FROM r ANTI JOIN gold USING (q, doc)))
      SELECT q AS item_id, 'gold' AS kind, fo.doc AS src, mi.doc AS dst FROM fo JOIN mi USING (q) UNION ALL SELECT q, 'random', fo.doc, po.doc FROM fo JOIN po USING (q) WHERE k <= 3""",
    "relation_flags": cq._with("""SELECT a.path AS src, b.path AS dst, a.package = b.package AS same_dir, a.package = b.package AS same_pkg, b.i = a.i + 1 AND b.i % 4 <> 0 AS import_edge, false AS name_ref, b.i = a.i + 1 AND b.i % 4 <> 0 AND b.i % 12 <> 11 AS call_ref,
      false AS shared_test, CASE WHEN a.i // 4 = b.i // 4 THEN (b.i - a.i)::VARCHAR ELSE 'unreachable' END AS distance FROM m a JOIN m b ON b.i IN (a.i + 1, a.i + 2)"""),
    "parse_error_causes": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'Intentionally broken test fixtures' WHEN doc_id % 3 IN (0, 2) THEN 'Python 2 syntax' ELSE 'Other' END AS cause, count(*) AS n FROM documents GROUP BY 1",
    "reason_components": f"WITH {_FEATURE_ROWS} w AS (SELECT q, doc, arg_max({_BRANCHES}, (score, -branch, -at_)) AS component FROM br2 GROUP BY q, doc) SELECT component, count(*) AS n FROM w GROUP BY component",
    "merged_instances": """WITH l AS (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY 1), e AS (SELECT vec_id AS id, max(label) AS label FROM embeddings GROUP BY 1), k AS (SELECT doc_id AS id FROM documents UNION SELECT id FROM l UNION SELECT id FROM e)
      SELECT id, d.source AS documents_source, d.doc_id IS NOT NULL AS has_documents, l.quality AS labels_quality, l.id IS NOT NULL AS has_labels, e.label AS embeddings_label, e.id IS NOT NULL AS has_embeddings FROM k LEFT JOIN documents d ON d.doc_id = k.id LEFT JOIN l USING (id) LEFT JOIN e USING (id)""",
    "seeded_walk": f"""WITH {tq._BASE}, {tq._BM25}, mem AS (SELECT source AS grp, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS at_ FROM documents), ed AS (SELECT a.doc AS src, b.doc AS dst FROM mem a JOIN mem b ON a.grp = b.grp AND b.at_ = a.at_ + 1),
      s AS (SELECT q, doc, rank AS seed FROM ra WHERE rank <= 4), w AS (SELECT q, doc, 0 AS d FROM s UNION ALL SELECT q, dst, 1 FROM s JOIN ed ON src = doc UNION ALL SELECT q, e2.dst, 2 FROM s JOIN ed e1 ON e1.src = doc JOIN ed e2 ON e2.src = e1.dst),
      nr AS (SELECT q, doc, min(d) AS d FROM w GROUP BY ALL), hd AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY d, seed NULLS LAST, doc) AS hr FROM nr LEFT JOIN s USING (q, doc)),
      al AS (SELECT q, doc, hr, rank FROM ra FULL JOIN hd USING (q, doc)) SELECT * FROM (SELECT q AS item_id, doc AS doc_id, row_number() OVER (PARTITION BY q ORDER BY hr IS NULL, hr, rank, doc) AS rank FROM al) WHERE rank <= 10""",
    "ablations": f"WITH {_TABLES}, {tq._GOLD} {_ABLATION}",
    "cochange_rankers": f"""WITH {cq._M}, {cq._CODE_FIELDS}, se AS (SELECT q, doc AS seed FROM rb WHERE rank = 1), un AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
      mi AS (SELECT path, i FROM m), ca0 AS (SELECT rb.q, rb.doc, score, regexp_extract(doc, '^(.*)/[^/]*$', 1) = regexp_extract(seed, '^(.*)/[^/]*$', 1) AS same, CASE WHEN a.i // 4 = b.i // 4 THEN abs(a.i - b.i) END AS dist, (SELECT sum(weight) FROM un WHERE src = seed AND dst = doc) AS w
        FROM rb JOIN se USING (q) LEFT JOIN mi a ON a.path = doc LEFT JOIN mi b ON b.path = seed WHERE doc <> seed),
      o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS lx, row_number() OVER (PARTITION BY q ORDER BY same DESC, round(score, 9) DESC, doc) AS sd,
        row_number() OVER (PARTITION BY q ORDER BY CASE WHEN dist IS NOT NULL THEN 0 WHEN same THEN 1 ELSE 2 END, dist NULLS LAST, coalesce(w, 0) DESC, round(score, 9) DESC, doc) AS gp, row_number() OVER (PARTITION BY q ORDER BY md5('0|' || q || '|' || doc), doc) AS rd FROM ca0),
      x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY least(2 * gp - 1, 2 * lx)) AS hy, row_number() OVER (PARTITION BY q ORDER BY round(1.0::DOUBLE / (60 + lx) + 1.0::DOUBLE / (60 + gp), 12) DESC, lx, doc) AS fu FROM o),
      r AS (SELECT 'lexical' AS method, q, doc, lx AS rank FROM x UNION ALL SELECT 'same directory', q, doc, sd FROM x UNION ALL SELECT 'community', q, doc, sd FROM x UNION ALL SELECT 'graph', q, doc, gp FROM x UNION ALL SELECT 'random', q, doc, rd FROM x UNION ALL SELECT 'hybrid', q, doc, hy FROM x UNION ALL SELECT 'fusion', q, doc, fu FROM x),
      gold AS (SELECT slug AS q, path AS doc FROM lk JOIN se ON se.q = slug WHERE path <> seed), ms AS (SELECT DISTINCT method FROM r), gr_ AS (SELECT gold.q, gold.doc, method, rank FROM gold CROSS JOIN ms LEFT JOIN r USING (q, doc, method)),
      pq AS (SELECT q, method, coalesce(1 / min(rank), 0) AS rr, {", ".join(f"count(*) FILTER (rank <= {k}) = count(*) AS acc{k}, count(*) FILTER (rank <= {k}) / count(*) AS recall{k}, count(*) FILTER (rank <= {k}) > 0 AS hit{k}" for k in (5, 10))} FROM gr_ GROUP BY ALL) SELECT method, {tq._MEANS} FROM pq GROUP BY method""",
    "group_names": cq._with("""SELECT grp, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug, hub, size FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY -size, hub) AS k FROM (
      SELECT i // 4 AS grp, CASE WHEN count(DISTINCT package) = 1 THEN lower(regexp_replace(min(package), '[^a-zA-Z0-9]+', '-', 'g')) ELSE 'app' END || '-m' || min(i) AS base, arg_min(path, i) AS hub, count(*) AS size FROM m GROUP BY i // 4))"""),
    "isolated_groups": cq._with("SELECT 'app' AS grp, count(*) AS n FROM f WHERE path NOT IN (SELECT src FROM e) AND path NOT IN (SELECT dst FROM e)"),
    "patch_gold": "SELECT doc_id AS i, 'src/a' || doc_id || '.py' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',src/c' || doc_id || '.py' END AS files FROM documents",
    "markdown_parse": "SELECT doc_id AS i, 'Note' AS type, 'Note ' || doc_id AS title, 'see [a](/x/' || doc_id || '.md) and [b](http://c.d)' AS one, 'last ' || doc_id AS two, '/x/' || doc_id || '.md' AS links FROM documents",
    "names_and_addresses": """SELECT doc_id AS i, 'the-name-no-' || doc_id AS slug, 'https://host.org/team/repo' || doc_id AS address,
      array_to_string(list_concat(['top', 'mid', 'm' || doc_id][:3 - doc_id % 3 - (doc_id % 5 <> 0)::INT], CASE WHEN doc_id % 4 <> 0 THEN ['x' || doc_id] ELSE [] END), '.') AS module, doc_id = 1 AS under FROM documents""",
    "failure_modes": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'recovered' WHEN doc_id % 3 = 0 THEN 'bad seeds' WHEN doc_id % 5 = 0 THEN 'unreachable' WHEN doc_id % 20 > 10 THEN 'outranked' WHEN doc_id % 7 = 0 THEN 'crowded out' ELSE 'other' END AS mode,
      CASE doc_id % 6 WHEN 5 THEN 'unreachable' WHEN 4 THEN '3+' WHEN 3 THEN '3+' ELSE (doc_id % 6)::VARCHAR END AS distance, count(*) AS n FROM documents GROUP BY ALL""",
    "hub_share": f"""WITH {gq._E}, {gq._walk_sql(gq._steps(1.0, 0.5), 's', 0.15)}, fi AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS n FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), li AS (SELECT quantile_cont(n, 0.95) AS l FROM fi)
      SELECT seed_set, round(coalesce(sum(mass) FILTER (n >= l), 0) / sum(mass), 6) AS hub_share FROM r{gq.ROUNDS} LEFT JOIN fi USING (node) CROSS JOIN li GROUP BY seed_set""",
    "front_fields": r"""WITH d AS (SELECT doc_id, doc_id % 5 AS f, coalesce(lang, '') AS lang, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents)
      SELECT doc_id, CASE WHEN f < 2 THEN 'Note' WHEN f = 2 THEN 'Plain' END AS type, CASE WHEN f < 2 THEN line WHEN f = 2 THEN 'Note ' || doc_id END AS title, CASE WHEN f < 3 THEN 2 ELSE 0 END::BIGINT AS tags,
             CASE WHEN f < 2 THEN line WHEN f = 2 THEN 'c' END AS second, CASE WHEN f < 3 THEN doc_id END AS size, CASE f WHEN 0 THEN true WHEN 1 THEN false END AS done FROM d""",
    "bootstrap_shared": f"""WITH o AS (SELECT l_orderkey AS key, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)::DOUBLE AS r, sum(l_extendedprice)::DOUBLE AS t, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS m, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
      w AS (SELECT k, o.*, {_poisson_sql('key', 'k')} AS c FROM o, range({SHARED}) AS s(k)),
      b AS (SELECT k, sum(c * r) AS r, sum(c * t) AS t, sum(c * m) AS m, sum(c * n) AS n FROM w GROUP BY k UNION ALL SELECT -1, sum(r), sum(t), sum(m), sum(n) FROM o),
      s AS (SELECT k, unnest([{{'statistic': 'share of price', 'v': r / t}}, {{'statistic': 'share of lines', 'v': m / n}}, {{'statistic': 'mean price', 'v': t / n}}, {{'statistic': 'lift', 'v': (r / t) / (m / n)}}, {{'statistic': 'difference', 'v': r / t - m / n}}], recursive := true) FROM b)
      SELECT statistic, round(max(v) FILTER (k = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (k >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (k >= 0), 6) AS high FROM s GROUP BY statistic""",
    "evaluation_loop": _loop_sql(),
    "community_invariants": f"WITH {gq._E} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, true AS once, 0::BIGINT AS disconnected, true AS no_worse",
}
