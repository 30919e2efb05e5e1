"""A code base made from the documents table, one module for each document, and queries over it.

Module i lies in the package of its document's source, imports the function of
module i - 1 (if i is not divisible by 4) and breaks one of the ten rules or, for
i mod 12 = 11, does not parse. So facts, edges, findings and the documents made
from them are known in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import facts as facts_
from corpusloom.functions.text import area_tag, content_hash, first_line, is_test_path
from corpusloom.operators import describe, graph, incremental, modules, readback, render, requirements, retrieve, search
from corpusloom.plans import text_queries as tq
from corpusloom.plans.session import cut, table
from corpusloom.sources.files import render as rendered

SNIPPETS = [
    'token = "abcdefgh12345"',
    "eval(x)",
    "os.system(x)",
    "subprocess.run(x, shell=True)",
    "subprocess.run(x)",
    "pickle.loads(x)",
    "yaml.load(x)",
    "h.md5(x)",
    "tempfile.mktemp()",
    'x.execute(f"select {x}")',
    "requests.get(x, verify=False)",
    "return (",
]


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """i, package, path, j and other (the imported module's number and package, or null)."""
    docs = table(spark, d, "documents").groupBy(F.col("doc_id").alias("i")).agg(F.min(F.coalesce("source", F.lit("none"))).alias("package"))
    other = docs.select((F.col("i") + 1).alias("i"), F.col("i").alias("j"), F.col("package").alias("other"))
    joined = docs.join(other, "i", "left")
    alone = F.col("i") % 4 == 0
    path = F.concat(F.lit("app/"), "package", F.lit("/m"), F.col("i").cast("string"), F.lit(".py"))
    return joined.select("i", "package", path.alias("path"), F.when(~alone, F.col("j")).alias("j"), F.when(~alone, F.col("other")).alias("other"))


def _text() -> Column:
    i, j = F.col("i").cast("string"), F.col("j").cast("string")
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("i") % 12 + 1).cast("int"))
    lines = [
        F.when(F.col("i") % 5 == 0, "# no docs").otherwise(F.concat(F.lit('"""Handles item '), i, F.lit('."""'))),
        F.lit("import hashlib as h"),
        F.lit("import os, subprocess, pickle, yaml, tempfile, requests"),
        F.when(F.col("j").isNull(), "# alone").otherwise(F.concat(F.lit("from app."), "other", F.lit(".m"), j, F.lit(" import f"), j, F.lit(" as g"))),
        F.lit(""),
        F.concat(F.lit("class C"), i, F.lit(":")),
        F.concat(F.lit('    """Keeps '), i, F.lit('."""')),
        F.lit("    def __init__(self): pass"),
        F.when(F.col("j").isNull(), "    def run(self): return 1").otherwise(F.concat(F.lit("    def run(self): return g(f"), j, F.lit(", 1)"))),
        F.lit("    def __len__(self): return 0"),
        F.lit(""),
        F.concat(F.lit("def f"), i, F.lit("(x):")),
        F.concat(F.lit("    "), snippet),
    ]
    return F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n"))


def sources(spark, d) -> DataFrame:
    """path, text, content of all modules and package initializers."""
    m = _modules(spark, d)
    inits = m.select("package").distinct().select(F.concat(F.lit("app/"), "package", F.lit("/__init__.py")).alias("path"), F.concat(F.lit('"""Package '), "package", F.lit('."""\n')).alias("text"))
    top = spark.createDataFrame([("app/__init__.py", "")], "path string, text string")
    return m.select("path", _text().alias("text")).unionByName(inits).unionByName(top).withColumn("content", F.encode("text", "UTF-8"))


def facts(spark, d) -> DataFrame:
    # small rows come out of a join in one part, and each is parsed
    return cut(facts_.facts(sources(spark, d).repartition(spark.sparkContext.defaultParallelism)))


def code_parse(spark, d):
    out = facts(spark, d)
    return out.select("path", "parser", "loc", "doc", F.col("parse_error").isNotNull().alias("failed"), F.size("imports").cast("long").alias("imports"), F.size("symbols").cast("long").alias("symbols"))


def code_findings(spark, d):
    return facts(spark, d).select("path", F.explode("findings").alias("f")).select("path", F.col("f.line").cast("long").alias("line"), "f.rule", "f.severity", "f.detail")


#: Forms of the rules and near misses: a statement, and the rule, severity and name that are found in it.
FORMS = [
    ("sp.run(x, shell=True)", "shell-exec", "high", "subprocess.run"),
    ('sp.run(x, shell="True")', "process-exec", "info", "subprocess.run"),
    ("sp.Popen(x, shell=False)", "process-exec", "info", "subprocess.Popen"),
    ("run_it(x)", "shell-exec", "high", "os.system"),
    ("run(x)", "process-exec", "info", "subprocess.run"),
    ("yl(x)", "unsafe-yaml", "medium", "yaml.load"),
    ("yaml.load(x, Loader=yaml.SafeLoader)", None, None, None),
    ("yaml.safe_load(x)", None, None, None),
    ('requests.get(x, verify="False")', None, None, None),
    ("requests.get(x, verify=False)", "tls-verify-disabled", "high", "requests.get"),
    ("md5(x)", "weak-hash", "medium", "hashlib.md5"),
    ("hashlib.sha256(x)", None, None, None),
    ("p.load(x)", "unsafe-deserialization", "high", "pickle.load"),
    ('c.execute("select %s" % x)', "sql-string-building", "high", "c.execute"),
    ('c.execute("select ?", (x,))', None, None, None),
    ('c.execute("a {}".format(x))', "sql-string-building", "high", "c.execute"),
    ('password = "short"', None, None, None),
    ('password = "two words here"', None, None, None),
    ('self.api_key = "abcdefghij"', "hardcoded-secret", "high", "self.api_key"),
    ("evaluate(x)", None, None, None),
    ("tempfile.mktemp()", "insecure-tempfile", "medium", "tempfile.mktemp"),
    ("tempfile.mkstemp()", None, None, None),
    ("exec(x)", "dynamic-code-exec", "high", "exec"),
    ("obj.eval(x)", None, None, None),
    ('c.executemany("a" + x)', "sql-string-building", "high", "c.executemany"),
]


def code_rule_forms(spark, d):
    """Findings in modules with one form of a rule or a near miss each, imported under other names, behind a docstring from a document's first line."""
    docs = table(spark, d, "documents").select("doc_id", first_line(F.col("text")).alias("line"))
    form = F.element_at(F.array(*[F.lit(f[0]) for f in FORMS]), (F.pmod("doc_id", F.lit(len(FORMS))) + 1).cast("int"))
    quoted = F.regexp_replace(F.to_json(F.array("line")), r"\A\[|\]\z", "")
    imports = "import hashlib, os, pickle as p, subprocess as sp, tempfile, yaml, requests\nfrom os import system as run_it\nfrom subprocess import run\nfrom yaml import load as yl\nfrom hashlib import md5\n"
    source = F.concat(quoted, F.lit("\n" + imports + "\n\ndef f(x, c, self, obj):\n    "), form, F.lit("\n"))
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.encode(source, "UTF-8").alias("content"))
    found = facts_.facts(files).select("path", "parser", F.explode_outer("findings").alias("f"))
    return found.select("path", "parser", F.col("f.line").cast("long").alias("line"), "f.rule", "f.severity", "f.detail")


def code_symbols(spark, d):
    return facts(spark, d).select("path", F.explode("symbols").alias("s")).select("path", "s.kind", "s.name", F.col("s.line").cast("long").alias("line"), "s.doc", F.array_join("s.methods", ",").alias("methods"))


def _names(f: DataFrame) -> DataFrame:
    return modules.module_names(f.select("path"))


def _edges(f: DataFrame) -> DataFrame:
    rows = f.select("path", F.explode("imports").alias("m")).select("path", "m.module", "m.alias", F.explode_outer("m.names").alias("name"))
    refs = f.select("path", F.explode("refs").alias("name", "n"))
    return modules.import_edges(_names(f), rows.select("path", "module", "name", "alias"), refs)


def _externals(f: DataFrame) -> DataFrame:
    return modules.external_imports(_names(f), f.select("path", F.explode("imports").alias("m")).select("path", "m.module"))


def code_modules(spark, d):
    return _names(sources(spark, d)).select("path", "module", F.array_join("aliases", ",").alias("aliases"), "is_package")


def code_edges(spark, d):
    return _edges(facts(spark, d)).select("src", "dst", "weight", F.array_join("names", ",").alias("names"))


def code_externals(spark, d):
    return _externals(facts(spark, d)).groupBy("top").agg(F.count("*").alias("files"))


def _described(f: DataFrame) -> DataFrame:
    named = f.join(_names(f), "path").withColumn("is_test", is_test_path(F.col("path")))
    made = describe.of_file(F.col("path"), F.col("module"), F.col("doc_full"), F.col("symbols"), F.col("is_test"), F.col("is_package"), F.col("parser"), F.col("parse_error"))
    names = F.concat_ws(" ", "path", F.transform("symbols", lambda s: s["name"]))
    return describe.described(named, made, key="sha").withColumn("auth", area_tag(names)).withColumn("package", F.regexp_extract("path", r"^app/([^/]+)/", 1))


def file_descriptions(spark, d):
    return _described(facts(spark, d)).select("path", "description")


def _needs(spark, d) -> DataFrame:
    """source, text of requirements: one for each benchmark passage, which names a function, a path and a module."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("n")).distinct()
    text = F.concat(F.lit("# Need "), "n", F.lit("\n\nCall f"), "n", F.lit("000 or f"), "n", F.lit(" and C"), "n", F.lit("1 as in app/src0/m"), "n", F.lit(".py, app.src1.m"), "n", F.lit(" or utils.\n"))
    return b.select(F.concat(F.lit("docs/need_"), "n", F.lit(".md")).alias("source"), text.alias("text"))


def requirement_scan(spark, d):
    return requirements.requirements(_needs(spark, d))


def _needed(spark, d, files: DataFrame) -> DataFrame:
    code = files.select("path", "module", F.transform("symbols", lambda s: s["name"]).alias("symbols"), "is_test")
    return requirements.links(requirements.requirements(_needs(spark, d)), code)


def requirement_matches(spark, d):
    return _needed(spark, d, _described(facts(spark, d))).select("slug", "path", F.array_join("reasons", ",").alias("reasons"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("path", "type", "title", "description", F.array_join("tags", ",").alias("tags"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _grouped(f: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership slug, path, place; groups) with the packages as groups, members by number of users and path."""
    inside = f.where("package <> ''")
    users = e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("package").orderBy(F.desc("n"), "path"))
    members = inside.join(users, "path", "left").na.fill(0, ["n"]).select(F.col("package").alias("slug"), "path", place.alias("place"), "is_test", F.col("doc"))
    fit = graph.cohesion(graph.undirected(e), members.select(F.col("path").alias("node"), F.col("slug").alias("grp"))).select(F.col("grp").alias("slug"), "cohesion")
    of = members.groupBy("slug").agg(F.count("*").alias("size"), F.count_if("is_test").alias("tests"), F.min_by("path", "place").alias("hub"), F.min_by("doc", "place").alias("hub_doc"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "path")))).alias("first"))
    about = describe.of_group(F.col("size"), F.col("tests"), F.col("hub"), F.transform("first", lambda x: x["path"]), F.col("hub_doc"), F.lit(0))
    named = of.join(fit, "slug", "left").select("slug", F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("app/"), "slug").alias("title"), about.alias("description"), "size", "hub", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))
    return members.select("slug", "path", "place"), cut(named)


def _source_documents(spark, d) -> DataFrame:
    f = cut(_described(facts(spark, d)))
    line = F.when(F.col("package") != "", F.concat(F.lit("Part of "), render.link(F.concat(F.lit("app/"), "package"), F.concat(F.lit("/subsystems/"), "package", F.lit(".md"))), F.lit(".")))
    needed = _needed(spark, d, f).join(requirements.requirements(_needs(spark, d)).select("slug", "title"), "slug")
    return render.source_files(f.withColumn("subsystem", F.col("package")).withColumn("group_line", line), _edges(f), _externals(f), needed.select("path", "title", "slug"))


def source_file_documents(spark, d):
    return _hashed(_source_documents(spark, d))


def edges_readback(spark, d):
    """Edges as the documents of source files state them, and whether both ends agree."""
    docs = cut(_source_documents(spark, d))
    wrong = readback.asymmetric(docs, F.col("body")).select("src", "dst").distinct().withColumn("wrong", F.lit(True))
    return readback.edges(docs, F.col("body")).join(wrong, ["src", "dst"], "left").select("src", "dst", "weight", F.array_join("names", ",").alias("names"), F.col("wrong").isNull().alias("symmetric"))


def edges_asymmetric(spark, d):
    """What is found where documents of every seventh module have lost what uses them, every eleventh's weights are stale, and every thirteenth is gone."""
    docs = cut(_source_documents(spark, d))
    i = F.regexp_extract("path", r"/m(\d+)\.py\.md$", 1)
    number = F.when(i != "", i.cast("long"))
    lost = F.regexp_replace("body", r"(?s)# Used by\n\n.*?(?=\n\n# |\z)", "# Used by\n\nNone.")
    stale = F.regexp_replace("body", r"\(weight \d+\)", "(weight 9)")
    body = F.when(F.coalesce(number % 7 == 0, F.lit(False)), lost).when(F.coalesce(number % 11 == 0, F.lit(False)), stale).otherwise(F.col("body"))
    return readback.asymmetric(docs.withColumn("body", body).where(F.coalesce(number % 13 != 0, F.lit(True))), F.col("body"))


def _group_parts(spark, d):
    f = cut(_described(facts(spark, d)))
    e = cut(_edges(f))
    members, named = _grouped(f, e)
    between = graph.group_edges(e, members.select(F.col("path").alias("node"), F.col("slug").alias("grp"))).where("src_group <> dst_group").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst"), "edges", "weight")
    return f, e, members, named, between


def group_documents(spark, d):
    f, _, members, named, between = _group_parts(spark, d)
    return _hashed(render.groups(members, named, f, between))


def requirement_documents(spark, d):
    return _hashed(render.requirement_docs(requirements.requirements(_needs(spark, d)), _needed(spark, d, _described(facts(spark, d)))))


def index_documents(spark, d):
    f, _, _, named, _ = _group_parts(spark, d)
    return _hashed(render.directory_indexes(f).unionByName(render.group_index(named)))


def root_document(spark, d):
    f, e, _, named, _ = _group_parts(spark, d)
    return _hashed(render.root("app", f, e, named, incremental.digest(f, [], "path", "sha").select("digest")))


def rendered_text(spark, d):
    """Front matter and body as written, by hash."""
    docs = render.requirement_docs(requirements.requirements(_needs(spark, d)), _needed(spark, d, _described(facts(spark, d))))
    return rendered(docs, ["type", "title", "description"]).select("path", content_hash(F.col("text")).alias("hash"))


def scan_statistics(spark, d):
    """One row: counts of files, parse results, edges, groups, requirements, findings."""
    f, e, _, named, _ = _group_parts(spark, d)
    severe = F.size(F.filter("findings", lambda x: x["severity"] != "info"))
    counted = f.agg(F.count("*").alias("files"), F.count("parse_error").alias("parse_errors"), F.count_if(F.col("parser") == "tokens").alias("parser_fallbacks"), F.count_if(F.col("parser") == "failed").alias("parse_failed"), F.sum(severe).alias("security_findings"), F.sum("loc").alias("loc"))
    one = counted
    for more in (e.agg(F.count("*").alias("edges")), named.agg(F.count("*").alias("subsystems")), _needs(spark, d).agg(F.count("*").alias("requirements"))):
        one = one.join(F.broadcast(more))  # one row each
    return one


def _code_fields(f: DataFrame) -> DataFrame:
    """doc_id, name, doc and body of each file: path and symbols; description, tags and symbol docs; text."""
    names = F.array_join(F.transform("symbols", lambda s: s["name"]), " ")
    docs = F.array_join(F.transform("symbols", lambda s: s["doc"]), " ")
    rules = F.array_join(F.transform("findings", lambda x: F.concat(F.lit("security:"), x["rule"])), " ")
    return f.select(F.col("path").alias("doc_id"), F.concat_ws(" ", "path", names).alias("name"), F.concat_ws(" ", "description", rules, docs).alias("doc"))


def code_search(spark, d):
    """Requirements as queries over the fields of files."""
    f = cut(_described(facts(spark, d)))
    docs = _code_fields(f).join(sources(spark, d).select(F.col("path").alias("doc_id"), F.col("text").alias("body")), "doc_id")
    q = requirements.requirements(_needs(spark, d)).select("slug", "text")
    hits = search.bm25f_top(docs, "doc_id", {"name": docs["name"], "doc": docs["doc"], "body": docs["body"]}, search.query_terms(q, "slug", q["text"]), 10)
    return hits.select(F.col("query_id").alias("slug"), F.col("doc").alias("path"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def context_texts(spark, d):
    """The ten best files of each requirement packed into 1,500 characters of text."""
    hits = code_search(spark, d)
    f = _described(facts(spark, d)).select("path", "description", "symbols")
    shown = F.array_join(F.slice(F.split(render.symbol_lines(F.col("symbols")), "\n"), 1, 10), "\n")
    block = F.concat(F.lit("### "), "path", F.lit("\n\n"), "description", F.lit("\n\nSymbols:\n"), shown)
    items = cut(hits.join(f, "path").select(F.col("slug").alias("query_id"), F.col("path").alias("doc"), F.col("rank").alias("position"), block.alias("block")).withColumn("size", F.length("block")))  # ten rows a query, used twice
    packed = retrieve.pack(items.select("query_id", "doc", "position", "size"), 1500)
    rows = packed.join(items.select("query_id", "position", "block"), ["query_id", "position"])
    out = render.pack_text(rows, F.concat(F.lit("# Context pack\n\n- Query: "), "query_id"))
    return out.select(F.col("query_id").alias("slug"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        code_parse, code_findings, code_rule_forms, code_symbols, code_modules, code_edges, code_externals, file_descriptions, requirement_scan, requirement_matches,
        source_file_documents, edges_readback, edges_asymmetric, group_documents, requirement_documents, index_documents, root_document, rendered_text, scan_statistics, code_search, context_texts,
    )
}
_TEXT = " || chr(10) || ".join(
    [
        """CASE WHEN i % 5 = 0 THEN '# no docs' ELSE '""\"Handles item ' || i || '.""\"' END""",
        "'import hashlib as h'",
        "'import os, subprocess, pickle, yaml, tempfile, requests'",
        "CASE WHEN j IS NULL THEN '# alone' ELSE 'from app.' || other || '.m' || j || ' import f' || j || ' as g' END",
        "''",
        "'class C' || i || ':'",
        """'    ""\"Keeps ' || i || '.""\"'""",
        "'    def __init__(self): pass'",
        "CASE WHEN j IS NULL THEN '    def run(self): return 1' ELSE '    def run(self): return g(f' || j || ', 1)' END",
        "'    def __len__(self): return 0'",
        "''",
        "'def f' || i || '(x):'",
        "'    ' || [" + ", ".join("'" + s + "'" for s in SNIPPETS) + "][i % 12 + 1]",
        "''",
    ]
)
_RULES = "['hardcoded-secret', 'dynamic-code-exec', 'shell-exec', 'shell-exec', 'process-exec', 'unsafe-deserialization', 'unsafe-yaml', 'weak-hash', 'insecure-tempfile', 'sql-string-building', 'tls-verify-disabled']"
_SEVERE = "['high', 'high', 'high', 'high', 'info', 'high', 'medium', 'medium', 'medium', 'high', 'high']"
_CALLED = "['token', 'eval', 'os.system', 'subprocess.run', 'subprocess.run', 'pickle.loads', 'yaml.load', 'hashlib.md5', 'tempfile.mktemp', 'x.execute', 'requests.get']"
_ERROR = "'SyntaxError: ''('' was never closed (<unknown>, line 13)'"

_M = f"""
d0 AS (SELECT doc_id AS i, min(coalesce(source, 'none')) AS package FROM documents GROUP BY 1),
m AS (SELECT a.i, a.package, 'app/' || a.package || '/m' || a.i || '.py' AS path, CASE WHEN a.i % 4 <> 0 THEN b.i END AS j, CASE WHEN a.i % 4 <> 0 THEN b.package END AS other FROM d0 a LEFT JOIN d0 b ON b.i + 1 = a.i),
inits AS (SELECT DISTINCT package, 'app/' || package || '/__init__.py' AS path FROM m),
src AS (SELECT path, {_TEXT} AS text FROM m UNION ALL SELECT path, '""\"Package ' || package || '.""\"' || chr(10) FROM inits UNION ALL SELECT 'app/__init__.py', ''),
f AS (
  SELECT path, package, i, CASE WHEN i % 12 = 11 THEN 'tokens' ELSE 'ast' END AS parser, 11 - (i % 5 = 0)::INT - (j IS NULL)::INT AS loc,
         CASE WHEN i % 5 = 0 OR i % 12 = 11 THEN '' ELSE 'Handles item ' || i || '.' END AS doc, i % 12 = 11 AS failed, 7 + (j IS NOT NULL)::INT AS imports, 2 AS symbols FROM m
  UNION ALL SELECT path, package, NULL, 'ast', 1, 'Package ' || package || '.', false, 0, 0 FROM inits UNION ALL SELECT 'app/__init__.py', '', NULL, 'ast', 0, '', false, 0, 0
),
fd AS (SELECT path, 13 AS line, {_RULES}[i % 12 + 1] AS rule, {_SEVERE}[i % 12 + 1] AS severity, {_CALLED}[i % 12 + 1] AS detail, package FROM m WHERE i % 12 < 11),
e AS (SELECT path AS src, 'app/' || other || '/m' || j || '.py' AS dst, CASE WHEN i % 12 = 11 THEN 3.0 ELSE 2.0 END::DOUBLE AS weight, 'f' || j AS names, package AS sp, other AS dp FROM m WHERE j IS NOT NULL),
ds AS (SELECT path, package, i, CASE WHEN doc <> '' THEN doc WHEN i IS NULL THEN 'Package initializer with no top-level definitions.' ELSE 'Module defining 1 class (C' || i || ') and 1 public function (f' || i || ').' END AS description, doc, parser FROM f),
need AS (SELECT DISTINCT item_id AS n, 'need-' || item_id AS slug, 'Need ' || item_id AS title, 'Call f' || item_id || '000 or f' || item_id || ' and C' || item_id || '1 as in app/src0/m' || item_id || '.py, app.src1.m' || item_id || ' or utils.' AS description FROM benchmark),
lk0 AS (
  SELECT slug, path, '`f' || i || '`' AS reason FROM need JOIN m ON (i = n AND length('f' || n) >= 4) OR (n > 0 AND i = n * 1000)
  UNION SELECT slug, path, '`C' || i || '`' FROM need JOIN m ON i = n * 10 + 1 AND n >= 10 UNION SELECT slug, path, 'file name' FROM need JOIN m ON i = n AND n >= 1000
  UNION SELECT slug, path, 'path' FROM need JOIN m ON i = n AND package = 'src0' UNION SELECT slug, path, 'path' FROM need JOIN m ON package = 'src1' AND starts_with(n::VARCHAR, i::VARCHAR)
  UNION SELECT slug, path, 'path' FROM need JOIN inits ON package = 'src1'
),
lk AS (SELECT slug, path, list_sort(list(reason)) AS reasons FROM lk0 GROUP BY ALL),
us AS (SELECT package AS slug, path, row_number() OVER (PARTITION BY package ORDER BY (SELECT count(*) FROM e WHERE dst = f.path) DESC, path) AS place, doc FROM f WHERE package <> ''),
co AS (SELECT g AS slug, round(sum(CASE WHEN sp = dp THEN weight ELSE 0 END) / sum(weight), 3) AS cohesion FROM (SELECT *, unnest(list_distinct([sp, dp])) AS g FROM e) GROUP BY g),
gr AS (
  SELECT slug, 'app/' || slug AS title, count(*) AS size, min(path) FILTER (place = 1) AS hub, coalesce(min(cohesion), 0.0) AS cohesion,
         count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' centred on `' || min(path) FILTER (place = 1) || '`. Most central: ' || string_agg('`' || path || '`', ', ' ORDER BY place) FILTER (place <= 3) || '.'
           || CASE WHEN min(doc) FILTER (place = 1) <> '' THEN ' Hub purpose: ' || rtrim(min(doc) FILTER (place = 1), '.') || '.' ELSE '' END AS description
  FROM us LEFT JOIN co USING (slug) GROUP BY slug
)"""


def _with(select: str) -> str:
    return f"WITH {_M} {select}"


def _doc(path: str, kind: str, title: str, description: str, tags: str, parts: list[str], source: str) -> str:
    body = f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10) || chr(10))"
    return f"SELECT {path} AS path, '{kind}' AS type, {title} AS title, {description} AS description, {tags} AS tags, md5({body}) AS body_md5 FROM {source}"


def _section(title: str, text: str) -> str:
    return f"'# {title}' || chr(10) || chr(10) || {text}"


_NONE = "'None.'"
_EDGE = "string_agg('- [' || {0} || '](/files/' || {0} || '.md): uses `' || names || '` (weight ' || weight::BIGINT || ')', chr(10) ORDER BY -weight, {0})"
_SOURCE_DOCS = _doc(
    "'/files/' || ds.path || '.md'", "Source File", "ds.path", "description",
    "'python,subsystem:' || ds.package || CASE WHEN fd.severity <> 'info' THEN ',security:' || rule ELSE '' END",
    [
        _section("Summary", "description"),
        "CASE WHEN ds.package <> '' THEN " + _section("Subsystem", "'Part of [app/' || ds.package || '](/subsystems/' || ds.package || '.md).'") + " END",
        "CASE WHEN i IS NOT NULL THEN " + _section("Symbols", "'- `class C' || i || '` (L6)' || CASE WHEN parser = 'ast' THEN ': Keeps ' || i || '.' || chr(10) || '  - methods: `__init__`, `run`' ELSE '' END || chr(10) || '- `def f' || i || '()` (L12)'") + " END",
        _section("Depends on", f"coalesce(down, {_NONE})"),
        _section("Used by", f"coalesce(up, {_NONE})"),
        "CASE WHEN i IS NOT NULL THEN " + _section("External dependencies", "'`hashlib`, `os`, `pickle`, `requests`, `subprocess`, `tempfile`, `yaml`'") + " END",
        "CASE WHEN rule IS NOT NULL THEN " + _section("Security notes", "'- L13 · **' || severity || '** · ' || rule || ': ' || detail") + " END",
        "CASE WHEN req IS NOT NULL THEN " + _section("Requirements", "req") + " END",
    ],
    f"ds LEFT JOIN fd USING (path) LEFT JOIN (SELECT src AS path, {_EDGE.format('dst')} AS down FROM e GROUP BY src) USING (path) LEFT JOIN (SELECT dst AS path, {_EDGE.format('src')} AS up FROM e GROUP BY dst) USING (path)"
    " LEFT JOIN (SELECT path, string_agg('- [' || title || '](/requirements/' || slug || '.md)', chr(10) ORDER BY slug) AS req FROM lk JOIN need USING (slug) GROUP BY path) USING (path)",
)
_BETWEEN = "SELECT {0} AS slug, string_agg('- [app/' || {1} || '](/subsystems/' || {1} || '.md): ' || n || ' import edges (weight ' || w::BIGINT || ')', chr(10) ORDER BY -w, {1}) AS {2} FROM (SELECT sp, dp, count(*) AS n, sum(weight) AS w FROM e WHERE sp <> dp GROUP BY sp, dp) GROUP BY {0}"
_GROUP_DOCS = _doc(
    "'/subsystems/' || slug || '.md'", "Subsystem", "title", "description", "'subsystem' || coalesce(flags, '')",
    [
        _section("Summary", "description"),
        _section("Members", "'Ranked by centrality in the dependency graph.' || chr(10) || chr(10) || members"),
        _section("Depends on subsystems", f"coalesce(down, {_NONE})"),
        _section("Used by subsystems", f"coalesce(up, {_NONE})"),
        "CASE WHEN notes IS NOT NULL THEN " + _section("Security notes", "notes") + " END",
    ],
    "gr LEFT JOIN (SELECT slug, string_agg('- [' || path || '](/files/' || path || '.md): ' || description, chr(10) ORDER BY place) AS members FROM us JOIN ds USING (path) GROUP BY slug) USING (slug)"
    f" LEFT JOIN ({_BETWEEN.format('sp', 'dp', 'down')}) USING (slug) LEFT JOIN ({_BETWEEN.format('dp', 'sp', 'up')}) USING (slug)"
    " LEFT JOIN (SELECT package AS slug, string_agg('- ' || rule || ' ×' || n || ': ' || files, chr(10) ORDER BY -n, rule) AS notes, string_agg(',security:' || rule, '' ORDER BY rule) AS flags"
    " FROM (SELECT package, rule, count(*) AS n, string_agg('[' || path || '](/files/' || path || '.md)', ', ' ORDER BY path) AS files FROM fd WHERE severity <> 'info' GROUP BY ALL) GROUP BY package) USING (slug)",
)
_NEED_TEXT = "'## Need ' || n || chr(10) || chr(10) || description"
_NEED_LINES = "SELECT slug, string_agg('- [' || path || '](/files/' || path || '.md) (matched: ' || array_to_string(reasons, ', ') || ')', chr(10) ORDER BY -len(reasons), path) AS impl FROM lk GROUP BY slug"
_NEED_DOCS = _doc("'/requirements/' || slug || '.md'", "Requirement", "title", "description", "'requirement'", [_section("Implemented by", "coalesce(impl, 'No code matched yet.')"), _section("Text", _NEED_TEXT)], f"need LEFT JOIN ({_NEED_LINES}) USING (slug)")
_DIRS = """(SELECT dir, string_agg(line, chr(10) ORDER BY child) AS list FROM (
  SELECT 'app/' || package AS dir, path AS child, '- [' || split_part(path, '/', 3) || '](/files/' || path || '.md): ' || description AS line FROM ds WHERE package <> ''
  UNION ALL SELECT 'app', 'app/' || package, '- [' || package || '/](/files/app/' || package || '/index.md)' FROM inits
  UNION ALL SELECT 'app', path, '- [__init__.py](/files/' || path || '.md): ' || description FROM ds WHERE package = ''
  UNION ALL SELECT '', 'app', '- [app/](/files/app/index.md)') GROUP BY dir)"""
_INDEX_DOCS = (
    _doc("CASE WHEN dir = '' THEN '/files/index.md' ELSE '/files/' || dir || '/index.md' END", "Index", "'Files in ' || CASE WHEN dir = '' THEN '/' ELSE dir END", "'Source files under ' || CASE WHEN dir = '' THEN 'the repository root' ELSE dir END || '.'", "''", [_section("Contents", "list")], _DIRS)
    + " UNION ALL "
    + _doc("'/subsystems/index.md'", "Index", "'Subsystems'", "n || ' subsystems found by community detection on the import graph.'", "''", [_section("Subsystems", "list")],
           "(SELECT count(*) AS n, string_agg('- [' || title || '](/subsystems/' || slug || '.md) (' || size || ' files, cohesion ' || cohesion || '): ' || description, chr(10) ORDER BY -size, slug) AS list FROM gr)")
)
_DIGEST = "SELECT left(sha256(string_agg(p || h, '' ORDER BY p || h)), 16) AS digest FROM (SELECT left(h, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha256(path || chr(31) || 'sha256:' || left(sha256(text), 16)) AS h FROM src) GROUP BY 1)"
_ROOT_DOC = _doc(
    "'/index.md'", "Index", "'app'", "'Code knowledge of app, digest ' || digest || '.'", "''",
    [
        _section("Overview", "'`app`: ' || (SELECT count(*) FROM f) || ' Python files, ' || (SELECT count(*) FROM e) || ' internal import edges, ' || (SELECT count(*) FROM gr) || ' subsystems (0 components).'"),
        _section("Subsystems", "(SELECT string_agg('- [' || title || '](/subsystems/' || slug || '.md) (' || size || ' files): ' || description, chr(10) ORDER BY -size, slug) FROM gr)"),
        _section("Parse failures", f"(SELECT string_agg('- [' || path || '](/files/' || path || '.md) · parser: tokens · ' || {_ERROR}, chr(10) ORDER BY path) FROM f WHERE failed)"),
        _section("Security hotspots", "(SELECT string_agg('- [' || path || '](/files/' || path || '.md): ' || rule, chr(10) ORDER BY path) FROM (SELECT * FROM fd WHERE severity = 'high' ORDER BY path LIMIT 8))"),
    ],
    f"({_DIGEST})",
)
_CODE_FIELDS = f"""
cf AS (
  SELECT ds.path AS doc, ds.path || CASE WHEN i IS NULL THEN '' ELSE ' C' || i || ' f' || i END AS name,
         description || ' ' || coalesce('security:' || rule, '') || ' ' || CASE WHEN i IS NULL THEN '' WHEN parser = 'ast' THEN 'Keeps ' || i || '. ' ELSE ' ' END AS doc_text, text AS body
  FROM ds JOIN src USING (path) LEFT JOIN fd USING (path)
), g AS (
  SELECT doc, unnest([{{'field': 'name', 'w': 3.0::DOUBLE, 'ts': {tq.term_sql('name')}}}, {{'field': 'doc', 'w': 2.0::DOUBLE, 'ts': {tq.term_sql('doc_text')}}}, {{'field': 'body', 'w': 1.0::DOUBLE, 'ts': {tq.term_sql('body')}}}], recursive := true) FROM cf
), av AS (SELECT field, avg(len(ts)) AS mean FROM g GROUP BY field),
ft AS (SELECT doc, field, w, len(ts) AS l, unnest(ts) AS term FROM g),
fp AS (SELECT doc, field, term, w * count(*) / (0.25 + 0.75 * l / CASE WHEN mean = 0 THEN 1 ELSE mean END) AS fv FROM ft JOIN av USING (field) GROUP BY doc, field, w, l, mean, term),
p AS (SELECT doc, term, sum(fv) AS v FROM fp GROUP BY ALL),
fdf AS (SELECT term, ln(1 + ((SELECT count(*) FROM f) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
q0 AS (SELECT slug AS q, unnest({tq.term_sql("'# Need ' || n || ' ' || description")}) AS term FROM need), qt AS (SELECT q, term, count(*) AS times FROM q0 GROUP BY ALL),
b AS (SELECT q, doc, sum(times * idf * v / (1.2 + v)) AS score FROM p JOIN qt USING (term) JOIN fdf USING (term) GROUP BY ALL),
rb AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM b)"""
_BLOCK = "'### ' || rb.doc || chr(10) || chr(10) || description || chr(10) || chr(10) || 'Symbols:' || chr(10) || CASE WHEN i IS NULL THEN '' ELSE '- `class C' || i || '` (L6)' || CASE WHEN parser = 'ast' THEN ': Keeps ' || i || '.' || chr(10) || '  - methods: `__init__`, `run`' ELSE '' END || chr(10) || '- `def f' || i || '()` (L12)' END"

SQL = {
    "code_parse": _with("SELECT path, parser, loc::BIGINT AS loc, doc, failed, imports::BIGINT AS imports, symbols::BIGINT AS symbols FROM f"),
    "code_findings": _with("SELECT path, line::BIGINT AS line, rule, severity, detail FROM fd"),
    "code_rule_forms": "SELECT 'f' || doc_id || '.py' AS path, 'ast' AS parser, CASE WHEN rule IS NOT NULL THEN 10 END::BIGINT AS line, rule, severity, detail FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in form[1:]) + ")" for k, form in enumerate(FORMS))
    + f") AS t(k, rule, severity, detail) ON doc_id % {len(FORMS)} = k",
    "code_symbols": _with("SELECT path, 'class' AS kind, 'C' || i AS name, 6::BIGINT AS line, CASE WHEN i % 12 = 11 THEN '' ELSE 'Keeps ' || i || '.' END AS doc, CASE WHEN i % 12 = 11 THEN '' ELSE '__init__,run' END AS methods FROM m UNION ALL SELECT path, 'function', 'f' || i, 12, '', '' FROM m"),
    "code_modules": _with("SELECT path, 'app.' || package || '.m' || i AS module, '' AS aliases, false AS is_package FROM m UNION ALL SELECT path, 'app.' || package, '', true FROM inits UNION ALL SELECT 'app/__init__.py', 'app', '', true"),
    "code_edges": _with("SELECT src, dst, weight, names FROM e"),
    "code_externals": _with("SELECT top, count(*) AS files FROM m, (SELECT unnest(['hashlib', 'os', 'subprocess', 'pickle', 'yaml', 'tempfile', 'requests']) AS top) GROUP BY top"),
    "file_descriptions": _with("SELECT path, description FROM ds"),
    "requirement_scan": _with("SELECT 'docs/need_' || n || '.md' AS source, slug, title, description, '# Need ' || n || chr(10) || chr(10) || description AS text FROM need"),
    "requirement_matches": _with("SELECT slug, path, array_to_string(reasons, ',') AS reasons FROM lk"),
    "source_file_documents": _with(_SOURCE_DOCS),
    "edges_readback": _with("SELECT src, dst, weight, names, true AS symmetric FROM e"),
    "edges_asymmetric": _with("""SELECT src, dst, fault FROM (
      SELECT src, dst, a.i % 13 <> 0 AS down, b.i % 13 <> 0 AND b.i % 7 <> 0 AS up, CASE WHEN a.i % 7 <> 0 AND a.i % 11 = 0 THEN 9 ELSE weight END AS wa, CASE WHEN b.i % 11 = 0 THEN 9 ELSE weight END AS wb,
             unnest([CASE WHEN down AND NOT up THEN 'not listed by the target' WHEN up AND NOT down THEN 'not listed by the source' WHEN down AND up AND wa <> wb THEN 'weights differ' END,
                     CASE WHEN (down OR up) AND a.i % 13 = 0 THEN 'no such document' END, CASE WHEN (down OR up) AND b.i % 13 = 0 THEN 'no such document' END]) AS fault
      FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst) WHERE fault IS NOT NULL"""),
    "group_documents": _with(_GROUP_DOCS),
    "requirement_documents": _with(_NEED_DOCS),
    "index_documents": _with(_INDEX_DOCS),
    "root_document": _with(_ROOT_DOC),
    "rendered_text": _with(f"SELECT '/requirements/' || slug || '.md' AS path, 'sha256:' || left(sha256('---' || chr(10) || 'type: Requirement' || chr(10) || 'title: ' || title || chr(10) || 'description: ' || description || chr(10) || '---' || chr(10) || chr(10) || {_section('Implemented by', 'coalesce(impl, ' + chr(39) + 'No code matched yet.' + chr(39) + ')')} || chr(10) || chr(10) || {_section('Text', _NEED_TEXT)}), 16) AS hash FROM need LEFT JOIN ({_NEED_LINES}) USING (slug)"),
    "scan_statistics": _with("SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f WHERE failed) AS parse_errors, (SELECT count(*) FROM f WHERE failed) AS parser_fallbacks, 0::BIGINT AS parse_failed, (SELECT count(*) FROM fd WHERE severity <> 'info') AS security_findings, (SELECT sum(loc)::BIGINT FROM f) AS loc, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM gr) AS subsystems, (SELECT count(*) FROM need) AS requirements"),
    "code_search": f"WITH {_M}, {_CODE_FIELDS} SELECT q AS slug, doc AS path, rank, round(score, 6) AS score FROM rb WHERE rank <= 10",
    "context_texts": f"""WITH RECURSIVE {_M}, {_CODE_FIELDS},
      it AS (SELECT q, rank, {_BLOCK} AS block, length({_BLOCK}) AS size FROM rb JOIN ds ON ds.path = rb.doc WHERE rank <= 10),
      k AS (SELECT q, rank, block, size <= 1500 AS packed, CASE WHEN size <= 1500 THEN size ELSE 0 END AS used FROM it WHERE rank = 1
            UNION ALL SELECT it.q, it.rank, it.block, used + size <= 1500, CASE WHEN used + size <= 1500 THEN used + size ELSE used END FROM k JOIN it ON it.q = k.q AND it.rank = k.rank + 1),
      t AS (SELECT q, '# Context pack' || chr(10) || chr(10) || '- Query: ' || q || chr(10) || chr(10) || '## Relevant files' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (packed)
            || CASE WHEN count(*) FILTER (NOT packed) > 0 THEN chr(10) || chr(10) || '_' || count(*) FILTER (NOT packed) || CASE WHEN count(*) FILTER (NOT packed) = 1 THEN ' lower-ranked item' ELSE ' lower-ranked items' END || ' omitted to fit the budget._' ELSE '' END || chr(10) AS text FROM k GROUP BY q)
      SELECT q AS slug, md5(text) AS text_md5, length(text) AS n_chars FROM t""",
}
