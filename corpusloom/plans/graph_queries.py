"""Graph, module, link and incremental queries on the driver's tables.

The graph: supplier nation -> customer nation, weighted by order lines, where more
of them go than on average. Commits: orders; files: parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import FINDINGS, content_hash, first_line, hub_damping, terms, text_findings
from corpusloom.operators import graph, incremental, modules, pages
from corpusloom.operators.components import connected_components
from corpusloom.plans.session import table
from corpusloom.plans.text_queries import term_sql

ROUNDS, DEPTH = 15, 3


def flows(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, weight of all pairs of nations."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    per = lines.join(s, lines["l_suppkey"] == s["s_suppkey"]).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return per.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def edges(spark, d):
    f = flows(spark, d).where("src <> dst")
    return f.join(F.broadcast(f.agg(F.avg("weight").alias("mean")))).where("weight > mean").select("src", "dst", "weight")  # one row


def regions(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))


def graph_edges(spark, d):
    return edges(spark, d)


def fan_in_out(spark, d):
    return graph.fan(edges(spark, d))


def undirected_edges(spark, d):
    return graph.undirected(edges(spark, d))


def group_edges(spark, d):
    return graph.group_edges(edges(spark, d), regions(spark, d))


def cohesion(spark, d):
    return graph.cohesion(graph.undirected(edges(spark, d)), regions(spark, d))


def modularity(spark, d):
    return graph.modularity(graph.undirected(edges(spark, d)), regions(spark, d)).select(F.round("modularity", 6).alias("modularity"))


def seeds(spark, d):
    """One seed set for each region: its first two nations."""
    place = F.row_number().over(W.partitionBy("grp").orderBy("node"))
    return regions(spark, d).withColumn("k", place).where("k <= 2").select(F.col("grp").alias("seed_set"), "node")


def bfs_depth(spark, d):
    return graph.distances(edges(spark, d), seeds(spark, d), DEPTH).withColumn("distance", F.col("distance").cast("long"))


def shortest_paths(spark, d):
    out = graph.paths(edges(spark, d), seeds(spark, d), DEPTH)
    return out.select("seed_set", "node", F.col("distance").cast("long").alias("distance"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def pagerank(spark, d):
    nodes = regions(spark, d).select("node")
    return graph.pagerank(graph.undirected(edges(spark, d)), nodes, rounds=ROUNDS, tolerance=None).select("node", F.round("rank", 6).alias("rank"))


def _walk(spark, d, task: str, damped: bool = False) -> DataFrame:
    e = edges(spark, d)
    weight = graph.fan(e).select("node", hub_damping(F.col("fan_in")).alias("tw")) if damped else None
    return graph.walk(graph.transitions(e, *graph.DIRECTIONS[task], weight), seeds(spark, d), ROUNDS, tolerance=None).select("seed_set", "node", F.round("mass", 6).alias("mass"))


def ppr_bug(spark, d):
    return _walk(spark, d, "bug")


def ppr_refactor(spark, d):
    return _walk(spark, d, "refactor")


def hub_damped_ppr(spark, d):
    return _walk(spark, d, "feature", True)


def components(spark, d):
    """Parts that share a customer's order with another part from the same supplier nation of region 0 customers' first orders."""
    firsts = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("part")).join(firsts, "o")
    least = lines.groupBy("o").agg(F.min("part").alias("hub"))
    return connected_components(lines.join(least, "o").select("hub", "part"), "hub", "part")


def longest_prefix_join(spark, d):
    """Page paths and the deepest directory that is itself a page or holds ten pages."""
    p = table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "").alias("name")).where("name <> ''")
    known = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "/"))), lambda n: F.array_join(F.slice(F.split("name", "/"), 1, n), "/"))).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n >= 10")
    return modules.longest_prefix(p, "name", known, "/")


def module_index_priority(spark, d):
    """Files of documents: three share a canonical name, many an alias, and aliases are canonical names of others."""
    i = F.col("doc_id")
    name = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    files = table(spark, d, "documents").select(
        F.concat(F.coalesce("source", F.lit("none")), name("/m", i), F.lit(".py")).alias("path"), name("app.m", F.expr("doc_id div 3")).alias("module"),
        F.array(name("lib.m", F.pmod(i, F.lit(50))), name("app.m", F.expr("doc_id div 2"))).alias("aliases"), F.lit(False).alias("is_package"),
    )
    return modules.module_index(files)


def reexport_chain(spark, d):
    """File i passes name k on from file i div (2 + k), unless it defines the name itself."""
    each = table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    named = each.select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("path"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("name"), F.concat(F.lit("f"), F.expr("i div (2 + k)").cast("string")).alias("target"), (F.pmod("i", F.lit(7)) == F.col("k")).alias("own"))
    hops = named.select("path", "name", "target")
    return modules.reexport_sources(hops.select("path", "name").distinct(), hops, named.where("own").select("path", "name"))


def _links(spark, d):
    p = table(spark, d, "pages")
    return pages.html_links(p, "page_id", p["html"])


def link_extract(spark, d):
    return _links(spark, d)


def broken_links(spark, d):
    """Links to a word that is no term of any document's first line."""
    docs = table(spark, d, "documents")
    known = docs.select(F.explode(F.split(first_line(docs["text"]), " ")).alias("w")).select(F.concat(F.lit("/"), "w").alias("key"))
    return pages.broken(_links(spark, d), known).select("page", "ordinal", "target")


def directory_rollup(spark, d):
    p = table(spark, d, "pages").where(F.col("url").contains("://"))
    return pages.rollup(p, F.regexp_extract(p["url"], r"://([^?#]*)", 1))


def requirement_links(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    return pages.term_links(b, "item_id", terms(b["text"]), docs, "doc_id", terms(first_line(docs["text"])), 7).select(F.col("left").alias("item_id"), F.col("right").alias("doc_id"), "shared")


def _findings(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(text_findings(docs["text"])).alias("f")).select("doc_id", "f.rule", "f.severity", F.col("f.line").cast("long").alias("line"))


def secret_findings(spark, d):
    return _findings(spark, d)


#: Lines that break a rule or nearly do, as texts have them.
LINES = [
    "subprocess.run(x, shell=True)", "subprocess.run(x, shell=False)", "y = subprocess.Popen(x)", "os.popen(x)", "yaml.load(x)", "yaml.load(x, Loader=yaml.SafeLoader)", "yaml.safe_load(x)", "requests.get(u, verify=False)",
    "requests.get(u, verify=Falsehood)", "hashlib.sha1(x)", "hashlib.sha256(x)", "pickle.load(f)", "marshal.dumps(x)", "eval(x)", "evaluate(x)", "tempfile.mktemp()", "tempfile.mkdtemp()",
    "c.execute('select %s' % x)", "c.execute('select ?', x)", "c.executemany(f'{x}')", "c.execute('a {}'.format(x))", "c.raw(head + x)", "api_key = 'abcdefgh1'", "api_key = 'short'", "PASSWORD='longenough'",
]


def findings_in_lines(spark, d):
    """Findings of documents with one such line at their end."""
    docs = table(spark, d, "documents")
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.pmod("doc_id", F.lit(len(LINES))) + 1).cast("int"))
    found = docs.select("doc_id", F.explode(text_findings(F.concat_ws("\n", "text", line))).alias("f"))
    return found.select("doc_id", "f.rule", "f.severity", F.col("f.line").cast("long").alias("line"))


def findings_by_rule(spark, d):
    return _findings(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Now, and an earlier state: some documents absent, some with another text."""
    docs = table(spark, d, "documents")
    now = docs.select(F.col("doc_id").alias("path"), content_hash(docs["text"]).alias("hash"))
    altered = F.when(docs["doc_id"] % 7 == 0, F.concat(docs["text"], F.lit("."))).otherwise(docs["text"])
    then = docs.where("doc_id % 10 <> 0").select(F.when(docs["doc_id"] % 11 == 0, -docs["doc_id"]).otherwise(docs["doc_id"]).alias("path"), content_hash(altered).alias("hash"), F.lit("2020-01-01T00:00:00Z").alias("timestamp"))
    return then, now


def snapshot_diff(spark, d):
    then, now = snapshots(spark, d)
    return incremental.diff(then, now)


def stale_check(spark, d):
    return incremental.is_stale(snapshot_diff(spark, d))


def timestamp_carry_forward(spark, d):
    then, now = snapshots(spark, d)
    return incremental.carry_timestamps(then, now, F.lit("2024-01-01T00:00:00Z"))


def corpus_digest(spark, d):
    return incremental.digest(table(spark, d, "documents"), ["source"], "doc_id", "text")


def latest_record_wins(spark, d):
    e = table(spark, d, "events")
    out = e.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("k = 1")
    return out.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def community_jaccard_match(spark, d):
    """Customers grouped by nation against their groups by segment and nation, without those in debt."""
    c = table(spark, d, "customer")
    now = c.select(F.col("c_custkey").alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("grp"))
    then = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("node"), F.concat(F.lit("old"), F.col("c_nationkey").cast("string")).alias("grp"))
    return incremental.jaccard_match(then, now, 0.5).withColumn("jaccard", F.round("jaccard", 6))


def moved_members(spark, d):
    c = table(spark, d, "customer")
    then = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("grp"))
    now = c.select(F.col("c_custkey").alias("node"), F.when(c["c_acctbal"] < 0, 0).otherwise(c["c_nationkey"]).alias("grp"))
    return incremental.moved(then, now)


def _commits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def cochange_pairs(spark, d):
    return pages.cochange(_commits(spark, d)).select("a", "b", "together")


def cochange_jaccard(spark, d):
    return pages.cochange(_commits(spark, d)).where("together >= 2").withColumn("jaccard", F.round("jaccard", 6))


def cochange_recall(spark, d):
    """Of the parts in an order of the later half, how many are among the five that went most often with its first part before."""
    orders = table(spark, d, "orders")
    half = orders.agg(F.percentile(F.unix_micros(F.col("o_orderdate").cast("timestamp")), 0.5).alias("half"))
    dated = orders.join(F.broadcast(half)).select(F.col("o_orderkey").alias("commit"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) > F.col("half")).alias("later"))  # one row
    rows = _commits(spark, d).distinct().join(dated, "commit")
    before = pages.cochange(rows.where("not later").select("commit", "file"))
    both = before.select("a", "b", "together").unionByName(before.select(F.col("b").alias("a"), F.col("a").alias("b"), "together"))
    top = both.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("together"), "b"))).where("k <= 5")
    after = rows.where("later").select("commit", "file")
    seed = after.groupBy("commit").agg(F.min("file").alias("a"), F.count("*").alias("n")).where("n between 2 and 10")
    gold = after.join(seed, "commit").where("file <> a").select("commit", "a", F.col("file").alias("b"))
    hits = gold.join(top.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    per = hits.groupBy("commit").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, fan_in_out, undirected_edges, group_edges, cohesion, modularity, bfs_depth, shortest_paths, pagerank, ppr_bug, ppr_refactor, hub_damped_ppr,
        components, longest_prefix_join, module_index_priority, reexport_chain, link_extract, broken_links, directory_rollup, requirement_links, secret_findings,
        findings_by_rule, findings_in_lines, snapshot_diff, stale_check, timestamp_carry_forward, corpus_digest, latest_record_wins, community_jaccard_match, moved_members,
        cochange_pairs, cochange_jaccard, cochange_recall,
    )
}

_E = """
fl AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT src, dst, weight FROM fl WHERE src <> dst AND weight > (SELECT avg(weight) FROM fl WHERE src <> dst)),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY ALL),
m AS (SELECT n_nationkey AS node, n_regionkey AS grp FROM nation),
s AS (SELECT grp AS seed_set, node FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY node) <= 2)"""


def _walk_sql(steps: str, start: str, restart: float, rounds: int = ROUNDS) -> str:
    """The same rounds as a chain of CTEs."""
    out = [f"t0 AS ({steps}), t1 AS (SELECT u, v, sum(w) AS w FROM t0 GROUP BY ALL), t AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p FROM t1), st AS (SELECT seed_set, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY seed_set) AS share FROM {start}), r0 AS (SELECT seed_set, node, share AS mass FROM st)"]
    for k in range(rounds):
        out.append(f"""r{k + 1} AS MATERIALIZED (SELECT seed_set, node, sum(mass) AS mass FROM (
          SELECT seed_set, v AS node, {1 - restart} * mass * p AS mass FROM r{k} JOIN t ON node = u
          UNION ALL SELECT seed_set, node, share * ({restart} + {1 - restart} * coalesce(stuck, 0)) FROM st LEFT JOIN (SELECT seed_set, sum(mass) AS stuck FROM r{k} WHERE node NOT IN (SELECT u FROM t) GROUP BY seed_set) USING (seed_set)) GROUP BY ALL)""")
    return ", ".join(out)


def _steps(along: float, against: float, damped: bool = False) -> str:
    tw = "/ ln(2 + coalesce(fi, 0))" if damped else ""
    join = "LEFT JOIN (SELECT dst AS n_, count(*) AS fi FROM e GROUP BY dst) ON n_ = v" if damped else ""
    return f"SELECT u, v, w {tw} AS w FROM (SELECT src AS u, dst AS v, weight * {along}::DOUBLE AS w FROM e UNION ALL SELECT dst, src, weight * {against}::DOUBLE FROM e) {join}"


def _ppr(along, against, damped=False):
    return f"WITH {_E}, {_walk_sql(_steps(along, against, damped), 's', 0.15)} SELECT seed_set, node, round(mass, 6) AS mass FROM r{ROUNDS}"


_quoted = lambda x: x.replace("'", "''")
_FIND = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{s}' AS severity, line, l FROM x WHERE regexp_matches(l, '{_quoted(p)}')" + (f" AND NOT regexp_matches(l, '{_quoted(w)}')" if w else "") for r, s, p, w in FINDINGS)
_FIND = f"WITH y AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM y), f AS ({_FIND})"
_SNAP = """now_ AS (SELECT doc_id AS path, 'sha256:' || left(sha256(text), 16) AS hash FROM documents),
then_ AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS path, 'sha256:' || left(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END), 16) AS hash FROM documents WHERE doc_id % 10 <> 0),
df AS (SELECT coalesce(t.path, n.path) AS path, CASE WHEN t.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN t.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS status FROM then_ t FULL JOIN now_ n ON t.path = n.path)"""
_LINKS = """l0 AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS ls FROM pages),
l AS (SELECT page_id AS page, unnest(range(len(ls))) AS ordinal, unnest(ls) AS target FROM l0)"""
_CO = """c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem), cs AS (SELECT k FROM c GROUP BY k HAVING count(*) BETWEEN 2 AND 10), ck AS (SELECT k, f FROM c SEMI JOIN cs USING (k)),
ce AS (SELECT f, count(*) AS n FROM ck GROUP BY f), cp AS (SELECT x.f AS a, y.f AS b, count(*) AS together FROM ck x JOIN ck y ON x.k = y.k AND x.f < y.f GROUP BY ALL)"""

SQL = {
    "graph_edges": f"WITH {_E} SELECT src, dst, weight FROM e",
    "fan_in_out": f"WITH {_E} SELECT node, count(*) FILTER (i = 1) AS fan_in, count(*) FILTER (i = 0) AS fan_out, CAST(sum(weight * i) AS BIGINT) AS weight_in, CAST(sum(weight * (1 - i)) AS BIGINT) AS weight_out FROM (SELECT src AS node, 0 AS i, weight FROM e UNION ALL SELECT dst, 1, weight FROM e) GROUP BY node",
    "undirected_edges": f"WITH {_E} SELECT a, b, weight FROM u",
    "group_edges": f"WITH {_E} SELECT x.grp AS src_group, y.grp AS dst_group, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN m x ON src = x.node JOIN m y ON dst = y.node GROUP BY ALL",
    "cohesion": f"WITH {_E}, z AS (SELECT x.grp AS ga, y.grp AS gb, weight FROM u JOIN m x ON a = x.node JOIN m y ON b = y.node), k AS (SELECT grp, CAST(coalesce(sum(weight) FILTER (ga = gb), 0) AS BIGINT) AS internal, CAST(coalesce(sum(weight) FILTER (ga <> gb), 0) AS BIGINT) AS cut FROM z JOIN (SELECT DISTINCT grp FROM m) g ON grp = ga OR grp = gb GROUP BY grp) SELECT grp, internal, cut, round(internal / (internal + cut), 3) AS cohesion FROM k",
    "modularity": f"WITH {_E}, z AS (SELECT x.grp AS ga, y.grp AS gb, weight FROM u JOIN m x ON a = x.node JOIN m y ON b = y.node), w AS (SELECT sum(weight) AS w FROM u), d AS (SELECT grp, sum(weight) AS d FROM (SELECT ga AS grp, weight FROM z UNION ALL SELECT gb, weight FROM z) GROUP BY grp), i AS (SELECT ga AS grp, sum(weight) AS i FROM z WHERE ga = gb GROUP BY ga) SELECT round(sum(coalesce(i, 0) / w - pow(d / (2 * w), 2)), 6) AS modularity FROM d LEFT JOIN i USING (grp) CROSS JOIN w",
    "bfs_depth": f"WITH RECURSIVE {_E}, b AS (SELECT seed_set, node, 0 AS distance FROM s UNION ALL SELECT b.seed_set, e.dst, distance + 1 FROM b JOIN e ON node = src WHERE distance < {DEPTH}) SELECT seed_set, node, CAST(min(distance) AS BIGINT) AS distance FROM b GROUP BY ALL",
    "shortest_paths": f"WITH RECURSIVE {_E}, b AS (SELECT seed_set, node, [node] AS path FROM s UNION ALL SELECT b.seed_set, e.dst, list_append(path, e.dst) FROM b JOIN e ON node = src WHERE len(path) <= {DEPTH}) SELECT seed_set, node, CAST(min(len(path)) - 1 AS BIGINT) AS distance, array_to_string(arg_min(path, (len(path), path)), '>') AS path FROM b GROUP BY ALL",
    "pagerank": f"WITH {_E}, {_walk_sql('SELECT a AS u, b AS v, weight::DOUBLE AS w FROM u UNION ALL SELECT b, a, weight FROM u', '(SELECT 0 AS seed_set, node FROM m)', 0.15)} SELECT node, round(mass, 6) AS rank FROM r{ROUNDS}",
    "ppr_bug": _ppr(1.0, 0.5),
    "ppr_refactor": _ppr(0.5, 1.0),
    "hub_damped_ppr": _ppr(1.0, 1.0, True),
    "longest_prefix_join": r"""WITH p AS (SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS name FROM pages), v AS (SELECT name, string_split(name, '/') AS s FROM p WHERE name <> ''),
      x AS (SELECT name, unnest(list_transform(range(1, len(s) + 1), lambda n: array_to_string(s[1:n], '/'))) AS key FROM v), k AS (SELECT key FROM x GROUP BY key HAVING count(*) >= 10) SELECT name, arg_max(key, length(key)) AS prefix FROM x SEMI JOIN k USING (key) GROUP BY name""",
    "module_index_priority": """WITH f AS (SELECT coalesce(source, 'none') || '/m' || doc_id || '.py' AS path, doc_id AS i FROM documents), c AS (SELECT 'app.m' || (i // 3) AS module, max(path) AS path FROM f GROUP BY 1),
      a AS (SELECT module, min(path) AS path FROM (SELECT 'lib.m' || (i % 50) AS module, path FROM f UNION ALL SELECT 'app.m' || (i // 2), path FROM f) GROUP BY 1)
      SELECT module, coalesce(c.path, a.path) AS path FROM c FULL JOIN a USING (module)""",
    "reexport_chain": """WITH RECURSIVE h AS (SELECT DISTINCT 'f' || doc_id AS path, 'x' || k AS name, 'f' || (doc_id // (2 + k)) AS target FROM documents, range(2) t(k) WHERE doc_id % 7 <> k AND doc_id // (2 + k) <> doc_id),
      r AS (SELECT path, name, target, 1 AS n FROM h UNION ALL SELECT r.path, r.name, h.target, n + 1 FROM r JOIN h ON h.path = r.target AND h.name = r.name WHERE n < 3) SELECT path, name, arg_max(target, n) AS source FROM r GROUP BY ALL""",
    "link_extract": f"WITH {_LINKS} SELECT page, ordinal, target FROM l",
    "broken_links": f"WITH {_LINKS}, k AS (SELECT '/' || unnest(string_split(split_part(coalesce(text, ''), chr(10), 1), ' ')) AS target FROM documents) SELECT page, ordinal, target FROM l ANTI JOIN k USING (target)",
    "directory_rollup": "WITH v AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS s FROM pages WHERE contains(url, '://')), x AS (SELECT unnest(list_transform(range(1, len(s) + 1), lambda n: {'parent': array_to_string(s[1:n - 1], '/'), 'child': array_to_string(s[1:n], '/')}), recursive := true) FROM v) SELECT parent, count(DISTINCT child) AS children, count(*) AS entries FROM x GROUP BY parent",
    "requirement_links": f"WITH a AS (SELECT DISTINCT item_id, unnest({term_sql('text')}) AS term FROM benchmark), b AS (SELECT DISTINCT doc_id, unnest({term_sql(chr(115) + 'plit_part(coalesce(text, ' + chr(39) * 2 + '), chr(10), 1)')}) AS term FROM documents) SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (term) WHERE length(term) >= 7 GROUP BY ALL",
    "secret_findings": f"{_FIND} SELECT doc_id, rule, severity, line FROM f",
    "findings_by_rule": f"{_FIND} SELECT rule, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM f GROUP BY ALL",
    "findings_in_lines": _FIND.replace("string_split(text, chr(10))", "string_split(concat_ws(chr(10), text, [" + ", ".join(f"'{_quoted(x)}'" for x in LINES) + f"][doc_id % {len(LINES)} + 1]), chr(10))") + " SELECT doc_id, rule, severity, line FROM f",
    "snapshot_diff": f"WITH {_SNAP} SELECT path, status FROM df",
    "stale_check": f"WITH {_SNAP} SELECT bool_or(status <> 'unchanged') AS stale FROM df",
    "timestamp_carry_forward": f"WITH {_SNAP} SELECT n.path, n.hash, CASE WHEN t.hash = n.hash THEN '2020-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS timestamp FROM now_ n LEFT JOIN then_ t USING (path)",
    "corpus_digest": "WITH h AS (SELECT source, sha256(doc_id || chr(31) || text) AS h FROM documents), p AS (SELECT source, left(h, 2) AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL) SELECT source, left(sha256(string_agg(prefix || h, '' ORDER BY prefix)), 16) AS digest FROM p GROUP BY source",
    "latest_record_wins": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "community_jaccard_match": "WITH c AS (SELECT c_nationkey AS g, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS m FROM customer GROUP BY 1) SELECT 'n' || g AS grp, 'old' || g AS old_grp, round(m / n, 6) AS jaccard FROM c WHERE m / n >= 0.5",
    "moved_members": "SELECT c_custkey AS node, c_nationkey AS old_grp, 0 AS new_grp FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 0",
    "cochange_pairs": f"WITH {_CO} SELECT a, b, together FROM cp",
    "cochange_jaccard": f"WITH {_CO} SELECT a, b, together, x.n AS of_a, y.n AS of_b, round(together / (x.n + y.n - together), 6) AS jaccard FROM cp JOIN ce x ON a = x.f JOIN ce y ON b = y.f WHERE together >= 2",
    "cochange_recall": """WITH hf AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.5) AS half FROM orders), c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f, epoch_us(o_orderdate) > half AS later FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN hf),
      cs AS (SELECT k FROM c WHERE NOT later GROUP BY k HAVING count(*) BETWEEN 2 AND 10), ck AS (SELECT k, f FROM c SEMI JOIN cs USING (k)), cp AS (SELECT x.f AS a, y.f AS b, count(*) AS t FROM ck x JOIN ck y ON x.k = y.k AND x.f <> y.f GROUP BY ALL),
      top AS (SELECT a, b FROM cp QUALIFY row_number() OVER (PARTITION BY a ORDER BY t DESC, b) <= 5), sd AS (SELECT k, min(f) AS a FROM c WHERE later GROUP BY k HAVING count(*) BETWEEN 2 AND 10),
      g AS (SELECT c.k, sd.a, c.f AS b FROM c JOIN sd USING (k) WHERE f <> a), p AS (SELECT k, count(top.a) / count(*) AS r FROM g LEFT JOIN top USING (a, b) GROUP BY k) SELECT count(*) AS n, round(avg(r), 6) AS recall FROM p""",
    "components": """WITH RECURSIVE o AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1), l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS part FROM lineitem JOIN o ON l_orderkey = o.o),
      h AS (SELECT o, min(part) AS hub FROM l GROUP BY o), e AS (SELECT hub AS a, part AS b FROM l JOIN h USING (o) WHERE hub <> part), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT a AS root, a AS node FROM s UNION SELECT r.root, s.b FROM r JOIN s ON r.node = s.a) SELECT node, min(root) AS component FROM r GROUP BY node""",
}
