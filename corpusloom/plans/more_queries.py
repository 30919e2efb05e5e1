"""Communities, statistics and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import AREA, area_tag, code_lines, is_test_path
from corpusloom.operators import community, graph, pages, stats
from corpusloom.plans import graph_queries as gq
from corpusloom.plans.session import cut, table


def _links(spark, d):
    return graph.undirected(gq.edges(spark, d)).select(F.lit(0).alias("graph"), "a", "b", "weight")


def communities(spark, d):
    return community.communities(_links(spark, d)).select("node", "grp")


def community_quality(spark, d):
    """Modularity and number of disconnected groups, with and without refinement."""
    links, out = _links(spark, d), None
    for refine in (True, False):
        m = community.communities(links, refine=refine).select("node", "grp")
        row = graph.modularity(links, m).withColumn("refined", F.lit(refine)).join(F.broadcast(graph.disconnected_groups(links, m).agg(F.count("*").alias("disconnected"))))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("modularity", F.round("modularity", 6))


def bootstrap_ci(spark, d):
    """Share of the returned lines' price in all lines' price, orders resampled: whether its 95 % interval holds it and is as wide as theory says."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("r"), F.sum("l_extendedprice").alias("t"))
    found = cut(stats.bootstrap_ratio(rows, "r", "t"))  # one row, used twice
    # a ratio's variance over resampled instances is the sum of squared residuals over the squared total
    spread = rows.join(F.broadcast(found)).agg(F.sqrt(F.sum(F.pow(F.col("r") - F.col("estimate") * F.col("t"), F.lit(2.0)))).alias("s"), F.sum("t").alias("t"))  # one row
    width = (F.col("high") - F.col("low")) / (2 * 1.959964 * F.col("s") / F.col("t"))
    return found.join(F.broadcast(spread)).select(F.round("estimate", 6).alias("estimate"), ((F.col("low") < F.col("estimate")) & (F.col("estimate") < F.col("high"))).alias("holds"), (F.abs(width - 1) < 0.05).alias("as_wide"))


def mann_whitney(spark, d):
    c = table(spark, d, "customer")
    out = stats.mann_whitney(c, "c_acctbal", c["c_mktsegment"] == "BUILDING")
    return out.select("n1", "n2", F.round("u", 3).alias("u"), F.round("p", 5).alias("p"))


def wilcoxon(spark, d):
    o = table(spark, d, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("d")).select(F.round("d", 4).alias("d"))
    out = stats.wilcoxon(o, "d")
    return out.select("n", F.round("w", 1).alias("w"), F.round("p", 5).alias("p"))


_FORMS = ("tests/a{}.py", "src/test/b{}.py", "pkg/test_c{}.py", "pkg/d{}_test.py", "pkg/x{}/conftest.py", "lib/e{}.py", "lib/tests{}.py", "lib/testing/f{}.py")


def path_tags(spark, d):
    """Tests, lines of code and authentication matters of documents taken as files of eight forms of paths."""
    docs = table(spark, d, "documents")
    n = docs["doc_id"].cast("string")
    forms = F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in (f.split("{}") for f in _FORMS)])
    path = F.element_at(forms, (docs["doc_id"] % len(_FORMS) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(path.alias("path"), is_test_path(path).alias("is_test"), code_lines(text).cast("long").alias("loc"), area_tag(text).alias("auth"))


def document_check(spark, d):
    """Pages without a URL, and links that lead to no known word."""
    p = table(spark, d, "pages")
    links = gq._links(spark, d)
    docs = table(spark, d, "documents")
    known = docs.select(F.explode(F.split("text", r"[ \n]")).alias("w")).select(F.concat(F.lit("/"), "w").alias("key")).distinct()
    return pages.validate(p.select(F.col("page_id").alias("path"), F.col("url").alias("type")), links, known)


QUERIES = {f.__name__: f for f in (communities, community_quality, bootstrap_ci, mann_whitney, wilcoxon, path_tags, document_check)}

_TAIL = "round((1 / (1 + 0.3275911 * x)) * (0.254829592 + (1 / (1 + 0.3275911 * x)) * (-0.284496736 + (1 / (1 + 0.3275911 * x)) * (1.421413741 + (1 / (1 + 0.3275911 * x)) * (-1.453152027 + (1 / (1 + 0.3275911 * x)) * 1.061405429)))) * exp(-x * x), 5)::DOUBLE"

SQL = {
    "bootstrap_ci": "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS estimate, true AS holds, true AS as_wide FROM lineitem",
    "mann_whitney": f"""WITH r AS (SELECT c_acctbal AS v, c_mktsegment = 'BUILDING' AS g FROM customer), t AS (SELECT v, count(*)::DOUBLE AS t, count(*) FILTER (g) AS k FROM r GROUP BY v),
      w AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM t),
      s AS (SELECT CAST(sum(k) AS BIGINT) AS n1, CAST(sum(t) - sum(k) AS BIGINT) AS n2, sum(k * rk) AS r1, sum(t * t * t - t) AS ties FROM w),
      u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE))) AS var FROM s),
      x AS (SELECT *, abs(u - n1 * n2 / 2) / sqrt(var) / sqrt(2) AS x FROM u) SELECT n1, n2, round(u, 3) AS u, {_TAIL} AS p FROM x""",
    "wilcoxon": f"""WITH d AS (SELECT round(l_discount - l_tax, 4) AS d FROM lineitem), t AS (SELECT abs(d) AS v, count(*)::DOUBLE AS t, count(*) FILTER (d > 0) AS k FROM d WHERE d <> 0 GROUP BY 1),
      w AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM t),
      s AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(k * rk) AS w, sum(t * t * t - t) AS ties FROM w),
      x AS (SELECT n, w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM s) SELECT n, round(w, 1) AS w, {_TAIL} AS p FROM x""",
    "path_tags": "SELECT replace([" + ", ".join(f"'{f}'" for f in _FORMS) + f"""][doc_id % {len(_FORMS)} + 1], '{{}}', doc_id::VARCHAR) AS path, doc_id % 8 IN (0, 1, 2, 3, 4, 7) AS is_test,
      len(list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')))::BIGINT AS loc, regexp_matches(coalesce(text, ''), '{AREA}') AS auth FROM documents""",
    "document_check": f"WITH {gq._LINKS}, k AS (SELECT DISTINCT '/' || unnest(string_split_regex(text, '[ \\n]')) AS target FROM documents) SELECT (SELECT count(*) FROM pages WHERE coalesce(url, '') = '') AS untyped, (SELECT count(*) FROM l ANTI JOIN k USING (target)) AS broken, (SELECT count(*) FROM pages WHERE coalesce(url, '') = '') = 0 AND (SELECT count(*) FROM l ANTI JOIN k USING (target)) = 0 AS valid",
}
