"""Context retrieval over documents: groups are sources, a document depends on the next one of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import order, retrieve, search
from corpusloom.plans import graph_queries as gq
from corpusloom.plans import text_queries as tq
from corpusloom.plans.session import cut, table


def tests(labels: DataFrame) -> DataFrame:
    """doc of what is tagged as a test. labels: doc_id, toxic."""
    return labels.where("toxic = 1").select(F.col("doc_id").alias("doc"))


def _meeting(spark, d) -> search.Meeting:
    rows = tq.documents(spark, d)
    return search.Meeting(rows, "doc_id", tq.fields(rows), tq.asked(spark, d))


def _tables(spark, d, hits: DataFrame | None = None, met: search.Meeting | None = None):
    """hits (those that can be entries or strong), concepts, edges, members."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    placed = cut(order.arranged(docs, ["source"], [F.col("doc_id")], following={"next": "doc_id"}, place="at"))  # met by several branches
    members = placed.select(F.col("source").alias("grp"), F.col("doc_id").alias("doc"), "at")
    edges = placed.select(F.col("doc_id").alias("src"), F.col("next").alias("dst"), (1 + F.col("n_chars") % 5).alias("weight")).where("dst is not null")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    tags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "test"), F.when(F.col("quality") == 1, "security:reviewed")))
    concepts = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("doc"), tags.alias("tags"), F.lit(1).alias("fan_in"))
    if hits is None:
        met = met or _meeting(spark, d)
        hits = cut(search.best(met.strong("bm25f", list(met.fields), tests(labels)), None))
    return hits, concepts, edges, members


def _gather(spark, d, task, expansion="walk"):
    met = _meeting(spark, d)
    texts = lambda pairs: met.some({"score": ("bm25f", list(met.fields))}, pairs)  # noqa: E731 - of what the walk by mass reaches alone
    out = retrieve.gather(*_tables(spark, d, met=met), task, retrieve.Settings(expansion=expansion), texts=texts)
    return out.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


def gather_feature(spark, d):
    return _gather(spark, d, "feature")


def gather_bug(spark, d):
    return _gather(spark, d, "bug")


def gather_security(spark, d):
    return _gather(spark, d, "security")


def gather_refactor(spark, d):
    return _gather(spark, d, "refactor")


def gather_ppr(spark, d):
    return _gather(spark, d, "bug", "ppr")


def context_pack(spark, d):
    """The whole ranking of gather_feature packed into 16,000 characters."""
    ranked = retrieve.gather(*_tables(spark, d), "feature", retrieve.Settings(expansion="walk"))
    sizes = tq.documents(spark, d).select(F.col("doc_id").alias("doc"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    out = retrieve.pack(ranked.join(sizes, "doc").select("query_id", "doc", "position", "size"), 16000)
    return out.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), F.col("position").cast("long").alias("position"), "packed")


QUERIES = {f.__name__: f for f in (gather_feature, gather_bug, gather_security, gather_refactor, gather_ppr, context_pack)}

_T = (
    tq._BASE
    + ","
    + tq._BM25F
    + """,
lb AS (SELECT doc_id AS doc, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
tests AS (SELECT doc FROM lb WHERE toxic = 1), flagged AS (SELECT doc FROM lb WHERE quality = 1),
mem AS (SELECT source AS grp, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS at_ FROM documents),
ed AS (SELECT a.doc AS src, b.doc AS dst FROM mem a JOIN mem b ON a.grp = b.grp AND b.at_ = a.at_ + 1),
h0 AS (SELECT q, doc, score, rank FROM rb ANTI JOIN tests USING (doc)),
h AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank, max(score) OVER (PARTITION BY q) AS top FROM h0),
en AS (SELECT q, doc, score, rank AS place FROM h WHERE rank <= 4 AND (score >= 0.5 * top OR rank = 1)),
st AS (SELECT q, doc, 90 + score / top AS score, 5 AS branch, rank AS at_ FROM h ANTI JOIN en USING (q, doc) WHERE score >= 0.5 * top),
br AS (SELECT q, doc, 100 + score AS score, 1 AS branch, place AS at_ FROM en UNION ALL FROM st"""
)


def _bfs_sql(a: str, b: str, depth: int, base: int) -> str:
    parts, frm = [], "(SELECT q, doc AS x FROM en)"
    for k in range(1, depth + 1):
        frm = f"(SELECT q, {b} AS x FROM {frm} JOIN ed ON {a} = x)"
        parts.append(f"SELECT q, x AS doc, {k} AS dist FROM {frm}")
    inner = " UNION ALL ".join(parts)
    return f" UNION ALL SELECT q, doc, {base} - 10 * min(dist), 2, min(dist) FROM ({inner}) ANTI JOIN en USING (q, doc) GROUP BY q, doc"


_END = """), br2 AS (SELECT * FROM br ANTI JOIN tests USING (doc)),
z AS (SELECT q, doc, max(score)::DOUBLE AS score, min((branch, at_)) AS first FROM br2 GROUP BY ALL),
gathered AS (SELECT q AS item_id, doc AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, first, doc) AS position FROM z)"""

_FEATURE = _T + " UNION ALL SELECT q, dst, 40, 4, place FROM en JOIN ed ON src = doc UNION ALL SELECT q, mem.doc, 51 - at_, 3, v * 100 + at_ FROM (SELECT q, grp, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, min(place)) AS v FROM en JOIN mem USING (doc) GROUP BY q, grp) JOIN mem USING (grp) WHERE v <= 2 AND at_ <= 8" + _END

_PPR = gq._walk_sql(
    "SELECT u, v, w FROM (SELECT src AS u, dst AS v, w * 1.0::DOUBLE AS w FROM ew UNION ALL SELECT dst, src, w * 0.5::DOUBLE FROM ew)", "(SELECT q AS seed_set, doc AS node FROM en)", 0.15, retrieve.Settings().rounds
).replace("st AS (", "sd AS (").replace("FROM st", "FROM sd")
_PPR_SQL = f"""{_T[: _T.index("br AS (")]}
ew AS (SELECT src, dst, 1 + n_chars % 5 AS w FROM ed JOIN documents ON doc_id = src WHERE src NOT IN (SELECT doc FROM tests) AND dst NOT IN (SELECT doc FROM tests)), {_PPR},
ra8 AS (SELECT seed_set AS q, node AS doc, mass * (1 + coalesce(score / top, 0)) AS sc FROM r{retrieve.Settings().rounds} LEFT JOIN h ON h.q = seed_set AND h.doc = node ANTI JOIN en ON en.q = seed_set AND en.doc = node),
ex AS (SELECT q, doc, sc, row_number() OVER (PARTITION BY q ORDER BY sc DESC, doc) AS k, max(sc) OVER (PARTITION BY q) AS best FROM ra8 WHERE sc > 0),
br AS (SELECT q, doc, 100 + score AS score, 1 AS branch, place AS at_ FROM en UNION ALL FROM st UNION ALL SELECT q, doc, 10 + 70 * sc / best, 2, k FROM ex WHERE k <= 25
  UNION ALL SELECT q, src, 45, 3, place FROM en JOIN ed ON dst = doc SEMI JOIN tests ON tests.doc = src"""

SQL = {
    "gather_ppr": "WITH " + _PPR_SQL + _END + " SELECT * FROM gathered",
    "gather_feature": "WITH " + _FEATURE + " SELECT * FROM gathered",
    "gather_bug": "WITH " + _T + _bfs_sql("src", "dst", 2, 60) + " UNION ALL SELECT q, src, 45, 3, place FROM en JOIN ed ON dst = doc SEMI JOIN tests ON tests.doc = src" + _END + " SELECT * FROM gathered",
    "gather_security": "WITH " + _T + _bfs_sql("dst", "src", 2, 70) + " UNION ALL SELECT q, dst, 50, 4, place FROM en JOIN ed ON src = doc SEMI JOIN flagged ON flagged.doc = dst UNION ALL SELECT q, m2.doc, 55, 3, place * 1000 + m2.at_ FROM en JOIN mem m1 USING (doc) JOIN mem m2 USING (grp) SEMI JOIN flagged ON flagged.doc = m2.doc" + _END + " SELECT * FROM gathered",
    "gather_refactor": "WITH " + _T + _bfs_sql("dst", "src", 3, 80) + _END + " SELECT * FROM gathered",
    "context_pack": "WITH RECURSIVE " + _FEATURE + """,
      i AS (SELECT item_id AS q, doc_id AS doc, position AS rank, length(coalesce(text, '')) AS size FROM gathered JOIN documents USING (doc_id)),
      k AS (SELECT q, doc, rank, size <= 16000 AS packed, CASE WHEN size <= 16000 THEN size ELSE 0 END AS used FROM i WHERE rank = 1
            UNION ALL SELECT i.q, i.doc, i.rank, used + size <= 16000, CASE WHEN used + size <= 16000 THEN used + size ELSE used END FROM k JOIN i ON i.q = k.q AND i.rank = k.rank + 1)
      SELECT q AS item_id, doc AS doc_id, rank AS position, packed FROM k""",
}
