"""Search, fusion and evaluation over documents and benchmark passages.

A document's name is its first line, its doc field the first 240 characters, its
body the whole text; its metadata are title (first line), description (first
paragraph), tags (language, source) and, as it is defined, the first 4,000
characters of the text. Each benchmark passage is a query, and the documents that
contain it are its gold.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import STOP_WORDS, first_line, one_paragraph, terms
from corpusloom.operators import fusion, metrics, pages, search
from corpusloom.plans.session import cut, spread, table

TOP = 10


def documents(spark: SparkSession, d: str) -> DataFrame:
    """To be tokenised, so on all cores."""
    return spread(table(spark, d, "documents"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return search.query_terms(b, "item_id", b["text"])


def fields(docs: DataFrame) -> dict:
    return {"name": first_line(docs["text"]), "doc": F.left(docs["text"], F.lit(240)), "body": docs["text"]}


#: Fixed value: characters of a text in its metadata document.
METADATA_TEXT = 4000


def metadata(docs: DataFrame):
    return F.concat_ws(" ", first_line(docs["text"]), one_paragraph(docs["text"]), docs["lang"], docs["source"], F.left(docs["text"], F.lit(METADATA_TEXT)))


def bm25_scores(spark, d):
    docs = documents(spark, d)
    return search.bm25(docs, "doc_id", metadata(docs), asked(spark, d))


def bm25f_scores(spark, d):
    docs = documents(spark, d)
    return search.bm25f(docs, "doc_id", fields(docs), asked(spark, d))


def bm25_best(spark, d):
    docs = documents(spark, d)
    return search.bm25_top(docs, "doc_id", metadata(docs), asked(spark, d), TOP)


def bm25f_best(spark, d):
    docs = documents(spark, d)
    return search.bm25f_top(docs, "doc_id", fields(docs), asked(spark, d), TOP)


def tfidf_best(spark, d):
    docs = documents(spark, d)
    return search.tfidf_top(docs, "doc_id", docs["text"], asked(spark, d), TOP)


def named(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in more])


def tokens_tf(spark, d):
    docs = documents(spark, d)
    return search.term_frequency(docs, "doc_id", docs["text"]).withColumnRenamed("doc", "doc_id")


def doc_freq_idf(spark, d):
    docs = documents(spark, d)
    return search.document_frequency(search.term_frequency(docs, "doc_id", docs["text"]), docs).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, d):
    return named(bm25_best(spark, d), "score")


def okapi_topk(spark, d):
    """BM25 over the whole texts."""
    docs = documents(spark, d)
    return named(search.bm25_top(docs, "doc_id", docs["text"], asked(spark, d), TOP), "score")


def bm25f_topk(spark, d):
    return named(bm25f_best(spark, d), "score")


def tfidf_cosine_topk(spark, d):
    return named(tfidf_best(spark, d), "score")


def bm25f_field_share(spark, d):
    docs = documents(spark, d)
    hits = bm25f_best(spark, d)
    share = search.field_share(docs, "doc_id", fields(docs), asked(spark, d), hits)
    return share.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), "field", F.round("share", 6).alias("share"))


def boosts(spark, d):
    """1 + 0.6 for quality, 0 for toxic documents."""
    labels = table(spark, d, "labels")
    return labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.when(F.col("toxic") == 1, 0.0).otherwise(1.0 + 0.6 * F.col("quality"))).alias("boost"))


def boosted_search(spark, d):
    return named(search.best(search.boosted(bm25f_scores(spark, d), boosts(spark, d)), TOP), "score")


def adaptive_entries(spark, d):
    return named(search.entries(search.best(bm25f_scores(spark, d), None)), "score")


def strong_band(spark, d):
    return named(search.strong_band(search.best(bm25f_scores(spark, d), None)), "band")


def rrf_fusion(spark, d):
    a, b = bm25_best(spark, d), bm25f_best(spark, d)
    return named(fusion.reciprocal_rank([a, b]), "score")


def interleave_hybrid(spark, d):
    return named(fusion.interleave(bm25_best(spark, d), bm25f_best(spark, d)))


def rank_completion(spark, d):
    """The ten best, completed by the other documents of their sources in order of their ids."""
    docs = documents(spark, d)
    head = bm25f_best(spark, d)
    sources = head.join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc").select("query_id", "source").distinct()
    pool = sources.join(docs.select(F.col("doc_id").alias("doc"), "source"), "source").select("query_id", "doc")
    pool = pool.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc")))
    return named(fusion.complete(head, pool))


def gold(spark, d):
    docs, b = documents(spark, d), table(spark, d, "benchmark")
    return pages.containing(b, "item_id", b["text"], docs, "doc_id", docs["text"]).toDF("query_id", "doc")


def gold_pairs(spark, d):
    return gold(spark, d).toDF("item_id", "doc_id")


def rankings(spark, d) -> DataFrame:
    docs = documents(spark, d)
    a, b, t = map(cut, search.three_tops(docs, "doc_id", metadata(docs), fields(docs), asked(spark, d), TOP))  # ten rows a query, used twice
    cols = ["query_id", "doc", "rank"]
    out = [x.select(*cols, F.lit(m).alias("method")) for x, m in ((a, "bm25"), (b, "bm25f"), (t, "tfidf"), (fusion.reciprocal_rank([a, b]), "rrf"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def judged(spark, d) -> DataFrame:
    methods = spark.createDataFrame([("bm25",), ("bm25f",), ("tfidf",), ("rrf",)], "method string")
    return metrics.per_query(metrics.gold_ranks(rankings(spark, d), gold(spark, d), methods))


def retrieval_metrics(spark, d):
    return judged(spark, d).groupBy("method").agg(*metrics.means())


def metrics_by_group(spark, d):
    return judged(spark, d).cube("method", "n_gold").agg(F.grouping_id().cast("long").alias("level"), *metrics.means())


def mcnemar_exact(spark, d):
    return metrics.paired(judged(spark, d), "bm25", "bm25f", "acc10")


def recovered_pushed(spark, d):
    """Gold documents that the second method has in its first ten and the first has not, and the reverse."""
    methods = spark.createDataFrame([("bm25",), ("bm25f",)], "method string")
    r = metrics.gold_ranks(rankings(spark, d), gold(spark, d), methods)
    wide = r.groupBy("query_id", "doc").agg(F.max(F.when((F.col("method") == "bm25") & (F.col("rank") <= 10), 1).otherwise(0)).alias("a"), F.max(F.when((F.col("method") == "bm25f") & (F.col("rank") <= 10), 1).otherwise(0)).alias("b"))
    return wide.agg(F.count_if(F.col("b") > F.col("a")).alias("recovered"), F.count_if(F.col("a") > F.col("b")).alias("pushed_out"))


def flags(spark, d):
    r = rankings(spark, d).where("method <> 'rrf'").groupBy("query_id", "doc").agg(*[F.max(F.col("method") == m).alias(m) for m in ("bm25", "bm25f", "tfidf")])
    return r.join(gold(spark, d).withColumn("is_gold", F.lit(True)), ["query_id", "doc"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


def venn_provenance(spark, d):
    return flags(spark, d).groupBy("bm25", "bm25f", "tfidf").agg(F.count("*").alias("n"), F.count_if("is_gold").alias("gold"))


def precision_lift(spark, d):
    """Pooled precision of each method, and its ratio to that of metadata BM25."""
    r = rankings(spark, d).join(gold(spark, d).withColumn("g", F.lit(1)), ["query_id", "doc"], "left")
    by = cut(r.groupBy("method").agg(F.sum(F.coalesce("g", F.lit(0))).alias("hits"), F.count("*").alias("n")))  # four rows, used twice
    base = by.where("method = 'bm25'").select(F.col("hits").alias("h0"), F.col("n").alias("n0"))
    both = by.join(F.broadcast(base))  # one row
    return both.select("method", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.try_divide(F.col("hits") * F.col("n0"), F.col("n") * F.col("h0")), 6).alias("lift"))


def oracle_union(spark, d):
    """Best recall at 10 that any order of all methods' documents could have."""
    g = cut(gold(spark, d))  # used twice
    found = rankings(spark, d).select("query_id", "doc").distinct().join(g, ["query_id", "doc"]).groupBy("query_id").agg(F.count("*").alias("k"))
    all_ = g.groupBy("query_id").agg(F.count("*").alias("n")).join(found, "query_id", "left")
    return all_.select(F.col("query_id").alias("item_id"), F.round(F.least(F.coalesce("k", F.lit(0)), F.lit(10)) / F.col("n"), 6).alias("recall"))


def depth_curve(spark, d):
    r = rankings(spark, d).join(gold(spark, d), ["query_id", "doc"]).groupBy("method", "rank").agg(F.count("*").alias("n"))
    return r.select("method", F.col("rank").cast("long").alias("rank"), F.sum("n").over(W.partitionBy("method").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)).alias("hits"))


def spearman_ranks(spark, d):
    docs = documents(spark, d)
    rows = docs.select("lang", F.length("text").alias("x"), F.size(terms(docs["text"])).alias("y")).where("x is not null")
    return metrics.spearman(rows, ["lang"], "x", "y").withColumn("rho", F.round("rho", 6))


QUERIES = {
    f.__name__: f
    for f in (
        tokens_tf, doc_freq_idf, bm25_topk, okapi_topk, bm25f_topk, bm25f_field_share, tfidf_cosine_topk, boosted_search, adaptive_entries, strong_band, rrf_fusion,
        interleave_hybrid, rank_completion, gold_pairs, retrieval_metrics, metrics_by_group, mcnemar_exact, recovered_pushed, venn_provenance,
        precision_lift, oracle_union, depth_curve, spearman_ranks,
    )
}


@cache
def term_sql(text: str) -> str:
    """Terms of a text; RE2 has no look-ahead, so case changes are cut first."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    raw = rf"list_transform(regexp_extract_all(regexp_replace(coalesce({text}, ''), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda t: lower(t))"
    kept = f"list_filter({raw}, lambda t: length(t) >= 2 AND t NOT IN ({stop}))"
    return f"list_transform({kept}, lambda t: CASE WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN substr(t, 1, length(t) - 1) ELSE t END)"


def _rank(score: str = "score") -> str:
    return f"CAST(row_number() OVER (PARTITION BY q ORDER BY round({score}, 9) DESC, doc) AS BIGINT)"


_BASE = f"""
n AS (SELECT count(*) AS n FROM documents),
q0 AS (SELECT item_id AS q, unnest({term_sql('text')}) AS term FROM benchmark),
qt AS (SELECT q, term, count(*) AS times FROM q0 GROUP BY ALL)"""

_METADATA = rf"concat_ws(' ', split_part(coalesce(text, ''), chr(10), 1), left(regexp_replace(trim(split_part(trim(text), chr(10) || chr(10), 1)), '\s+', ' ', 'g'), 240), lang, source, left(text, {METADATA_TEXT}))"
_BM25 = f"""
m0 AS (SELECT doc_id AS doc, {term_sql(_METADATA)} AS ts FROM documents),
mtf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM m0) GROUP BY ALL),
mdf AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM mtf GROUP BY term),
a AS (
  SELECT q, doc, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / (SELECT avg(len(ts)) FROM m0)))) AS score
  FROM mtf JOIN qt USING (term) JOIN mdf USING (term) JOIN m0 USING (doc) GROUP BY ALL
), ra AS (SELECT *, {_rank()} AS rank FROM a)"""

_BM25F = f"""
g AS (
  SELECT doc_id AS doc, unnest([
    {{'field': 'name', 'w': 3.0::DOUBLE, 'ts': {term_sql("split_part(coalesce(text, ''), chr(10), 1)")}}},
    {{'field': 'doc', 'w': 2.0::DOUBLE, 'ts': {term_sql('left(text, 240)')}}},
    {{'field': 'body', 'w': 1.0::DOUBLE, 'ts': {term_sql('text')}}}], recursive := true) FROM documents
), av AS (SELECT field, avg(len(ts)) AS mean FROM g GROUP BY field),
ft AS (SELECT doc, field, w, len(ts) AS l, unnest(ts) AS term FROM g),
fp AS (SELECT doc, field, term, w * count(*) / (0.25 + 0.75 * l / CASE WHEN mean = 0 THEN 1 ELSE mean END) AS fv FROM ft JOIN av USING (field) GROUP BY doc, field, w, l, mean, term),
p AS (SELECT doc, term, sum(fv) AS v FROM fp GROUP BY ALL),
fdf AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
pt AS (SELECT q, doc, term, v, times * idf * v / (1.2 + v) AS part FROM p JOIN qt USING (term) JOIN fdf USING (term)),
b AS (SELECT q, doc, sum(part) AS score FROM pt GROUP BY ALL),
rb AS (SELECT *, {_rank()} AS rank FROM b)"""

_TFIDF = f"""
btf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({term_sql('text')}) AS term FROM documents) GROUP BY ALL),
bdf AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) AS idf FROM btf GROUP BY term),
bv AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM btf JOIN bdf USING (term)),
bn AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM bv GROUP BY doc),
qv AS (SELECT q, term, (1 + ln(times)) * idf AS w FROM qt JOIN bdf USING (term)),
qn AS (SELECT q, sqrt(sum(w * w)) AS norm FROM qv GROUP BY q),
c AS (SELECT q, doc, sum(bv.w / bn.norm * qv.w / qn.norm) AS score FROM bv JOIN qv USING (term) JOIN bn USING (doc) JOIN qn USING (q) WHERE bn.norm > 0 AND qn.norm > 0 GROUP BY ALL HAVING sum(bv.w * qv.w) > 0),
rc AS (SELECT *, {_rank()} AS rank FROM c)"""

_RRF = f"""
f0 AS (SELECT q, doc, rank, rank AS first FROM ra WHERE rank <= 10 UNION ALL SELECT q, doc, rank, NULL FROM rb WHERE rank <= 10),
f AS (SELECT q, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(first) AS first FROM f0 GROUP BY ALL),
rf AS (SELECT q, doc, score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first NULLS LAST, doc) AS BIGINT) AS rank FROM f)"""

_GOLD = """
gold AS (SELECT DISTINCT item_id AS q, doc_id AS doc FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))"""

_ALL = """
r AS (
  SELECT 'bm25' AS method, q, doc, rank FROM ra WHERE rank <= 10 UNION ALL SELECT 'bm25f', q, doc, rank FROM rb WHERE rank <= 10
  UNION ALL SELECT 'tfidf', q, doc, rank FROM rc WHERE rank <= 10 UNION ALL SELECT 'rrf', q, doc, rank FROM rf
), ms AS (SELECT unnest(['bm25', 'bm25f', 'tfidf', 'rrf']) AS method),
gr AS (SELECT gold.q, gold.doc, method, rank FROM gold CROSS JOIN ms LEFT JOIN r USING (q, doc, method)),
pq AS (
  SELECT q, method, count(*) AS n_gold, coalesce(1 / min(rank), 0) AS rr, count(*) FILTER (rank <= 5) = count(*) AS acc5, count(*) FILTER (rank <= 5) / count(*) AS recall5, count(*) FILTER (rank <= 5) > 0 AS hit5,
         count(*) FILTER (rank <= 10) = count(*) AS acc10, count(*) FILTER (rank <= 10) / count(*) AS recall10, count(*) FILTER (rank <= 10) > 0 AS hit10
  FROM gr GROUP BY ALL
)"""
_EVAL = ",".join((_BASE, _BM25, _BM25F, _TFIDF, _RRF, _GOLD, _ALL))
_MEANS = "count(*) AS n, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(acc{k}::INT), 6) AS acc{k}, round(avg(recall{k}), 6) AS recall{k}, round(avg(hit{k}::INT), 6) AS hit{k}" for k in (5, 10))


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_OUT = "q AS item_id, doc AS doc_id, rank"
SQL = {
    "tokens_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({term_sql('text')}) AS term FROM documents) GROUP BY ALL",
    "doc_freq_idf": f"WITH t AS (SELECT DISTINCT doc_id, unnest({term_sql('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term",
    "bm25_topk": _with(_BASE, _BM25) + f" SELECT {_OUT}, round(score, 6) AS score FROM ra WHERE rank <= 10",
    "okapi_topk": _with(_BASE, _BM25.replace(_METADATA, "text")) + f" SELECT {_OUT}, round(score, 6) AS score FROM ra WHERE rank <= 10",
    "bm25f_topk": _with(_BASE, _BM25F) + f" SELECT {_OUT}, round(score, 6) AS score FROM rb WHERE rank <= 10",
    "tfidf_cosine_topk": _with(_BASE, _TFIDF) + f" SELECT {_OUT}, round(score, 6) AS score FROM rc WHERE rank <= 10",
    "bm25f_field_share": _with(_BASE, _BM25F) + ", s AS (SELECT q, doc, field, sum(part * fv / v) AS got FROM pt JOIN fp USING (doc, term) JOIN rb USING (q, doc) WHERE rank <= 10 GROUP BY ALL) SELECT q AS item_id, doc AS doc_id, field, round(got / sum(got) OVER (PARTITION BY q, doc), 6) AS share FROM s",
    "boosted_search": _with(_BASE, _BM25F) + f", l AS (SELECT doc_id AS doc, max(CASE WHEN toxic = 1 THEN 0 ELSE 1.0 + 0.6 * quality END)::DOUBLE AS boost FROM labels GROUP BY 1), s AS (SELECT q, doc, score * coalesce(boost, 1) AS score FROM b LEFT JOIN l USING (doc)), z AS (SELECT *, {_rank()} AS rank FROM s WHERE score > 0) SELECT {_OUT}, round(score, 6) AS score FROM z WHERE rank <= 10",
    "adaptive_entries": _with(_BASE, _BM25F) + f", z AS (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM rb) SELECT {_OUT}, round(score, 6) AS score FROM z WHERE (score >= 0.5 * top OR rank = 1) AND rank <= 4",
    "strong_band": _with(_BASE, _BM25F) + f", z AS (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM rb) SELECT {_OUT}, round(90 + score / top, 6) AS band FROM z WHERE score >= 0.5 * top",
    "rrf_fusion": _with(_BASE, _BM25, _BM25F, _RRF) + f" SELECT {_OUT}, round(score, 6) AS score FROM rf",
    "interleave_hybrid": _with(_BASE, _BM25, _BM25F)
    + ", x AS (SELECT q, doc, rank, 2 * rank - 1 AS at_ FROM ra WHERE rank <= 10), y AS (SELECT q, doc, rank, 2 * rank AS at_ FROM rb WHERE rank <= 10), l AS (SELECT q, least(mx, my) AS l FROM (SELECT q, max(rank) AS mx FROM x GROUP BY q) JOIN (SELECT q, max(rank) AS my FROM y GROUP BY q) USING (q)), u AS (SELECT q, doc, min(at_) AS at_ FROM (FROM x UNION ALL FROM y) JOIN l USING (q) WHERE rank <= l GROUP BY ALL) SELECT q AS item_id, doc AS doc_id, CAST(row_number() OVER (PARTITION BY q ORDER BY at_) AS BIGINT) AS rank FROM u",
    "rank_completion": _with(_BASE, _BM25F)
    + ", h AS (SELECT q, doc, rank, source FROM rb JOIN documents ON doc = doc_id WHERE rank <= 10), s AS (SELECT DISTINCT q, source FROM h), z AS (SELECT s.q, d.doc_id AS doc, h.rank FROM s JOIN documents d USING (source) LEFT JOIN h ON h.q = s.q AND h.doc = d.doc_id) SELECT q AS item_id, doc AS doc_id, CAST(row_number() OVER (PARTITION BY q ORDER BY rank NULLS LAST, doc) AS BIGINT) AS rank FROM z",
    "gold_pairs": "WITH " + _GOLD + " SELECT q AS item_id, doc AS doc_id FROM gold",
    "retrieval_metrics": f"WITH {_EVAL} SELECT method, {_MEANS} FROM pq GROUP BY method",
    "metrics_by_group": f"WITH {_EVAL} SELECT method, n_gold, CAST(grouping(method, n_gold) AS BIGINT) AS level, {_MEANS} FROM pq GROUP BY CUBE (method, n_gold)",
    "mcnemar_exact": f"""WITH {_EVAL}, w AS (SELECT q, bool_or(acc10) FILTER (method = 'bm25') AS a, bool_or(acc10) FILTER (method = 'bm25f') AS b FROM pq GROUP BY q),
      k AS (SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM w)
      SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: gamma(only_a + only_b + 1) / gamma(i + 1) / gamma(only_a + only_b - i + 1) * pow(0.5, only_a + only_b)))) END, 9)::DOUBLE AS p FROM k""",
    "recovered_pushed": f"WITH {_EVAL}, w AS (SELECT q, doc, max((method = 'bm25' AND coalesce(rank, 99) <= 10)::INT) AS a, max((method = 'bm25f' AND coalesce(rank, 99) <= 10)::INT) AS b FROM gr GROUP BY ALL) SELECT count(*) FILTER (b > a) AS recovered, count(*) FILTER (a > b) AS pushed_out FROM w",
    "venn_provenance": f"WITH {_EVAL}, w AS (SELECT q, doc, bool_or(method = 'bm25') AS bm25, bool_or(method = 'bm25f') AS bm25f, bool_or(method = 'tfidf') AS tfidf FROM r WHERE method <> 'rrf' GROUP BY ALL) SELECT bm25, bm25f, tfidf, count(*) AS n, count(gold.q) AS gold FROM w LEFT JOIN gold USING (q, doc) GROUP BY ALL",
    "precision_lift": f"WITH {_EVAL}, w AS (SELECT method, count(gold.q) AS hits, count(*) AS n FROM r LEFT JOIN gold USING (q, doc) GROUP BY method), o AS (SELECT hits AS h0, n AS n0 FROM w WHERE method = 'bm25') SELECT method, hits, n, round(hits / n, 6) AS precision, round(hits * n0 / nullif(n * h0, 0), 6) AS lift FROM w CROSS JOIN o",
    "oracle_union": f"WITH {_EVAL}, k AS (SELECT q, count(*) AS k FROM (SELECT DISTINCT q, doc FROM r) JOIN gold USING (q, doc) GROUP BY q) SELECT gold.q AS item_id, round(least(coalesce(any_value(k), 0), 10) / count(*), 6) AS recall FROM gold LEFT JOIN k ON k.q = gold.q GROUP BY gold.q",
    "depth_curve": f"WITH {_EVAL}, w AS (SELECT method, rank, count(*) AS n FROM r JOIN gold USING (q, doc) GROUP BY ALL) SELECT method, rank, CAST(sum(n) OVER (PARTITION BY method ORDER BY rank) AS BIGINT) AS hits FROM w",
    "spearman_ranks": f"""WITH t AS (SELECT lang, length(text) AS x, len({term_sql('text')}) AS y FROM documents WHERE text IS NOT NULL),
      k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS ry FROM t)
      SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY lang""",
}
