"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import backoff_lm, exact_dedup, language_id, licences, line_templates, mixing, near_dedup, piece_transducer, rp_forest, toxicity, url_filter, vector_codes, whitening
from corpusloom.plans.session import table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(table(spark, sf_dir, "embeddings"))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_lm.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.split_predict(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    return licences.scan(docs, path, docs["text"], {"doc_id": docs["doc_id"]})


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.report(table(spark, sf_dir, "documents"), piece_transducer.read_model())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placements(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.split_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS k,
         min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM n
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS ss FROM w
), e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM o WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT doc_id AS root, doc_id FROM s UNION SELECT r.root, l.y FROM r JOIN l ON r.doc_id = l.x)
SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
g AS (SELECT r, i, w AS g1, lag(w, 1) OVER p AS b, lag(w, 2) OVER p AS a FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
o AS (SELECT r, i, g1, b, a || ' ' || b AS ab, b || ' ' || g1 AS g2, a || ' ' || b || ' ' || g1 AS g3 FROM g),
c1 AS (SELECT g1 AS k, count(*) AS n FROM o GROUP BY 1), c2 AS (SELECT g2 AS k, count(*) AS n FROM o WHERE g2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT g3 AS k, count(*) AS n FROM o WHERE g3 IS NOT NULL GROUP BY 1),
m1 AS (SELECT r, g1 AS k, count(*) AS n FROM o GROUP BY ALL), m2 AS (SELECT r, g2 AS k, count(*) AS n FROM o WHERE g2 IS NOT NULL GROUP BY ALL),
m3 AS (SELECT r, g3 AS k, count(*) AS n FROM o WHERE g3 IS NOT NULL GROUP BY ALL),
e1 AS (SELECT r, k, c1.n - m1.n AS f FROM m1 JOIN c1 USING (k)), e2 AS (SELECT r, k, c2.n - m2.n AS f FROM m2 JOIN c2 USING (k)), e3 AS (SELECT r, k, c3.n - m3.n AS f FROM m3 JOIN c3 USING (k)),
s AS (
  SELECT o.r, ln(CASE WHEN f3.f > 0 THEN f3.f / x2.f WHEN f2.f > 0 THEN f2.f / x1.f * CASE WHEN g3 IS NULL THEN 1 ELSE 0.4 END
         ELSE greatest(f1.f, 1) / greatest((SELECT count(*) FROM o) - len(d.ws), 1) * CASE WHEN g3 IS NOT NULL THEN 0.4 * 0.4 WHEN g2 IS NOT NULL THEN 0.4 ELSE 1 END END) AS l
  FROM o JOIN d USING (r) JOIN e1 f1 ON f1.r = o.r AND f1.k = g1 LEFT JOIN e2 f2 ON f2.r = o.r AND f2.k = g2 LEFT JOIN e3 f3 ON f3.r = o.r AND f3.k = g3
  LEFT JOIN e1 x1 ON x1.r = o.r AND x1.k = b LEFT JOIN e2 x2 ON x2.r = o.r AND x2.k = ab
), z AS (SELECT r, sum(l) AS l FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(coalesce(l, 0), 4) AS log_score, round(l / len(ws), 6) AS mean_log_score FROM d LEFT JOIN z USING (r)
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licences.TEMPLATES))

OP6_SQL = rf"""
WITH tpl(t, licence, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT t, licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM tpl),
ttf AS (SELECT t, licence, word, count(*) AS tf FROM tw GROUP BY ALL),
df AS (SELECT word, ln((1 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY word),
tr AS (SELECT t, licence, word, tf * idf AS w, sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY t)) AS norm FROM ttf JOIN df USING (word)),
f AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, coalesce(text, '') AS text FROM documents),
g AS (SELECT path, regexp_replace(text, '(?m){licences.MARKS}', '', 'g') AS text FROM f WHERE regexp_matches(text, '{licences.CUES}')),
p AS (
  SELECT path, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licences.CUES}')) AS ls,
         list_filter(string_split_regex(text, '{licences.BETWEEN}'), lambda x: regexp_matches(x, '{licences.CUES}')) AS bs,
         len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licences.NAMES}') AS named FROM g
), u AS (
  SELECT path, n AS words, named OR 2 * coalesce(list_sum(list_transform(ls, lambda x: len(regexp_extract_all(lower(x), '[a-z0-9]+')))), 0) >= n AS is_file, ls,
         list_concat(bs, CASE WHEN named OR 2 * coalesce(list_sum(list_transform(bs, lambda x: len(regexp_extract_all(lower(x), '[a-z0-9]+')))), 0) >= n THEN [text] ELSE [] END) AS bs FROM p
), l AS (
  SELECT path, line, bool_or(is_file) AS is_file, max(words) AS words, bool_or(is_block) AS is_block, len(regexp_extract_all(lower(line), '[a-z0-9]+')) AS n
  FROM (SELECT path, words, is_file, unnest(ls) AS line, false AS is_block FROM u UNION ALL SELECT path, words, is_file, unnest(bs), true FROM u) GROUP BY path, line
),
lw AS (SELECT line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM (SELECT DISTINCT line FROM l)),
ltf AS (SELECT line, word, count(*) AS tf FROM lw GROUP BY ALL),
lr AS (SELECT line, word, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM tpl)) + 1) AS w FROM ltf LEFT JOIN df USING (word)),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lr GROUP BY line),
sc AS (SELECT lr.line, tr.licence, tr.t, round(sum(lr.w * tr.w / tr.norm) / any_value(ln_.norm), 6) AS score FROM lr JOIN tr USING (word) JOIN ln_ USING (line) GROUP BY ALL),
fit AS (SELECT line, licence, max(score) AS score FROM sc WHERE score >= {licences.THRESHOLD} GROUP BY ALL),
own AS (SELECT path, bool_or(is_file) OR 2 * sum(CASE WHEN is_block THEN n ELSE 0 END) >= max(words) AS is_file, arg_min(licence, (-score, licence)) AS licence, max(score) AS score FROM l JOIN fit USING (line) GROUP BY path),
d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min(licence, (-score, licence, path)) AS licence, max(score) AS score FROM own WHERE is_file GROUP BY ALL),
x AS (SELECT f.doc_id, f.path, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir FROM f),
a AS (SELECT x.dir, arg_max(d.dir, length(d.dir)) AS above, arg_max(licence, length(d.dir)) AS licence, arg_max(score, length(d.dir)) AS score
      FROM (SELECT DISTINCT dir FROM x) x JOIN d ON x.dir = d.dir OR starts_with(x.dir, d.dir || '/') OR d.dir = '' GROUP BY x.dir)
SELECT doc_id, path, coalesce(own.licence, a.licence) AS licence, coalesce(own.score, a.score) AS score,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN a.licence IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.licence IS NULL THEN above END AS licensed_dir
FROM x LEFT JOIN own USING (path) LEFT JOIN a USING (dir)
"""

OP8_SQL = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
v AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM v JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
-- the pages of these tables have neither canonical links nor redirects, so no alias decides
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN m USING (n)
"""

OP10_SQL = r"""
WITH RECURSIVE c AS (SELECT coalesce('=' || source, '') AS s, count(*) AS n FROM documents GROUP BY ALL),
a AS (SELECT s, n, CAST(floor(sqrt(n) * 1000) AS BIGINT) AS root FROM c),
w AS (SELECT s, n, greatest(1, root * 16384 // (SELECT sum(root) FROM a))::BIGINT AS w FROM a),
p AS (SELECT s, w, sum(w) OVER ()::BIGINT AS d, n FROM w),
m AS (SELECT max((least((n + 15) // 16, w) * d + w - 1) // w) AS slots FROM p),
sim(t, s, w, d, j) AS (
  SELECT 0, s, w, d, 0::BIGINT FROM p
  UNION ALL
  SELECT t + 1, s, w, d, j + CASE WHEN row_number() OVER (ORDER BY j * d // w > t, ((j + 1) * d + w - 1) // w, s) = 1 THEN 1 ELSE 0 END FROM sim WHERE t < (SELECT slots FROM m)
), pat AS (SELECT a.s, a.w, a.d, a.j AS k, a.t AS place_at FROM sim a JOIN sim b ON b.s = a.s AND b.t = a.t + 1 AND b.j = a.j + 1),
r AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
         row_number() OVER (PARTITION BY source ORDER BY md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS number
  FROM documents
), b AS (SELECT *, number // 16 AS block, number % 16 AS place FROM r)
SELECT doc_id, source, block, block * d // w AS release, ((block + 1) * d + w - 1) // w AS deadline,
       block // w * d + place_at AS slot, (block // w * d + place_at) * 16 + place AS position
FROM b JOIN pat ON b.s = pat.s AND b.block % pat.w = pat.k
"""


def _op12_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Plain Lloyd rounds, each a full recount."""
    assign = "{a} AS MATERIALIZED (SELECT r, p, k, far FROM (SELECT r, p, k, far, row_number() OVER (PARTITION BY r, p ORDER BY far, k) AS place FROM (SELECT x.r, x.p, b.k, sum((x.x - b.c) * (x.x - b.c)) AS far FROM x JOIN {b} b ON b.p = x.p AND b.j = x.j GROUP BY ALL)) WHERE place = 1)"
    replace = "{b} AS MATERIALIZED (SELECT o.p, o.k, o.j, coalesce(m.c, o.c) AS c FROM {before} o LEFT JOIN (SELECT x.p, a.k, x.j, CAST(floor(sum(x.x) / count(*)) AS BIGINT) AS c FROM x JOIN {a} a ON a.r = x.r AND a.p = x.p GROUP BY ALL) m ON m.p = o.p AND m.k = o.k AND m.j = o.j)"
    steps = [step for t in range(rounds) for step in (assign.format(a=f"a{t}", b=f"b{t}"), replace.format(b=f"b{t + 1}", before=f"b{t}", a=f"a{t}"))]
    return f"""
WITH g AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), w AS (SELECT greatest(1, (max(len(embedding)) + {parts - 1}) // {parts}) AS w FROM g),
d AS (SELECT unnest(range({parts} * w)) AS d, w FROM w),
x AS MATERIALIZED (SELECT r, d // w AS p, d % w AS j, CAST(floor(coalesce(embedding[d + 1], 0)::DOUBLE * {scale}) AS BIGINT) AS x FROM g, d),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, j, x AS c FROM x WHERE r <= {entries}),
{", ".join(steps)}, {assign.format(a="final", b=f"b{rounds}")},
o AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM final JOIN g USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) FROM b{rounds}) AS codebooks_sha256
FROM o
"""


OP12_SQL = _op12_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rp_forest": op1_rp_forest,
        "op2_backoff_lm": op2_backoff_lm,
        "op3_line_templates": op3_line_templates,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_licences": op6_licences,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_url_filters": op8_url_filters,
        "op9_near_dedup": op9_near_dedup,
        "op10_mixing": op10_mixing,
        "op11_toxicity": op11_toxicity,
        "op12_vector_codes": op12_vector_codes,
        "op13_whitening": op13_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_backoff_lm": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op6_licences": OP6_SQL, "op8_url_filters": OP8_SQL, "op9_near_dedup": OP9_SQL, "op10_mixing": OP10_SQL, "op12_vector_codes": OP12_SQL}
