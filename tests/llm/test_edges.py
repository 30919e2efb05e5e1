"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
from collections import Counter

import numpy as np

from corpusloom.llm import backoff_lm, exact_dedup, language_id, line_templates, near_dedup, piece_transducer, rp_forest, url_filter

LONG = " ".join(f"w{i % 5000}x" for i in range(60_000))
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (5, "other text of five"), (6, LONG), (None, LONG), (7, "ä ö ü ß é")]


def odd(spark):
    """Rows with an id and text, and columns named like the operators' own."""
    names = "id n h key chunk block print name line n_lines bands keep_id component position copy score lang_pred ids c0 c1"
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", *[f"'{n}' AS `{n}`" for n in names.split()])


def test_forest_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += rows[:5] * 3 + [(None, [1.0] * 8), (20, [2.0] * 8), (40, None)] + [(1000 + i, [0.5] * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS leaf", "3 AS slice")
    got = rp_forest.search(df, share=100.0).collect()  # all leaves: the result is that of brute force
    kept = sorted({(i, tuple(x)) for i, x in rows if i is not None and x})
    ids, x = np.array([i for i, _ in kept]), np.array([e for _, e in kept])
    want = Counter()
    for i, e in kept:
        if i % 20 == 0:
            best: dict = {}
            for j, s in zip(ids.tolist(), (x * np.array(e)).sum(axis=1).tolist()):
                if j != i:
                    best[j] = max(s, best.get(j, -math.inf))
            want.update((i, r, j) for r, (j, _) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20], 1))
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in got) == want


def test_backoff_edges(spark):
    got = backoff_lm.score(odd(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len((t or "").split())) for i, t in ROWS)
    by_text = {(r.doc_id, r.n_tokens): r.log_score for r in got}
    assert by_text[(1, 6)] == by_text[(None, 6)] and by_text[(2, 0)] == by_text[(3, 0)] == 0.0
    assert abs(by_text[(5, 60_000)] - by_text[(6, 60_000)]) < 1e-6
    small = backoff_lm.score(odd(spark), chunk=50, bucket=1000).collect()
    assert sorted(round(r.log_score, 6) for r in small) == sorted(round(r.log_score, 6) for r in got)
    assert backoff_lm.score(odd(spark).limit(0)).count() == 0


def test_lines_edges(spark):
    df = odd(spark)
    out = line_templates.clean(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter((r[0], r[1]) for r in out.collect()) == Counter(ROWS)
    assert line_templates.clean(df.limit(0)).count() == 0


def test_exact_dedup_edges(spark):
    df = odd(spark)
    got = exact_dedup.keep_first(df).collect()
    assert exact_dedup.keep_first(df).columns == df.columns and all(r["name"] == "name" and r["c1"] == "c1" for r in got)
    assert Counter((r.doc_id, (r.text or "").strip()[:9]) for r in got) == Counter([(1, "a b c d e"), (2, ""), (4, ""), (5, LONG[:9]), (5, "other tex"), (7, "ä ö ü ß é")])
    assert exact_dedup.decisions(df).count() == len(ROWS)


def test_language_edges(spark):
    learn = spark.createDataFrame([(k, t, lang) for k in range(12) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string")
    filters = language_id.fit(learn)
    df = odd(spark)
    got = language_id.predict(df, filters).collect()
    assert len(got) == len(ROWS) and Counter(r.id for r in got) == Counter(i for i, _ in ROWS)
    assert {r.lang_pred for r in got if r.id in (2, 3, 4)} == {"und"}
    named = language_id.annotate(df, filters)
    assert len(named.columns) == len(df.columns) + 2
    tie = language_id.predict(spark.createDataFrame([(1, "zzz qqq")], "doc_id long, text string"), filters).first()
    assert (tie.lang_pred, tie.score) == ("de", 0.0)
    none = language_id.fit(learn.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), filters).count() == 0


def test_pieces_edges(spark):
    model = piece_transducer.read_model()
    df = odd(spark)
    out = piece_transducer.encode(df, model, out="ids")
    tokens = piece_transducer.encode(df.select("doc_id", "text"), model, keep=["doc_id"], out="tokens")
    back = piece_transducer.decode(tokens, model, "tokens", keep=["doc_id"])
    assert Counter((r.doc_id, r.decoded) for r in back.collect()) == Counter(ROWS)
    assert len(out.columns) == len(df.columns) + 1 and out.count() == len(ROWS)
    assert piece_transducer.encode(df.limit(0), model).count() == 0


def test_near_dedup_repeats(spark):
    df = odd(spark)
    got = near_dedup.classify(df).collect()
    assert len(got) == len(ROWS) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 7, None}


def test_aliases_equal_plain_components(spark):
    random.seed(11)
    names = [f"http://{random.choice(['a.net', 'b.org', 'example.com', 'www.example.com'])}/{random.choice(['en', 'es', 'de', 'fr'])}/{k}" for k in range(120)]
    rows, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    key = lambda u: u.split("://")[1]
    for k, url in enumerate(names):
        links = random.sample(names, random.choice([0, 0, 1, 2]))
        html = "".join(random.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">']).format(t) for t in links)
        rows.append((k, url, html + "x" * random.choice([0, 10, 100_000])))
        for t in links:
            parent[find(key(t))] = find(key(url))
    rows += rows[:10] + [(500, None, None), (None, "no host", "<link rel=canonical href=/x>"), (501, "http:///p", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS node", "2 AS own", "3 AS component")

    def rule(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = rest.split("/", 1)[0], "/" + rest.split("/", 1)[1] if "/" in rest else ""
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    said: dict = {}
    for _, url, _ in rows:
        if url and "://" in url and url != "http:///p" and rule(url):
            said.setdefault(find(key(url)), set()).add(rule(url))
    for u in names:  # targets count, pages or not
        if rule(u) and key(u) in parent:
            said.setdefault(find(key(u)), set()).add(rule(u))

    def verdict(url):
        if rule(url):
            return rule(url)
        found = said.get(find(key(url)), set()) if url and "://" in url and url != "http:///p" else set()
        return "block" if found == {"block"} else "allow"

    got = Counter((r.page_id, r.verdict) for r in url_filter.judge(df).collect())
    assert got == Counter((i, verdict(u)) for i, u, _ in rows)
    assert any(rule(u) is None and verdict(u) == "block" for _, u, _ in rows)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, t, "en" if i and i % 2 else None, None if i == 3 else "s", 1) for i, t in ROWS]
    texts += [(100 + k, "the cat and the dog walk here " * 3 + f"number {k % 7}", "en", "big", 1) for k in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and len({r.position for r in out}) == len(out) and all(r.n_tokens == len(r.ids) for r in out)
    assert not {2, 3, 4} & {r.doc_id for r in out}  # no letters
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
