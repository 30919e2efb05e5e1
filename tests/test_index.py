"""The index in segments: equal to the search over texts, with fewer postings read and no more rewritten than has to be."""

import os
import random

from pyspark.sql import functions as F

from corpusloom.operators import search, segments

K = 5


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def fields(df):
    return {"name": df["title"], "doc": df["title"], "body": df["text"]}


def corpus(n=400, seed=5):
    """Common words everywhere, rare ones in few documents, empty and long documents."""
    rng = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma", "delta"], [f"rare{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.choice([0, 5, 30, 400]))] + [rng.choice(rare) for _ in range(rng.randint(0, 6))]
        rng.shuffle(words)
        out.append((i, " ".join(words[:3]) or None, " ".join(words) if i % 50 else None))
    return out


def asked(spark, rows):
    rng, queries = random.Random(1), []
    for q in range(25):
        doc = rng.choice([r for r in rows if r[2]])
        queries.append((q, " ".join(rng.sample(doc[2].split(), min(8, len(doc[2].split())))) + " alpha beta nowhere"))
    q = spark.createDataFrame(queries, "q int, t string")
    return search.query_terms(q, "q", q["t"])


def full(df, terms, k=K):
    return {(r.query_id, r["rank"], r.doc): round(r.score, 8) for r in search.best(search.bm25f(df, "doc_id", fields(df), terms), k).collect()}


def found(spark, path, terms, k=K):
    return {(r.query_id, r["rank"], r.doc): round(r.score, 8) for r in segments.topk(spark, path, terms, k).collect()}


def test_the_best_equal_the_full_search_and_less_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FIRST_BLOCKS", 4)
    rows = corpus(800)
    df, path = docs_of(spark, rows), str(tmp_path / "index")
    assert segments.refresh(df, "doc_id", fields(df), path, "d1") == {"added": 800, "changed": 0, "removed": 0}
    terms = asked(spark, rows)
    assert found(spark, path, terms) == full(df, terms)
    read = segments.plan(spark, path, terms, K).read().first()
    assert 0 < read["read"] < 0.7 * read["all"]  # terms that are everywhere are in every query here
    assert {(r.query_id, r.doc): round(r.score, 8) for r in segments.scores(spark, path, terms).collect()} == {(r.query_id, r.doc): round(r.score, 8) for r in search.bm25f(df, "doc_id", fields(df), terms).collect()}
    assert segments.usable(spark, path, "d1") and not segments.usable(spark, path, "d2") and not segments.usable(spark, str(tmp_path / "none"), "d1")


def files_of(path, name):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(os.path.join(path, name)) for f in fs}


def test_a_tenth_is_added_changed_and_removed(spark, tmp_path):
    rows = corpus(300)
    path = str(tmp_path / "index")
    df = docs_of(spark, rows)
    segments.refresh(df, "doc_id", fields(df), path)
    first = segments._manifest(spark, path)["segments"][0]["name"]
    before = files_of(path, first)
    now = [(i, t, (x or "") + " newword" if i % 10 == 1 else x) for i, t, x in rows if i % 10 != 2] + [(1000 + i, t, x) for i, t, x in corpus(30, 9)]
    df = docs_of(spark, now)
    assert segments.refresh(df, "doc_id", fields(df), path) == {"added": 30, "changed": 30, "removed": 30}
    terms = asked(spark, now)
    assert found(spark, path, terms) == full(df, terms)
    assert files_of(path, first) == before  # the earlier segment is as it was
    entries = segments._manifest(spark, path)["segments"]
    assert [s["documents"] for s in entries] == [300, 60] and entries[0]["gone"] == 60
    assert {r.term: r.df for r in segments.frequencies(spark, path, terms).collect()} == {r.term: r.df for r in search.document_frequency(search.term_frequency(df, "doc_id", F.concat_ws(" ", "title", "text")), df).join(terms.select("term").distinct(), "term", "left_semi").collect()}
    assert segments.refresh(df, "doc_id", fields(df), path) == {"added": 0, "changed": 0, "removed": 0}
    assert len(segments._manifest(spark, path)["segments"]) == 2  # nothing new, nothing written


def test_segments_of_one_size_are_merged_and_others_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments.compact, "__defaults__", (2,))  # two small segments are merged
    path, rows = str(tmp_path / "index"), corpus(200)
    df = docs_of(spark, rows)
    segments.refresh(df, "doc_id", fields(df), path)
    first = segments._manifest(spark, path)["segments"][0]["name"]
    before = files_of(path, first)
    for k in range(3):  # small changes, of old and of newly added documents
        rows = [(i, t, f"{x or ''} change{k}" if i in (k, 5000) else x) for i, t, x in rows if i != 20 + k] + [(5000 + k, "fresh", f"rareaa alpha fresh{k}")]
        df = docs_of(spark, rows)
        segments.refresh(df, "doc_id", fields(df), path)
    entries = segments._manifest(spark, path)["segments"]
    assert len(entries) == 3 and entries[0]["name"] == first and files_of(path, first) == before
    terms = asked(spark, rows)
    assert found(spark, path, terms) == full(df, terms)
    segments.clean(spark, path)
    assert {n for n in os.listdir(path) if n.startswith("segment-")} == {s["name"] for s in entries}
    assert found(spark, path, terms) == full(df, terms)


def test_empty_indexes(spark, tmp_path):
    path, none = str(tmp_path / "index"), docs_of(spark, corpus(3)).limit(0)
    assert segments.refresh(none, "doc_id", fields(none), path) == {"added": 0, "changed": 0, "removed": 0}
    terms = asked(spark, corpus(50))
    assert segments.topk(spark, path, terms, 3).collect() == []
    df = docs_of(spark, corpus(50))
    segments.refresh(df, "doc_id", fields(df), path)
    assert found(spark, path, terms) == full(df, terms)
    segments.refresh(none, "doc_id", fields(none), path)
    assert segments.topk(spark, path, terms, 3).collect() == []


def test_few_and_all(spark, tmp_path):
    rows = corpus(200, 3)
    df, path = docs_of(spark, rows), str(tmp_path / "index")
    segments.refresh(df, "doc_id", fields(df), path)
    terms = asked(spark, rows)
    for k in (1, 1000):
        assert found(spark, path, terms, k) == full(df, terms, k)


def test_postings_are_made_where_their_documents_lie(spark, tmp_path):
    """No aggregate over words, no block in two rows of a term, and none over BLOCK documents."""
    rows = corpus(300)
    df, path = docs_of(spark, rows), str(tmp_path / "index")
    assert "Aggregate" not in segments._forward(df, "doc_id", fields(df))._jdf.queryExecution().optimizedPlan().toString()
    segments.refresh(df, "doc_id", fields(df), path)
    posted = segments._read(spark, path, segments._manifest(spark, path), "postings").cache()
    assert posted.count() == posted.select("term", "block").distinct().count()
    each = posted.select("block", "n", F.size("entries").alias("m"), F.explode("entries.doc").alias("doc"))
    assert each.where("n <> m").isEmpty() and each.groupBy("block").agg(F.count_distinct("doc").alias("n")).agg(F.max("n")).first()[0] <= segments.BLOCK
    assert each.select("doc", "block").distinct().count() == each.select("doc").distinct().count()


def test_few_queries_make_no_row_for_each_query_term_and_block(spark, tmp_path, monkeypatch):
    rows = corpus(300)
    df, path = docs_of(spark, rows), str(tmp_path / "index")
    segments.refresh(df, "doc_id", fields(df), path)
    now = [(i, t, (x or "") + " newword" if i % 10 == 1 else x) for i, t, x in rows if i % 10 != 2]
    df = docs_of(spark, now)
    segments.refresh(df, "doc_id", fields(df), path)
    terms, plain = asked(spark, now), segments.plan
    monkeypatch.setattr(segments, "plan", None)
    few = found(spark, path, terms)
    monkeypatch.setattr(segments, "plan", plain)
    monkeypatch.setattr(search, "MOST_CELLS", 3)  # too many queries for a task
    assert few == found(spark, path, terms) == full(df, terms)


def test_the_refreshed_index_writes_no_whole_texts(spark, monkeypatch):
    from corpusloom.plans import index_queries

    seen, plain = [], index_queries.cut
    monkeypatch.setattr(index_queries, "cut", lambda df: seen.append(df.columns) or plain(df))
    d = "/root/testdata/sf0.001"
    best = {tuple(r) for r in index_queries.index_refreshed(spark, d).collect()}
    assert seen and all("text" not in columns for columns in seen)
    assert best == {tuple(r) for r in index_queries.tq.bm25f_topk(spark, d).collect()}
