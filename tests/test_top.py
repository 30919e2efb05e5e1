"""The search for the best documents in the tasks that read them, against the full search."""

import random

import pytest

from corpusloom.operators import search


def corpus(spark, name=lambda i: i, n=300):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    draw = lambda m: " ".join(rng.choice(words[: rng.choice([4, 15, 30])]) for _ in range(m))
    texts = [draw(rng.randint(0, 60)) for _ in range(n // 2)]
    rows = [(name(i), rng.choice(texts), draw(4)) for i in range(n - 3)] + [(name(n), None, None), (name(n + 1), "", "x"), (name(n + 2), "wordaa", "")]  # copies tie
    kind = "long" if isinstance(rows[0][0], int) else "string"
    docs = spark.createDataFrame(rows, f"id {kind}, text string, title string").repartition(5)
    passages = spark.createDataFrame([(q, draw(q * 3)) for q in range(9)] + [(50, "wordaa wordaa"), (51, "nowhere"), (52, None)], "qid int, text string")
    return docs, search.query_terms(passages, "qid", passages["text"])


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("name", "k"), [(lambda i: i * 7919 % 1009, 1000), (lambda i: f"d{i * 7919 % 1009}é", 7)])
def test_the_best_are_those_of_the_full_search(spark, name, k, monkeypatch):
    monkeypatch.setattr(search, "_BLOCK", 700)  # several blocks of documents
    docs, asked = corpus(spark, name)
    fields = {"name": docs["title"], "body": docs["text"]}
    assert rows(search.bm25_top(docs, "id", docs["text"], asked, k)) == rows(search.best(search.bm25(docs, "id", docs["text"], asked), k))
    assert rows(search.bm25f_top(docs, "id", fields, asked, k)) == rows(search.best(search.bm25f(docs, "id", fields, asked), k))
    assert rows(search.tfidf_top(docs, "id", docs["text"], asked, k)) == rows(search.best(search.tfidf_cosine(docs, "id", docs["text"], asked), k))


def test_many_queries_and_ids_that_repeat_go_the_plain_way(spark, monkeypatch):
    docs, asked = corpus(spark, lambda i: i // 2)
    wanted = rows(search.best(search.bm25(docs, "id", docs["text"], asked), 5))
    assert rows(search.bm25_top(docs, "id", docs["text"], asked, 5)) == wanted
    docs, asked = corpus(spark)
    wanted = rows(search.best(search.bm25(docs, "id", docs["text"], asked), 5))
    monkeypatch.setattr(search, "MOST_CELLS", 3)
    assert rows(search.bm25_top(docs, "id", docs["text"], asked, 5)) == wanted
    assert search.bm25_top(docs, "id", docs["text"], asked.limit(0), 5).collect() == []


def test_no_window_over_all_matches(spark):
    """What is grouped and ranked comes from the tasks' best, not from all pairs of document and query."""
    docs, asked = corpus(spark)
    plan = search.bm25_top(docs, "id", docs["text"], asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan


def test_digits_round_as_in_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    values = [0.1234567885, 2.0000000005, 1e-10, 5e-10, 17.1234567895, 3.9999999995, 12.345678901499999]
    there = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()]
    assert [float(x) for x in np.round(search._nine(np.array(values)) / 1e9, 9)] == there


@pytest.mark.parametrize("common", [1 << 18, 5])
def test_lengths_with_few_and_many_common_terms(spark, common, monkeypatch):
    monkeypatch.setattr(search, "MOST_COMMON", common)
    docs, _ = corpus(spark)
    wanted = {r.doc: pytest.approx(r.length) for r in search._tfidf_lengths(docs, "id", docs["text"])[2].collect()}
    assert {r.doc: r.length for r in search._tfidf_norms(docs, "id", docs["text"]).collect()} == wanted


def test_all_texts_are_not_grouped_by_document_and_term(spark):
    docs, asked = corpus(spark)
    plan = search.tfidf_top(docs, "id", docs["text"], asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_search_of_files_goes_the_same_way(spark):
    from corpusloom.plans import code_queries

    plan = code_queries.code_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_all_scores_come_out_of_the_tasks(spark, monkeypatch):
    """All scores of two ways equal the full searches, without an aggregate or join over the pairs."""
    monkeypatch.setattr(search, "_BLOCK", 700)
    docs, asked = corpus(spark)
    fields = {"name": docs["title"], "body": docs["text"]}
    met = search.Meeting(docs, "id", fields, asked)
    found = met.every({"a": ("bm25", ["body"]), "b": ("bm25f", ["name", "body"])})
    for column, plain in (("a", search.bm25(docs, "id", docs["text"], asked)), ("b", search.bm25f(docs, "id", fields, asked))):
        assert {(r.query_id, r.doc): round(r.score, 9) for r in plain.collect()} == {(r.query_id, r.doc): round(r[column], 9) for r in found.collect() if r[column] is not None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan
    docs, asked = corpus(spark, lambda i: i // 2)  # ids that repeat
    wanted = {(r.query_id, r.doc): round(r.score, 9) for r in search.bm25(docs, "id", docs["text"], asked).collect()}
    assert {(r.query_id, r.doc): round(r.a, 9) for r in search.Meeting(docs, "id", {"all": docs["text"]}, asked).every({"a": ("bm25", ["all"])}).collect()} == wanted


def test_seven_rankings_send_each_pair_once(spark):
    from corpusloom.operators import evaluate

    pairs = spark.range(200).selectExpr("id % 3 query_id", "id doc", "cast(id * 37 % 11 as double) lexical", "id % 5 = 0 same_dir", "if(id % 7 = 0, id % 2, null) distance", "cast(null as long) weight", "false same_part", "id % 5 = 0 same_group")
    ranked = evaluate.rankers(pairs)
    assert ranked.count() == 7 * 200 and ranked.select("method", "query_id", "rank").distinct().count() == 7 * 200
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_what_is_strong_has_the_ranks_of_all(spark, monkeypatch):
    """Rows of both kinds of documents that can be entries or strong come through with their ranks; others mostly stay in the tasks."""
    monkeypatch.setattr(search, "_BLOCK", 700)
    docs, asked = corpus(spark)
    fields = {"name": docs["title"], "body": docs["text"]}
    met, apart = search.Meeting(docs, "id", fields, asked), docs.where("id % 4 = 0").selectExpr("id doc")
    strong, full = met.strong("bm25f", ["name", "body"], apart), search.bm25f(docs, "id", fields, asked)
    for less in (False, True):
        keep = lambda df: df.where("doc % 4 <> 0") if less else df  # noqa: E731, B023
        wanted = [r for r in search.best(keep(full), None).collect()]
        top = {q: max(r.score for r in wanted if r.query_id == q) for q in {r.query_id for r in wanted}}
        got = {(r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in search.best(keep(strong), None).collect()}
        assert {(r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in wanted if r["rank"] <= 4 or r.score >= 0.5 * top[r.query_id]} <= got
        assert len(got) < len(wanted)


def test_terms_in_tasks_are_those_of_the_column(spark):
    from collections import Counter

    import pyarrow as pa
    from corpusloom.functions import text

    rng = random.Random(3)
    texts = ["".join(rng.choice("AABbcsS s12é\n_") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "classes files Uses HTTPServer glass 12"]
    lengths, at, term, times, words = text.term_counts(pa.array(texts, pa.string()))
    found = [Counter() for _ in texts]
    for row, number, n in zip(at, term, times):
        found[row][words[int(number)].as_py()] = int(n)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    wanted = {r[0]: Counter(r[1]) for r in df.select("id", text.terms(df["text"])).collect()}
    assert found == [wanted[i] for i in range(len(texts))] and list(lengths) == [sum(c.values()) for c in found]
    assert [len(x) for x in text.term_counts(pa.array([], pa.string()))] == [0] * 5


def test_texts_are_cut_into_terms_once_for_all_rankings(spark, monkeypatch):
    from corpusloom.plans import text_queries

    made, plain = [], search.Meeting
    monkeypatch.setattr(search, "Meeting", lambda *args: made.append(plain(*args)) or made[-1])
    found = text_queries.rankings(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and not made[0].plain
    assert {r[0] for r in found.select("method").distinct().collect()} == {"bm25", "bm25f", "tfidf", "rrf"}


@pytest.mark.parametrize("common", [1 << 18, 5])
def test_three_rankings_of_one_pass(spark, common, monkeypatch):
    monkeypatch.setattr(search, "MOST_COMMON", common)
    monkeypatch.setattr(search, "_BYTES", 300)  # several pieces of a batch
    docs, asked = corpus(spark)
    fields = {"name": docs["title"], "body": docs["text"]}
    found = search.three_tops(docs, "id", docs["title"], fields, asked, 7)
    wanted = [search.bm25(docs, "id", docs["title"], asked), search.bm25f(docs, "id", fields, asked), search.tfidf_cosine(docs, "id", docs["text"], asked)]
    assert [rows(df) for df in found] == [rows(search.best(df, 7)) for df in wanted]


def test_scores_of_some_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "_BLOCK", 700)
    docs, asked = corpus(spark)
    met, way = search.Meeting(docs, "id", {"name": docs["title"], "body": docs["text"]}, asked), {"score": ("bm25f", ["name", "body"])}
    pairs = spark.createDataFrame([(q, d) for q in (3, 8, 99) for d in range(0, 300, 7)] + [(None, 5)], "query_id int, doc long")
    wanted = {(r.query_id, r.doc): r.score for r in met.every(way).collect() if r.query_id in (3, 8) and r.doc in range(0, 300, 7)}
    assert {(r.query_id, r.doc): r.score for r in met.some(way, pairs).collect()} == wanted and wanted


def test_walk_by_mass_scores_only_what_it_reaches(spark, monkeypatch):
    """gather_ppr neither makes nor ranks the scores of all pairs, and gives what it gave from all of them."""
    from corpusloom.operators import graph, retrieve
    from corpusloom.plans import context_queries

    walk, every, folder = graph.walk, search.Meeting.every, "/root/testdata/sf0.001"
    monkeypatch.setattr(graph, "walk", lambda steps, seeds, rounds: walk(steps, seeds, 3, tolerance=None))
    met = context_queries._meeting(spark, folder)
    hits, *rest = context_queries._tables(spark, folder, met=met)
    full = retrieve.gather(search.best(met.every({"score": ("bm25f", list(met.fields))}), None), *rest, "bug", retrieve.Settings())
    wanted = sorted((r.query_id, r.doc, round(r.score, 6), r.position) for r in full.collect())
    monkeypatch.setattr(search.Meeting, "every", lambda *args: pytest.fail("all pairs"))
    assert sorted((r.item_id, r.doc_id, r.score, r.position) for r in context_queries.gather_ppr(spark, folder).collect()) == wanted


def test_walk_with_dead_ends(spark):
    """Mass on nodes without a step goes home, also where only some rounds are written."""
    from corpusloom.operators import graph

    steps = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0)], "u long, v long, p double")
    seeds = spark.createDataFrame([(7, 1), (7, 9), (8, 2)], "seed_set int, node long")
    for rounds, tolerance in ((3, None), (7, 1e-9), (60, 1e-9)):
        got = {(r.seed_set, r.node): r.mass for r in graph.walk(steps, seeds, rounds, tolerance=tolerance).collect()}
        for s, home in ((7, {1: 0.5, 9: 0.5}), (8, {2: 1.0})):
            mass = dict(home)
            for _ in range(rounds):
                moved = {n: 0.15 * share for n, share in home.items()}
                for n, m in mass.items():
                    ways = {1: {2: 0.5, 3: 0.5}, 2: {1: 1.0}}.get(n, home)
                    for v, p in ways.items():
                        moved[v] = moved.get(v, 0.0) + 0.85 * m * p
                mass = moved
            assert {n: m for (k, n), m in got.items() if k == s} == {n: pytest.approx(m, abs=1e-8) for n, m in mass.items()}


def _ranked(df):
    return sorted((r.method, r.query_id, str(r.doc), r["rank"]) for r in df.collect())


def _parts(spark, monkeypatch, name):
    monkeypatch.setattr(search, "_BLOCK", 700)  # several blocks of a query
    docs, asked = corpus(spark, name)
    met = search.Meeting(docs, "id", {"name": docs["title"], "body": docs["text"]}, asked)
    ids = [r[0] for r in docs.select("id").orderBy("id").collect()]
    kind = docs.schema["id"].dataType.simpleString()
    gold = spark.createDataFrame([(q, ids[i]) for q in (1, 3, 5, 8) for i in range(q, len(ids), 11)] + [(3, ids[3])], f"query_id int, doc {kind}")
    return met, ids, kind, gold


def test_seven_rankings_packed_by_query(spark, monkeypatch):
    """Ranks of gold from packed pairs equal those of the rows, and no pair is a row of the plan's joins and windows."""
    from corpusloom.operators import evaluate
    from pyspark.sql import functions as F

    met, ids, kind, gold = _parts(spark, monkeypatch, lambda i: f"{'abc'[i % 3]}/d{i * 7919 % 1009}é.py")
    seeds = spark.createDataFrame([(q, ids[(7 * q) % len(ids)]) for q in range(1, 9)], f"query_id int, seed {kind}")
    far = spark.createDataFrame([(q, ids[i], i % 4) for q in range(1, 9) for i in range(q, len(ids), 13)], f"query_id int, doc {kind}, distance long")
    links = spark.createDataFrame([(q, ids[i], 1 + i % 3) for q in range(1, 9) for i in range(q, len(ids), 26)], f"query_id int, doc {kind}, weight long")
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    way = {"lexical": ("bm25f", ["name", "body"])}
    c = met.every(way).join(seeds, "query_id").where("doc <> seed").join(far, ["query_id", "doc"], "left").join(links, ["query_id", "doc"], "left")
    c = c.withColumn("same_dir", folder(F.col("doc")) == folder(F.col("seed"))).withColumn("same_part", F.lit(False)).withColumn("same_group", F.col("same_dir"))
    wanted = _ranked(evaluate.rankers(c).join(gold.distinct(), ["query_id", "doc"], "left_semi"))
    facts = seeds.selectExpr("query_id", "seed doc", "'out' kind", "0 value").unionByName(far.selectExpr("query_id", "doc", "'distance' kind", "distance value")).unionByName(links.selectExpr("query_id", "doc", "'weight' kind", "weight value"))
    blocks, numbers = met.blocks(way, label=folder(F.col("doc")), labels={r[0]: r[1] for r in seeds.select("query_id", folder(F.col("seed"))).collect()})
    assert blocks.count() < met.every(way).count() / 4
    found = evaluate.gold_places(blocks, numbers, "lexical", ["lexical"], facts, gold, evaluate.seven_places)
    assert _ranked(found) == wanted and len(wanted) > 300


def test_thirteen_rankings_packed_by_query(spark, monkeypatch):
    from functools import reduce

    from corpusloom.operators import evaluate
    from corpusloom.plans import evaluation_queries as eq
    from pyspark.sql import functions as F

    met, ids, kind, gold = _parts(spark, monkeypatch, lambda i: i * 7919 % 1009)
    ways = {"file": ("bm25", ["body"]), "metadata": ("bm25", ["name"]), "fields": ("bm25f", ["name", "body"])}
    names = ["walk", *[f"{h} {n}" for n in eq.SEARCHES for h in ("task", "bug")]]
    heads = {h: spark.createDataFrame([(q, ids[i], k + 1) for q in range(1, 9) for k, i in enumerate(range(j + q, len(ids), 9 + j))], f"query_id int, doc {kind}, rank int") for j, h in enumerate(names)}
    wanted = _ranked(eq._thirteen(met.every(ways), ways, heads).join(gold.distinct(), ["query_id", "doc"], "left_semi"))
    facts = reduce(lambda a, b: a.unionByName(b), [r.select("query_id", "doc", F.lit(h).alias("kind"), F.col("rank").alias("value")) for h, r in heads.items()])
    found = evaluate.gold_places(*met.blocks(ways), "file", list(ways), facts, gold, eq._thirteen_places)
    assert _ranked(found) == wanted and len(wanted) > 500
