import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import facts, text
from corpusloom.operators import community, fusion, graph, incremental, metrics, modules, pages, retrieve, search, stats
from corpusloom.operators.components import connected_components
from corpusloom.sources import files

DOCS = [(1, "HTTPServer parses headers\nserver loops"), (2, "parser of tokens"), (3, None), (4, ""), (5, "headers headers HTTPServer")]


def plain_terms(s):
    out = []
    for t in re.findall(text.TERM, s or ""):
        t = t.lower()
        if len(t) >= 2 and t not in text.STOP_WORDS:
            out.append(t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith("ss") else t)
    return out


def test_terms(spark):
    rows = spark.createDataFrame(DOCS, "id int, t string").select("id", text.terms(F.col("t")).alias("w")).collect()
    assert {r.id: r.w for r in rows} == {i: plain_terms(s) for i, s in DOCS}


def test_bm25f_against_plain(spark):
    docs = spark.createDataFrame(DOCS, "id int, t string")
    asked = search.query_terms(spark.createDataFrame([(7, "headers of the server headers")], "q int, t string"), "q", F.col("t"))
    got = {r.doc: r.score for r in search.bm25f(docs, "id", {"name": text.first_line(docs["t"]), "body": docs["t"]}, asked).collect()}
    fields = {"name": lambda s: (s or "").split("\n")[0], "body": lambda s: s or ""}
    tf = {i: {f: Counter(plain_terms(g(s))) for f, g in fields.items()} for i, s in DOCS}
    mean = {f: sum(sum(x[f].values()) for x in tf.values()) / len(DOCS) for f in fields}
    v = defaultdict(dict)
    for i, x in tf.items():
        for f, c in x.items():
            for t, n in c.items():
                v[t][i] = v[t].get(i, 0) + search.FIELD_WEIGHTS[f] * n / (0.25 + 0.75 * sum(c.values()) / mean[f])
    want = defaultdict(float)
    for t in plain_terms("headers of the server headers"):
        for i, x in v.get(t, {}).items():
            want[i] += math.log(1 + (len(DOCS) - len(v[t]) + 0.5) / (len(v[t]) + 0.5)) * x / (1.2 + x)
    assert got == pytest.approx(dict(want))


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, doc string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "w", 2)], "query_id int, doc string, rank int")
    order = lambda df: [r.doc for r in df.orderBy("rank").collect()]
    assert order(fusion.reciprocal_rank([a, b])) == ["y", "x", "w", "z"]
    assert order(fusion.interleave(a, b)) == ["x", "y", "w"]
    assert order(fusion.complete(b, a)) == ["y", "x", "z"]


def test_mcnemar(spark):
    rows = spark.createDataFrame([(3, 7), (0, 0), (5, 5), (0, 6)], "b int, c int").select("b", "c", metrics.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    want = lambda b, c: 1.0 if b + c == 0 else min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert all(r.p == pytest.approx(want(r.b, r.c)) for r in rows)


EDGES = [(1, 2, 3), (2, 3, 1), (3, 1, 1), (4, 1, 2), (5, 6, 1)]


def test_walk_mass_and_direct_solution(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int, weight int")
    seeds = spark.createDataFrame([(0, 4), (0, 5)], "seed_set int, node int")
    got = {r.node: r.mass for r in graph.walk(graph.transitions(e, 1.0, 0.0), seeds, 60).collect()}
    assert sum(got.values()) == pytest.approx(1)
    out = defaultdict(list)
    for a, b, w in EDGES:
        out[a].append((b, w))
    r = {4: 0.5, 5: 0.5}
    for _ in range(60):
        n = defaultdict(float)
        stuck = 0.0
        for u, m in r.items():
            t = sum(w for _, w in out[u])
            for v, w in out[u]:
                n[v] += 0.85 * m * w / t
            stuck += 0 if t else 0.85 * m
        for s in (4, 5):
            n[s] += (0.15 + stuck) / 2
        r = n
    assert got == pytest.approx(dict(r), abs=1e-6)


def test_distances_paths_components(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int, weight int")
    seeds = spark.createDataFrame([(0, 4)], "seed_set int, node int")
    assert {r.node: r.distance for r in graph.distances(e, seeds, 2).collect()} == {4: 0, 1: 1, 2: 2}
    assert {r.node: r.path for r in graph.paths(e, seeds, 3).collect()}[3] == [4, 1, 2, 3]
    chain = spark.range(200).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst")).unionByName(spark.createDataFrame([(900, 901), (901, 902), (5, 5), (None, 3)], "src long, dst long"))
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900, 902: 900}
    assert connected_components(chain.limit(0)).count() == 0


def test_communities_cover_and_connect():
    edges = [(a, b, 1.0) for k in (0, 10, 20) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1.0), (10, 20, 1.0)]
    found = community.partition(edges)
    assert len(found) == 15 and len(set(found.values())) == 3
    assert all(len({found[n] for n in range(k, k + 5)}) == 1 for k in (0, 10, 20))
    assert community.partition(edges) == found


def test_modules(spark):
    paths = ["src/app/__init__.py", "src/app/core.py", "src/tool.py", "plain.py"]
    got = {r.path: (r.module, r.aliases) for r in modules.module_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got["src/app/core.py"] == ("app.core", ["src.app.core"]) and got["src/app/__init__.py"] == ("app", ["src.app"])
    assert got["plain.py"] == ("plain", []) and got["src/tool.py"] == ("tool", ["src.tool"])
    imports = spark.createDataFrame([("a.py", "pkg", "X", None), ("a.py", "pkg.sub.mod", None, None), ("a.py", "json", None, None)], "path string, module string, name string, alias string")
    names = spark.createDataFrame([("pkg/__init__.py", "pkg", [], True), ("pkg/m.py", "pkg.m", [], False), ("a.py", "a", [], False)], "path string, module string, aliases array<string>, is_package boolean")
    refs = spark.createDataFrame([("a.py", "X", 2), ("a.py", "mod", 70)], "path string, name string, n long")
    exports = spark.createDataFrame([("pkg/__init__.py", "X", "pkg/m.py")], "path string, name string, target string")
    defined = spark.createDataFrame([("pkg/m.py", "X")], "path string, name string")
    edges = {(r.src, r.dst): r.weight for r in modules.import_edges(names, imports, refs, exports, defined).collect()}
    assert edges == {("a.py", "pkg/m.py"): 3.0, ("a.py", "pkg/__init__.py"): 51.0}
    assert [r.top for r in modules.external_imports(names, imports).collect()] == ["json"]


def test_relative_module(spark):
    df = spark.createDataFrame([("a.b.c", False, 1, "x"), ("a.b", True, 1, None), ("a.b.c", False, 2, "x"), ("a", False, 3, "x")], "m string, p boolean, l int, t string")
    got = [r[0] for r in df.select(text.relative_module(F.col("m"), F.col("p"), F.col("l"), F.col("t"))).collect()]
    assert got == ["a.b.x", "a.b", "a.x", "x"]


def test_sections_links_and_slug(spark):
    doc = "---\ntype: Note\ntitle: A b\n---\nintro\n# Uses\n[x](/x.md) text\n# Other\n[y](/y.md)\n"
    r = spark.createDataFrame([(doc,)], "t string").select(text.field(text.front_matter(F.col("t")), "title").alias("title"), text.sections(text.body(F.col("t"))).alias("s"), text.slug(F.lit("A--b C!")).alias("g"), text.markdown_links(F.col("t")).alias("l"), text.web_address(F.lit("git@host.org:a/b.git")).alias("w")).first()
    assert r.title == "A b" and r.s == {"Uses": "[x](/x.md) text", "Other": "[y](/y.md)"} and r.g == "a-b-c" and r.l == ["/x.md", "/y.md"] and r.w == "https://host.org/a/b"


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {r.path: r.status for r in incremental.diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    assert not incremental.is_stale(incremental.diff(new, new)).first().stale


def test_pack_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 40), (1, "d", 4, 11)], "query_id int, doc string, position int, size int")
    assert {r.doc: r.packed for r in retrieve.pack(items, 100).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_gather_ppr_order(spark):
    hits = spark.createDataFrame([(1, "a", 10.0, 1), (1, "b", 6.0, 2), (1, "t", 5.5, 3), (1, "z", 1.0, 4)], "query_id int, doc string, score double, rank int")
    concepts = spark.createDataFrame([(d, ["test"] if d == "t" else [], 1) for d in "abtzn"], "doc string, tags array<string>, fan_in int")
    edges = spark.createDataFrame([("a", "n", 2), ("n", "z", 1), ("a", "t", 5)], "src string, dst string, weight int")
    members = spark.createDataFrame([("g", d, k) for k, d in enumerate("abtzn", 1)], "grp string, doc string, at int")
    rows = retrieve.gather(hits, concepts, edges, members, "bug", retrieve.Settings(rounds=20)).orderBy("position").collect()
    docs = [r.doc for r in rows]
    assert docs[:2] == ["a", "b"] and "t" not in docs and set(docs[2:]) == {"n", "z"}
    assert rows[0].score == pytest.approx(110) and all(10 < r.score <= 80 for r in rows[2:])


def test_facts(spark):
    code = "import os as o\nfrom x import y as z\nPASSWORD = 'longsecret'\ndef f():\n    z(1)\n    return o.system('x')\nrequests.get(u, verify=False)\n"
    nested = "x = " + "(" * 5000 + ")" * 5000
    rows = {r.path: r for r in facts.facts(spark.createDataFrame([("a.py", bytearray(code, "utf8")), ("b.py", bytearray(nested, "utf8")), ("c.py", bytearray(b"\xff\xfe print 1\n")), ("d.py", None)], "path string, content binary")).collect()}
    assert sorted(f.rule for f in rows["a.py"].findings) == ["hardcoded-secret", "shell-exec", "tls-verify-disabled"]
    assert rows["b.py"].parse_error and rows["c.py"].parse_error and rows["d.py"].parser == "ast"
    assert rows["a.py"].symbols[0].name == "f" and rows["a.py"].loc == 7


def test_containing(spark):
    p = spark.createDataFrame([(1, "one two three four five six seven"), (2, "ab"), (3, "not here at all my good friend")], "i int, t string")
    d = spark.createDataFrame([(10, "x one two three four five six seven y"), (11, "crab"), (12, None)], "j int, t string")
    assert {tuple(r) for r in pages.containing(p, "i", p["t"], d, "j", d["t"]).collect()} == {(1, 10), (2, 11)}


def test_rank_tests(spark):
    r = stats.mann_whitney(spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False)], "v double, g boolean"), "v", F.col("g")).first()
    assert (r.n1, r.n2, r.u) == (2, 3, 0.5)
    w = stats.wilcoxon(spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (0.0,)], "d double"), "d").first()
    assert (w.n, w.w) == (3, 4.0)


def test_sources_and_sink(spark, tmp_path):
    for name in ("a.py", "venv/b.py", "pkg/c.py", ".hid/d.py", "skip/e.py"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text("x = 1\n")
    assert {r.path for r in files.code_tree(spark, str(tmp_path / "r"), ("skip/",)).collect()} == {"a.py", "pkg/c.py"}
    (tmp_path / "r" / "n.md").write_text("---\ntype: Note\n---\n# S\n[a](/a.md)\n")
    note = files.documents(spark, str(tmp_path / "r")).first()
    assert (note.path, note.type, note.links) == ("/n.md", "Note", ["/a.md"])
    docs = files.render(spark.createDataFrame([("/p.md", "T", "body")], "path string, type string, body string"), ["type"])
    state = files.read_state(spark, str(tmp_path / "none"), "path string, hash string")
    assert [r.status for r in files.write_changes(docs, state, str(tmp_path / "out")).collect()] == ["added"]
    written = spark.read.parquet(str(tmp_path / "out/documents"))
    assert files.write_changes(docs, written.select("path", "hash"), str(tmp_path / "out"), dry_run=True).count() == 0


def test_stream_upsert_is_idempotent(spark, tmp_path):
    from corpusloom.streaming import upsert

    src = str(tmp_path / "in")
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("b", "1")])):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").parquet(src)
        upsert.upsert(upsert.read(spark, src, "path string, text string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert {(r.path, r.text) for r in upsert.current(spark, str(tmp_path / "out")).collect()} == {("a", "2"), ("b", "1")}


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_gather_takes_strong_matches_of_any_rank(spark, tmp_path):
    from corpusloom.plans import context_queries

    passage = "parser tokens header loops kernel"
    rows = [(i, f"{passage} n{i}" if i <= 70 else "something else entirely", f"s{i % 3}", 10) for i in range(1, 91)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # toxic documents count as tests: they go, and use up no places
    spark.createDataFrame([(i, 0, int(i <= 5)) for i in range(1, 91)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in context_queries.gather_refactor(spark, str(tmp_path)).where("score >= 90").collect()}
    assert got == set(range(6, 71))


def test_context_pack_takes_the_whole_ranking(spark, tmp_path):
    from corpusloom.plans import context_queries

    passage = "parser tokens header loops kernel"
    texts = {i: f"{passage} n{i} {'x' * (9000 if i <= 40 else 100)}" for i in range(1, 61)} | {61: "something else entirely"}
    spark.createDataFrame([(i, t, "s", 10) for i, t in texts.items()], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(61, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ranked = [r.doc_id for r in context_queries.gather_feature(spark, str(tmp_path)).orderBy("position").collect()]
    used, want = 0, []
    for i in ranked:
        want.append(used + len(texts[i]) <= 16000)
        used += len(texts[i]) * want[-1]
    got = context_queries.context_pack(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.doc_id, r.packed) for r in got] == list(zip(ranked, want))
    assert {r.doc_id for r in got if r.packed} >= set(range(41, 61))
