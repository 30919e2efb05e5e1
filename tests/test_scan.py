"""A small code tree from scan to context."""

import json
import subprocess

import pytest

from pyspark.sql import functions as F

from corpusloom.__main__ import main, parser
from corpusloom.functions import front
from corpusloom.operators import community, requirements, retrieve, search, segments
from corpusloom.plans import scan as scan_
from corpusloom.sources import files

TREE = {
    "shop/__init__.py": '"""Shop."""\nfrom shop.cart import Cart\n',
    "shop/cart.py": '"""shop.cart\n=========\n\nKeeps what a customer wants."""\nfrom .price import total\nimport hashlib\n\nclass Cart:\n    """A cart."""\n    def __init__(self):\n        self.items = []\n    def sum(self):\n        return total(self.items)\n',
    "shop/price.py": "from shop import tax\ndef total(items):\n    return tax.rate(sum(items))\n",
    "shop/tax.py": "def rate(x):\n    return eval('x * 2')\n",
    "shop/broken.py": "def open_(:\n",
    "tests/test_cart.py": "from shop.cart import Cart\ndef test_sum():\n    assert Cart().sum() == 0\n",
    "tools/lonely.py": "print('x')\n",
    "docs/need.md": "# Carts add up\n\nThe class Cart in shop/cart.py adds prices.\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in TREE.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    return str(tmp_path / "repo")


def test_scan_check_context(spark, root, tmp_path, capsys):
    out = str(tmp_path / "out")
    changes, stats = scan_.scan(spark, root, out, docs="docs")
    row = stats.first()
    assert (row.files, row.parse_errors, row.requirements, row.security_findings) == (7, 1, 1, 1) and row.edges >= 4
    docs = {r.path: r for r in files.current_table(spark, f"{out}/documents", files.PUBLISHED).collect()}
    assert (row.parse_cache_hits, row.documents, row.changed_documents) == (0, len(docs), len(docs)) and row.seconds_total > 0
    assert set(changes.where("status = 'added'").toPandas().path) == set(docs)
    cart = docs["/files/shop/cart.py.md"]
    assert cart.description == "Keeps what a customer wants." and "`class Cart`" in cart.text and "[Carts add up](/requirements/need.md)" in cart.text
    assert "dynamic-code-exec" in docs["/files/shop/tax.py.md"].text and "Parse failures" in docs["/index.md"].text
    assert "Implemented by" in docs["/requirements/need.md"].text and "/files/shop/cart.py.md" in docs["/requirements/need.md"].text
    (tmp_path / "repo/tools/lonely.py").unlink()
    (tmp_path / "repo/shop/tax.py").write_text("def rate(x):\n    return 2 * x\n")
    assert not scan_.check(spark, root, out)
    again, after = scan_.scan(spark, root, out)  # options are those of the last scan
    status, row = {r.path: r.status for r in again.collect()}, after.first()
    assert row.parse_cache_hits == row.files - 1 and row.changed_documents == sum(x != "removed" for x in status.values()) < row.documents
    tags = files.current_table(spark, f"{out}/documents", files.PUBLISHED).where("path = '/files/shop/tax.py.md'").select("tags", front.value(front.front(F.col("text")), "$.tags", "array<string>").alias("read")).first()
    assert tags.read == tags.tags and "python" in tags.read
    assert status["/files/tools/lonely.py.md"] == "removed" and status["/files/shop/tax.py.md"] == "modified" and "/files/shop/cart.py.md" not in status
    now = {r.path: r for r in files.current_table(spark, f"{out}/documents", files.PUBLISHED).collect()}
    assert "/files/tools/lonely.py.md" not in now and now["/files/shop/cart.py.md"].timestamp == cart.timestamp
    assert main(["validate", out]) == 0
    queries = spark.createDataFrame([(1, "sum of a cart")], "query_id int, text string")
    text = scan_.context(spark, out, queries, "bug", settings=retrieve.Settings(expansion="walk")).first()["text"]
    assert text.index("shop/cart.py") < text.index("shop/price.py") and "## Relevant files" in text
    assert parser().parse_args(["context", out, "x", "--no-adaptive"]).adaptive is False


def test_index_is_kept_for_its_content_only(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red cart"), ("b", "blue cart cart")], "id string, body string")
    path = str(tmp_path / "index")
    segments.refresh(docs, "id", {"body": docs["body"]}, path, "d1")
    assert segments.usable(spark, path, "d1") and not segments.usable(spark, path, "d2") and not segments.usable(spark, str(tmp_path / "no"), "d1")
    q = spark.createDataFrame([(1, "cart red")], "q int, t string")
    asked = search.query_terms(q, "q", q["t"])
    kept = {r.doc: round(r.score, 9) for r in segments.scores(spark, path, asked).collect()}
    assert kept == {r.doc: round(r.score, 9) for r in search.search(docs, "id", {"body": docs["body"]}, asked).collect()}


def test_search_without_texts_warns(spark):
    docs = spark.createDataFrame([("a", "red cart")], "id string, name string")
    with pytest.warns(UserWarning, match="metadata"):
        search.search(docs, "id", {"name": docs["name"]}, spark.createDataFrame([(1, "cart", 1)], "query_id int, term string, times long"))


def test_state_and_reports(spark, tmp_path):
    bad = tmp_path / "state.json"
    bad.write_text('{"path": "a", "hash": "1"}\n{broken\n')
    assert [tuple(r) for r in files.json_state(spark, str(bad), "path string, hash string").collect()] == [("a", "1")]
    assert files.json_state(spark, str(tmp_path / "none"), "path string").count() == 0
    assert files.sticky_options(spark, str(tmp_path / "o.json"), {"a": 1, "b": 2}, {"a": 5}) == {"a": 5, "b": 2}
    assert files.sticky_options(spark, str(tmp_path / "o.json"), {"a": 1, "b": 2}, {"b": 7}) == {"a": 5, "b": 7}
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": 5, "b": 7}
    rows = spark.createDataFrame([(2, "y"), (1, None)], "n int, t string")
    assert files.markdown_table(rows, ["n"]).first()["text"] == "| n | t |\n|---|---|\n| 1 |  |\n| 2 | y |"
    files.write_report(rows, str(tmp_path / "r"), "csv")
    assert files.csv_rows(spark, str(tmp_path / "r"), "n int, t string").count() == 2
    files.write_report(rows, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_git_sources(spark, root):
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    got = {r.path: bytes(r.content).decode() for r in files.git_tree(spark, root).collect()}
    assert got == {k: v for k, v in TREE.items() if k.endswith(".py")}
    log = files.git_log(spark, root)
    assert log.count() == len(TREE) and files.commits(log, 2, 10).count() == 7


def test_bundles_are_kept_by_commit_and_code(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "small", str(tmp_path / "store")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    root.mkdir()
    (root / "a.py").write_text("import b\n")
    (root / "b.py").write_text("def f(): pass\n")
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    folder, hit, stats = scan_.bundle(spark, str(root), "HEAD", store)
    assert not hit and stats["files"] == 2 and (tmp_path / "store").is_dir()
    (root / "b.py").unlink()  # the commit counts, not what lies about
    again, hit, kept = scan_.bundle(spark, str(root), "HEAD", store)
    assert hit and again == folder and kept == stats
    assert files.current_table(spark, f"{folder}/documents", files.PUBLISHED).where("path = '/files/b.py.md'").count() == 1
    monkeypatch.setattr(scan_, "scan", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("made anew")))
    monkeypatch.setattr(scan_, "code_tag", lambda: "other")
    with pytest.raises(RuntimeError, match="made anew"):
        scan_.bundle(spark, str(root), "HEAD", store)


def test_singletons_join_their_heaviest_group(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "3"), ("f", "4")], "node string, grp string")
    links = spark.createDataFrame([("a", "e", 1.0), ("c", "e", 3.0)], "a string, b string, weight double")
    assert {r.node: r.grp for r in community.merge_singletons(m, links).collect()} == {"a": "1", "b": "1", "c": "2", "d": "2", "e": "2", "f": "1"}


def test_requirement_titles_and_empty(spark):
    rows = spark.createDataFrame([("docs/a b.txt", "no heading"), ("docs/c.md", None), ("docs/d.py", "x")], "source string, text string")
    got = {r.slug: (r.title, r.text) for r in requirements.requirements(rows).collect()}
    assert got == {"a-b": ("a b", "no heading"), "c": ("c", "")}
