"""Git trees as a data source, front matter, and edges read back."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import front
from corpusloom.operators import readback
from corpusloom.sources import files, git


def run(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True).stdout.decode()


@pytest.fixture
def repo(tmp_path):
    rng = random.Random(1)
    tree = {"a.py": b"print(1)\n", "pkg/__init__.py": b"", "pkg/deep/b c.py": b"x = '\xc3\xa9'\n", "docs/secret.md": b"left out of archives\n", "raw.bin": bytes(rng.randrange(256) for _ in range(70_000)), "version.txt": b"$Format:%H$\n"}
    tree |= {f"many/f{k}.py": f"n = {k}\n".encode() for k in range(50)}
    root = tmp_path / "repo"
    for path, content in (tree | {".gitattributes": b"docs/secret.md export-ignore\nversion.txt export-subst\n"}).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "link").symlink_to("a.py")
    run(root, "init", "-q")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "one")
    return root


def test_git_tree_equals_a_checkout(spark, repo, tmp_path):
    git.register(spark)
    rows = spark.read.format("git_tree").option("repo", str(repo)).option("partitions", 5).load()
    got = {r.path: bytes(r.content) for r in rows.collect()}
    out = tmp_path / "out"
    run(repo, "worktree", "add", "-q", str(out), "HEAD")
    wanted = {}
    for d, _, names in os.walk(out):
        for name in names:
            full = os.path.join(d, name)
            if name != ".git":
                wanted[os.path.relpath(full, out)] = os.readlink(full).encode() if os.path.islink(full) else open(full, "rb").read()
    assert got == wanted and "docs/secret.md" in got
    archived = subprocess.run(f"git -C {repo} archive HEAD | tar -t", shell=True, check=True, capture_output=True).stdout.decode().split("\n")
    assert "docs/secret.md" not in archived  # which an archive would have lost


def test_git_tree_reads_each_file_once_in_partitions(spark, repo):
    git.register(spark)
    rows = spark.read.format("git_tree").option("repo", str(repo)).option("partitions", 4).load()
    assert rows.rdd.getNumPartitions() == 4
    listed = run(repo, "ls-tree", "-r", "--name-only", "-z", "HEAD").split("\0")[:-1]
    assert sorted(r.path for r in rows.select("path").collect()) == sorted(listed)
    assert rows.where("size <> length(content)").count() == 0
    assert {r.path for r in files.git_tree(spark, str(repo)).collect()} == {p for p in listed if p.endswith(".py")}
    with pytest.raises(Exception, match="nowhere"):
        files.git_tree(spark, str(repo), "nowhere").collect()


HEADERS = {
    "type: Note\ntitle: \"a \\\"b\\\" \\u00e9\"\ntags: [\"x\", y z, a:b, 1]\nmeta: {size: 3, done: true}": {"type": "Note", "title": 'a "b" é', "tags": ["x", "y z", "a:b", 1], "meta": {"size": 3, "done": True}},
    "# made\ntype: 'No''te'  # c\ntags:\n  - 'a'\n  - \"b\"\nmeta:\n  size: -1.5\n  owner:\n    name: x": {"type": "No'te", "tags": ["a", "b"], "meta": {"size": -1.5, "owner": {"name": "x"}}},
    "tags:\n- a:b\n- c\nmeta:\n- size: 1\n  done: ~\n- size: 4": {"tags": ["a:b", "c"], "meta": [{"size": 1, "done": None}, {"size": 4}]},
    "k:\n  - - 1\n    - 2\n  - x: 1\n    y:\n      - z": {"k": [[1, 2], {"x": 1, "y": ["z"]}]},
    "url: http://a.b/c#d\nempty: \"\"\nnone:\nflow: []\nmap: {}": {"url": "http://a.b/c#d", "empty": "", "none": None, "flow": [], "map": {}},
    "a: \"open": None,
    "a: b: c": None,
    "- x\n- y": None,
    "a: 1\n  b: 2": None,
    "a: [1, 2": None,
    "a: [1, 2] x": None,
    "a: 1\na: 2": None,
    "a: \"\\q\"": None,
    "\ta: 1": None,
    "a: &x 1": None,
    "": None,
}


def test_front_matter_as_variant(spark):
    import json

    docs = spark.createDataFrame([(k, f"---\n{h}\n---\n\nbody") for k, h in enumerate(HEADERS)] + [(-1, "no header"), (-2, None)], "i int, t string")
    got = {r.i: r.j for r in docs.select("i", F.to_json(front.front(F.col("t"))).alias("j")).collect()}
    assert {k: json.loads(got[k]) if got[k] else None for k in got} == dict(enumerate(HEADERS.values())) | {-1: None, -2: None}
    one = docs.where("i = 0").select(front.value(front.front(F.col("t")), "$.tags", "array<string>").alias("tags"), front.value(front.front(F.col("t")), "$.meta.size", "int").alias("size"), front.value(front.front(F.col("t")), "$.meta.none").alias("none")).first()
    assert (one.tags, one.size, one.none) == (["x", "y z", "a:b", "1"], 3, None)


def test_tags_come_back_as_a_list(spark):
    docs = spark.createDataFrame([("/a.md", "Note", 'say "hi": #1', ["a b", "security:x", "é, ö"], "text")], "path string, type string, title string, tags array<string>, body string")
    text = files.render(docs, ["type", "title", "tags"])
    read = text.select(front.front(F.col("text")).alias("f"))
    row = read.select(front.value(F.col("f"), "$.title").alias("title"), front.value(F.col("f"), "$.tags", "array<string>").alias("tags")).first()
    assert (row.title, row.tags) == ('say "hi": #1', ["a b", "security:x", "é, ö"])


def body(down, up):
    lines = lambda edges: "\n".join(f"- [{p}](/files/{p}.md): uses {n} (weight {w})" for p, n, w in edges) or "None."
    return f"# Summary\n\nx\n\n# Depends on\n\n{lines(down)}\n\n# Used by\n\n{lines(up)}\n"


def test_edges_are_read_back_and_compared(spark):
    docs = [
        ("/files/a.py.md", body([("b.py", "`x`, `y`", 3), ("c.py", "re-exported names only", 1), ("gone.py", "`z`", 2)], [])),
        ("/files/b.py.md", body([("c.py", "`q`", 2)], [("a.py", "`x`, `y`", 4)])),
        ("/files/c.py.md", body([], [("a.py", "re-exported names only", 1), ("b.py", "`r`", 2), ("d.py", "`s`", 1)])),
        ("/files/d.py.md", body([], [])),
        ("/index.md", "# Depends on\n\n- [a.py](/files/a.py.md): uses `x` (weight 1)\n"),
    ]
    df = spark.createDataFrame([(p, f"---\ntype: T\n---\n\n{t}") for p, t in docs if p != "/index.md"] + [docs[-1]], "path string, text string").where("path like '/files/%'")
    assert sorted((r.src, r.dst, r.weight, tuple(r.names)) for r in readback.edges(df).collect()) == [("a.py", "b.py", 3.0, ("x", "y")), ("a.py", "c.py", 1.0, ()), ("a.py", "gone.py", 2.0, ("z",)), ("b.py", "c.py", 2.0, ("q",))]
    assert sorted(map(tuple, readback.asymmetric(df).collect())) == [("a.py", "b.py", "weights differ"), ("a.py", "gone.py", "no such document"), ("a.py", "gone.py", "not listed by the target"), ("b.py", "c.py", "names differ"), ("d.py", "c.py", "not listed by the source")]
