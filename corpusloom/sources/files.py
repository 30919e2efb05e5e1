"""Sources and sinks: code trees, markdown documents, records, commit logs, state."""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text
from corpusloom.operators.modules import latest
from corpusloom.sources import git

#: Directories that hold no sources.
SKIPPED = (".git .hg .svn node_modules venv .venv env .env build dist __pycache__ .tox .nox .mypy_cache .pytest_cache site-packages .knowledge .eggs .idea .vscode").split()


def _relative(root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*", "/"), "^" + "/" + root.split(":")[-1].strip("/").replace(".", r"\.") + "/", "")


def _underscored(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, content of the files whose names begin with '_', which Spark's own listings leave out (and with them every __init__.py)."""
    place, fs = _place(spark, root)
    found, listed = [], fs.listFiles(place, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName().startswith("_") and path.getName().endswith(suffix):
            found.append((path.toString(),))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for b in batches:
            raw = []
            for uri in b.column(0).to_pylist():
                system, inner = arrow_fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if re.match("file:/[^/]", uri) else uri)
                with system.open_input_stream(inner) as f:
                    raw.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["path", "content"])

    return spark.createDataFrame(found, "path string").mapInArrow(read, "path string, content binary")


def code_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the .py files below a root, without skipped, hidden and excluded directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    rows = files.select("path", "content").unionByName(_underscored(spark, root, ".py")).select(_relative(root).alias("path"), "content")
    return sources_only(rows, exclude)


def sources_only(rows: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose paths are in no skipped, hidden or excluded directory."""
    parts = F.split("path", "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIPPED) | p.startswith("."))
    out = F.lit(False)
    for e in exclude:
        out = out | text.under(F.col("path"), F.lit(e))
    return rows.where(~hidden & ~out)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """path, type, title, front, body, sections, links of markdown documents below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    raw = files.select(F.concat(F.lit("/"), _relative(root)).alias("path"), F.col("content").cast("string").alias("text"))
    parsed = raw.select("path", text.front_matter(F.col("text")).alias("front"), text.body(F.col("text")).alias("body"))
    return parsed.select("path", text.field(F.col("front"), "type").alias("type"), text.field(F.col("front"), "title").alias("title"), "front", "body", text.sections(F.col("body")).alias("sections"), text.markdown_links(F.col("body")).alias("links"))


def records(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last record of each key of JSON lines with a growing field ``seq``."""
    return latest(spark.read.schema(schema).json(path), key, "seq")


def commits(log: DataFrame, least: int = 2, most: int = 10, newest: int = 300) -> DataFrame:
    """commit, file of `git log --name-only` rows (seq, commit, file): .py files of the newest commits of least to most of them."""
    rows = log.where(F.col("file").endswith(".py")).distinct()
    sizes = rows.groupBy("commit").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).where(F.col("n").between(least, most))
    return rows.join(sizes.orderBy(F.desc("seq")).limit(newest).select("commit"), "commit").select("commit", "file")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written earlier; no rows if there is none."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def render(docs: DataFrame, fields: list[str], body: str = "body") -> DataFrame:
    """path, text: front matter of the given fields (nulls left out) and body.

    Lists become lists; a text that would be read as something else is quoted.
    """

    def shown(f: str) -> Column:
        if isinstance(docs.schema[f].dataType, T.ArrayType):
            return F.to_json(f)
        plain = F.col(f).cast("string")
        quoted = F.regexp_replace(F.to_json(F.array(plain)), r"\A\[|\]\z", "")
        unsafe = plain.rlike(r"\A[\s\[\]{},\"'#&*!|>%@`?-]|\A\z|\s\z|:\s|:\z|\s#|\n|\A[-+]?[0-9.]+\z|\A(?i:true|false|null|~)\z")
        return F.when(unsafe, quoted).otherwise(plain)

    lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), shown(f))) for f in fields]
    return docs.select("path", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col(body)).alias("text"))


def requirement_texts(spark: SparkSession, root: str) -> DataFrame:
    """source, text of the .md and .txt files below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").load(root)
    return files.select(_relative(root).alias("source"), F.col("content").cast("string").alias("text"))


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, plain or gzipped."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines state; none if it is missing, and none of its corrupt records."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").select(*names)


def git_tree(spark: SparkSession, repo: str, commit: str = "HEAD", suffix: str = ".py") -> DataFrame:
    """path, content of the files of a commit; the repository must lie where executors can read it."""
    git.register(spark)
    return spark.read.format("git_tree").option("repo", repo).option("commit", commit).option("suffix", suffix).load().select("path", "content")


def git_log(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """seq (larger is newer), commit, file of all commits up to one."""
    out = subprocess.run(["git", "-C", repo, "log", "--no-merges", "--name-only", "--format=%x01%H", commit], check=True, capture_output=True).stdout.decode("utf-8", "replace")
    parts = [x.split("\n") for x in out.split("\x01") if x.strip()]
    rows = [(len(parts) - k, lines[0], f) for k, lines in enumerate(parts) for f in lines[1:] if f]
    return spark.createDataFrame(rows, "seq long, commit string, file string")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file at once: written beside it, then renamed."""
    beside, fs = _place(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    place, _ = _place(spark, path)
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    return spark.read.text(path, wholetext=True).first()[0] if _exists(spark, path) else None


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new generation of a table and then points to it; readers see the old or the new one, never a part."""
    name = f"generation-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    write_text(df.sparkSession, f"{path}/CURRENT", name)


def current_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest generation of a table; no rows if there is none."""
    name = read_text(spark, f"{path}/CURRENT")
    return spark.read.schema(schema).parquet(f"{path}/{name}") if name else spark.createDataFrame([], schema)


def sticky_options(spark: SparkSession, path: str, defaults: dict, given: dict) -> dict:
    """Given options before those of the last time before the defaults; kept for the next time."""
    try:
        before = json.loads(read_text(spark, path) or "{}")
    except json.JSONDecodeError:
        before = {}
    options = {k: given[k] if given.get(k) is not None else before.get(k, v) for k, v in defaults.items()}
    write_text(spark, path, json.dumps(options, sort_keys=True))
    return options


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: a report's rows as a markdown table, sorted. For reports, which are small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = f"| {' | '.join(rows.columns)} |\n|{'|'.join(['---'] * len(rows.columns))}|\n"
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("l"))
    return listed.select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("text"))


def write_report(rows: DataFrame, path: str, form: str) -> None:
    """A report as csv or json files."""
    writer = rows.coalesce(1).write.mode("overwrite")
    {"csv": lambda: writer.option("header", "true").csv(path), "json": lambda: writer.json(path)}[form]()


#: Columns of a published document.
PUBLISHED = "path string, type string, title string, description string, tags array<string>, hash string, text string, timestamp timestamp"


def publish(docs: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Makes docs (path, type, title, description, tags, text) the published documents; gives path and status of all changes.

    Unchanged documents keep their timestamp, vanished ones are gone from the new
    generation, and every change is appended to the log. Nothing is written when
    nothing has changed, or on a dry run.
    """
    from corpusloom.operators.incremental import carry_timestamps, diff
    from corpusloom.plans.session import cut

    spark = docs.sparkSession
    before = current_table(spark, path, PUBLISHED)
    now = cut(carry_timestamps(before, docs.withColumn("hash", text.content_hash(F.col("text"))), F.date_trunc("SECOND", F.current_timestamp())))
    changes = cut(diff(before, now).where("status <> 'unchanged'"))
    if not dry_run and not changes.isEmpty():
        replace_table(now.select("path", "type", "title", "description", "tags", "hash", "text", "timestamp"), path)
        changes.withColumn("at", F.date_trunc("SECOND", F.current_timestamp())).write.mode("append").parquet(f"{path}/log")
    return changes


def write_changes(rendered: DataFrame, state: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Writes documents whose content differs from the state (path, hash) as a new batch; gives path, status of all changes."""
    from corpusloom.operators.incremental import diff

    now = rendered.withColumn("hash", text.content_hash(F.col("text")))
    changes = diff(state, now).where("status <> 'unchanged'")
    if not dry_run:
        now.join(changes.where("status <> 'removed'").select("path"), "path", "left_semi").write.mode("append").parquet(f"{path}/documents")
        changes.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/log")
    return changes
