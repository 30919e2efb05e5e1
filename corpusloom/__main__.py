"""Command line: scan, check, validate, context, stats."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpusloom.functions.text import markdown_links
from corpusloom.operators import pages
from corpusloom.operators.graph import DIRECTIONS
from corpusloom.operators.retrieve import Settings
from corpusloom.plans import scan as scan_
from corpusloom.plans.session import local_session
from corpusloom.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "check", "stats"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("--out", required=True)
        s.add_argument("--docs")
        s.add_argument("--exclude", action="append")
        s.add_argument("--max-size", type=int)
    sub.add_parser("validate").add_argument("out")
    c = sub.add_parser("context")
    c.add_argument("out")
    c.add_argument("query")
    c.add_argument("--task", choices=sorted(DIRECTIONS), default="feature")
    c.add_argument("--budget", type=int, default=16000)
    c.add_argument("--walk", action="store_true", help="expand by steps instead of a random walk")
    for flag in ("adaptive", "keep-strong", "damp-hubs", "drop-tests"):
        c.add_argument(f"--no-{flag}", action="store_false", dest=flag.replace("-", "_"))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command in ("scan", "check", "stats"):
        given = {"docs": a.docs, "exclude": a.exclude, "max_size": a.max_size}
        changes, stats = scan_.scan(spark, a.root, a.out, dry_run=a.command != "scan", **given)
        if a.command == "stats":
            print(files.markdown_table(stats, ["files"]).first()["text"])
            return 0
        for r in changes.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect():  # as many rows as kinds of changes
            print(r.status, r.n)
        return int(a.command == "check" and not changes.isEmpty())
    if a.command == "validate":
        docs = files.current_table(spark, f"{a.out}/documents", files.PUBLISHED)
        links = docs.select("path", F.explode(markdown_links(F.col("text"))).alias("target"))
        row = pages.validate(docs.select("path", "type"), links, docs.select(F.col("path").alias("key"))).first()
        print(f"documents without a type: {row.untyped}, links without a target: {row.broken}")
        return int(not row.valid)
    settings = Settings(adaptive=a.adaptive, keep_strong=a.keep_strong, damp_hubs=a.damp_hubs, drop_tests=a.drop_tests, expansion="walk" if a.walk else "ppr")
    queries = spark.createDataFrame([(0, a.query)], "query_id int, text string")
    for r in scan_.context(spark, a.out, queries, a.task, a.budget, settings).collect():  # one query
        print(r.text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
