"""URL filters with redirect equivalence.

A rule (verdict, host, path) fits its host and all subdomains where the URL's
path starts with the rule's; the longest rule (host and path together) wins.
A URL that no rule fits takes part in its aliases' decisions: pages are
connected with the targets of their canonical links and of their redirects
(``<meta http-equiv="refresh">``), and in each connected component an explicit
allow goes before an explicit block; without either the URL is allowed. A rule of
the URL itself always goes first.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end. Null URLs and those
without ``://`` have neither. An alias is known by host, path and query without
``utm_*`` and ``ref`` parameters: scheme and fragment do not matter.

Everything is DataFrame functions. Rules are a bounded list (a parameter) held as
a constant map by host. Components are found by distributed stars over 64-bit
hashes of URLs.

Defined cases: null html has no links; links without a usable target are
ignored; repeated rows and null ids each give a row; an empty table gives an
empty result; further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components

#: Fixed values of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _host(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*", 0)


def host(url: Column) -> Column:
    return F.translate(_host(_rest(url)), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and what remains of the query; null where there is no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    key = F.concat(host(url), path(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host(url) != "", key)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Longest rule that fits as struct(length, rule, verdict); null if none does."""
    by_host: dict[str, list[Column]] = {}
    for verdict, of, begin in rules:
        by_host.setdefault(of, []).append(F.struct(F.lit(len(of + begin)).alias("length"), F.lit(of + begin).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(begin).alias("begin")))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    near = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())
    return F.array_max(F.filter(F.flatten(near), lambda r: F.startswith(path, r["begin"])))


def link_targets(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url and target (absolute) of canonical links and redirects."""
    html, url = pages[html_col].cast("string"), pages[url_col].cast("string")
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    linked = pages.select(url.alias("url"), html.alias("html")).where(F.col("html").rlike(r"(?i)canonical|refresh") & (host(F.col("url")) != ""))
    tag = linked.select("url", F.explode(tags).alias("tag"))
    quoted = r"""["']?\s*"""
    canonical = F.when(F.col("tag").rlike(rf"(?is)^<link\b.*\brel\s*=\s*{quoted}canonical\b"), F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'>\s]+)""", 1))
    refresh = F.when(F.col("tag").rlike(rf"(?is)^<meta\b.*\bhttp-equiv\s*=\s*{quoted}refresh\b"), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)""", 1))
    to = tag.select("url", F.coalesce(canonical, refresh).alias("to")).where("to <> ''")
    here = F.concat(F.lit("http://"), host(F.col("url")))
    folder = F.regexp_extract(path(F.col("url")), r"^(.*/)[^/]*$", 1)
    absolute = (
        F.when(F.col("to").rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to")))
        .when(F.startswith("to", F.lit("/")), F.concat(here, F.col("to")))
        .when(F.col("to").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(F.col("to").rlike(r"^[#?]"), F.concat(here, path(F.col("url")), F.col("to")))
        .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    return to.select("url", absolute.alias("target")).where(F.col("target").isNotNull())


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    links = link_targets(pages, url_col, html_col)
    ends = links.select(F.xxhash64(alias_key(F.col("url"))).alias("src"), F.xxhash64(alias_key(F.col("target"))).alias("dst"), F.col("target").alias("url"), "target", alias_key(F.col("target")).alias("key")).where("key is not null")
    parts = connected_components(ends, "src", "dst")

    url = F.col("url")
    seen = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    judged = seen.select("page_id", host(url).alias("host"), path(url).alias("path"), F.xxhash64(alias_key(url)).alias("node"), (host(url) != "").alias("has_host"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    targets = ends.select(F.col("dst").alias("node"), matching_rule(host(url), path(url), rules).alias("own"))
    explicit = judged.select("node", "own").unionByName(targets).where("own is not null")
    decided = parts.join(explicit, "node").groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    by_alias = parts.join(decided, "component").select("node", "allowed", "blocked")
    # pages without a host have no aliases, and would all meet in one key
    alone = judged.where(~F.col("has_host")).withColumn("allowed", F.lit(None).cast("boolean")).withColumn("blocked", F.lit(None).cast("boolean"))
    out = judged.where("has_host").join(by_alias, "node", "left").unionByName(alone)
    through = F.when(F.col("has_host") & F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), through).alias("verdict"))
