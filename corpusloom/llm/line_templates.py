"""Line deduplication with a log-template tree.

A line's tokens are separated by [\\x20\\x09-\\x0D]+; a token with a digit is a
variable field from the start. The tree has a fixed depth: a line goes to the
leaf of its number of tokens and its ``LEADING`` first tokens. In a leaf, lines
are taken from the most frequent one on; a line joins the template with which it
shares most tokens if these are at least ``ALIKE`` of all, and fields in which
they differ become variable; else it begins a template.

Templates that occur in ``DOCUMENTS`` or more different texts are recurring, and
their lines are dropped. Equal texts count once, as copies of one document are not
boilerplate. Blank lines are kept and never counted.

Lines travel by hash until they matter: a leaf whose lines are found fewer than
``DOCUMENTS`` times cannot hold a recurring template, so only the lines of other
leaves are fetched, once each, from one text that has them. A leaf is parsed as a
stream, most frequent lines first; what its task holds are its templates. Each
text gets the list of its own dropped lines by a join on its hash.

Defined cases: null text stays null, with 0 lines; null ids are kept; repeated
rows each get their result; ties in frequency go by the line's bytes; an empty
table gives an empty result; a very long text or line is one value and never cut;
further columns may have any names, also n_lines and n_dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textblocks as tb
from corpusloom.plans.session import cut

LEADING = 3
ALIKE, DOCUMENTS = 0.7, 6
ANY = b"<*>"
_DIGIT, _FIELD = re.compile(rb"[0-9]"), re.compile(rb"[^ ]*[0-9][^ ]*")


def masked(line: bytes) -> bytes:
    line = b" ".join(line.split())
    return _FIELD.sub(ANY, line) if _DIGIT.search(line) else line


def _signed(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def leaf(line: bytes, depth: int) -> int:
    tokens = line.split(b" ")
    return _signed(b"%d %s" % (len(tokens), b" ".join(tokens[:depth])))


def text_hash(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


class Leaf:
    """Templates of the lines of one leaf, which are taken one by one.

    The first line waits: most leaves have no other.
    """

    def __init__(self, first: bytes) -> None:
        self.first, self.width, self.used = first, 0, 0

    def _begin(self) -> None:
        row = self.first.split(b" ")
        self.width, self.need = len(row), math.ceil(ALIKE * len(row))
        self.names: dict[bytes, int] = {ANY: 0}
        self.templates = np.empty((16, self.width), dtype=np.int64)
        self.at_token: dict[tuple[int, int], set[int]] = {}
        self._new(np.array([self.names.setdefault(t, len(self.names)) for t in row]))

    def _new(self, row: np.ndarray) -> int:
        if self.used == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
        self.templates[self.used] = row
        for key in enumerate(row.tolist()):
            self.at_token.setdefault(key, set()).add(self.used)
        self.used += 1
        return self.used - 1

    def add(self, line: bytes) -> int:
        """Number of the template that the next line joins or begins."""
        if not self.used:
            self._begin()
        row = np.array([self.names.setdefault(t, len(self.names)) for t in line.split(b" ")])
        # a template that shares `need` tokens shares one of any width - need + 1; the rarest are looked up
        found = sorted((self.at_token.get(key, ()) for key in enumerate(row.tolist())), key=len)[: self.width - self.need + 1]
        near = np.array(sorted(set().union(*found)), dtype=np.int64)
        if not len(near):
            return self._new(row)
        shared = (self.templates[near] == row).sum(axis=1)
        k = int(shared.argmax())
        if shared[k] < self.need:
            return self._new(row)
        at = int(near[k])
        template = self.templates[at]
        for place in np.flatnonzero(template != row).tolist():
            if template[place]:
                self.at_token[place, int(template[place])].discard(at)
                self.at_token.setdefault((place, 0), set()).add(at)
            template[place] = 0
        return at


def _lines_of(text: bytes) -> list[bytes]:
    return list(dict.fromkeys(m for m in map(masked, text.split(b"\n")) if m))


def line_facts(texts: DataFrame) -> DataFrame:
    """(print, text) to print, name and leaf of the distinct masked lines of each text; a name is a line's hash."""

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, names, leaves = [], [], []
            for print_, text in dict(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())).items():
                lines = _lines_of(text)
                prints += [print_] * len(lines)
                names += map(text_hash, lines)
                leaves += [leaf(m, LEADING) for m in lines]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(names, pa.binary()), pa.array(leaves, pa.int64())], ["print", "name", "leaf"])

    return texts.mapInArrow(run, "print long, name binary, leaf long").distinct()


def lines_by_name(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """name, leaf, n (texts with the line) and line of all lines in facts (print, name, leaf)."""
    counted = facts.groupBy("name").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"), F.min("print").alias("print"))
    wanted = counted.groupBy("print").agg(F.collect_list("name").alias("names"))  # of the lines of one text

    @tb.lean
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lines = [], []
            for text, asked in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                asked = set(asked)
                for m in _lines_of(text):
                    if (name := text_hash(m)) in asked:
                        names.append(name)
                        lines.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lines, pa.binary())], ["name", "line"])

    fetched = texts.join(wanted, "print").select("text", "names").mapInArrow(fetch, "name binary, line binary")
    return fetched.groupBy("name").agg(F.first("line").alias("line")).join(counted.drop("print"), "name")


def templates_of(lines: DataFrame) -> DataFrame:
    """name, template (name of its first line) and n of each line."""

    @tb.lean
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, firsts = None, None, []
        for b in batches:
            out = []
            for key, name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != last:
                    last, tree, firsts = key, Leaf(line), [name]
                    at = 0
                else:
                    at = tree.add(line)
                    if at == len(firsts):
                        firsts.append(name)
                out.append(firsts[at])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary()), b.column(3)], ["name", "template", "n"])

    order = ["leaf", F.desc("n"), "line"]
    return lines.select("leaf", "name", "line", "n").repartition("leaf").sortWithinPartitions(*order).mapInArrow(parse, "name binary, template binary, n long")


def recurring(texts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(print, text) to print and name of the lines of recurring templates in each text."""
    facts = cut(line_facts(texts))
    crowded = facts.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("leaf")
    facts = cut(facts.join(crowded, "leaf", "left_semi"))
    named = cut(templates_of(lines_by_name(texts, facts)))
    sums = named.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("size")).where(F.col("n") >= documents)
    several = named.select("name", "template").join(sums.where("size > 1").select("template"), "template")
    # of templates of one line the number of texts is known; with several, a text may have more than one of them
    spread = several.join(facts, "name").groupBy("template").agg(F.count_distinct("print").alias("n")).where(F.col("n") >= documents).select("template")
    found = sums.where("size = 1").select(F.col("template").alias("name")).unionByName(several.join(spread, "template").select("name"))
    return facts.join(found, "name").select("print", "name")


def clean(docs: DataFrame, text_col: str = "text", documents: int = DOCUMENTS) -> DataFrame:
    """docs' columns with the lines of recurring templates removed from the text, and n_lines and n_dropped by position."""
    tb.small_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema.fields])
    text = F.col(names[at])
    plain = plain.withColumn("print", F.when(text.isNotNull(), F.xxhash64(text)))  # a list of names does nothing to a text without such lines, so clashes are harmless
    texts = plain.select("print", text.alias("text")).where(F.col("text").isNotNull())
    dropped = recurring(texts, documents).groupBy("print").agg(F.collect_set("name").alias("drop"))  # of the lines of one text

    @tb.lean
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n_lines, n_dropped = [], [], []
            for raw, drop in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist()):
                if raw is None or not drop:
                    out.append(raw)
                    n_lines.append(0 if raw is None else raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                lines, gone = raw.split(b"\n"), set(drop)
                kept = [x for x in lines if text_hash(masked(x)) not in gone]
                out.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = plain.join(dropped, "print", "left").select(*names, "drop")
    done = joined.mapInArrow(apply, T.StructType([*fields.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    return done.toDF(*docs.columns, "n_lines", "n_dropped")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_chars and text_sha256 of what is left."""
    out = clean(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
