"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after every run of
``[\\x20\\x09-\\x0D]`` is replaced by one space; null counts as empty.

1. Each task reads its rows into an open-addressing table that compares whole
   contents. The table gives up its entries when it has reached its memory limit,
   so it only pre-aggregates: a text that makes up a third of all rows leaves
   each task as a few rows.
2. The entries are dealt by hash. Each task that receives them keeps them in
   memory up to its limit; beyond it, it partitions them by hash bits to spill
   files, recursively, until a bucket fits a table. Spill files are private to
   the task and deleted with it: a lost executor only makes Spark run the task
   again.

Equality is decided on whole contents. The group that results is named by the
SHA-256 of its normalised text, which ``group_table`` gives for every group and
``decisions`` uses to find each row's group.

Defined cases: null text is the empty text; a text of white space only is one
space and differs from the empty text; null ids never win against other ids and
are the smallest only in groups without any id; of rows that agree in id and
text exactly one stays; an empty table gives an empty result; further columns are
kept by ``keep_first`` whatever their names, and columns named like the
operator's own outputs are not an obstacle.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textblocks as tb

#: Bytes of content that a task holds before it flushes or spills.
MEMORY = 32 << 20
#: Spill files of one level, and levels before a bucket is streamed into one table whatever its size.
FANOUT, DEPTH = 16, 12

_NO_ID = (1, 0)


def normalise(texts: pa.Array) -> Iterator[bytes]:
    data, offsets = tb.column(texts)
    for _, _, block, at in tb.blocks(data, offsets):
        out, cuts = tb.squeeze(block, at)
        raw, cuts = out.tobytes(), cuts.tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield raw[a:b]


def content_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


class Table:
    """Open addressing with linear probing; an entry is (hash, content, least key, rows, payload)."""

    def __init__(self) -> None:
        self.mask, self.bytes = 255, 0
        self.slots = array("q", [-1]) * 256
        self.entries: list[list] = []

    def add(self, h: int, content: bytes, key: tuple, rows: int, payload: object) -> None:
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == h and entry[1] == content:
                entry[3] += rows
                if key < entry[2]:
                    self.bytes += len(payload or b"") - len(entry[4] or b"")
                    entry[2], entry[4] = key, payload
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, key, rows, payload])
        self.bytes += len(content) + len(payload or b"") + 200
        if 3 * len(self.entries) > 2 * self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for k, entry in enumerate(self.entries):
            at = entry[0] & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


def grace(records: Iterable[tuple], memory: int = MEMORY, hasher: Callable[[bytes], int] = content_hash, depth: int = 0) -> Iterator[list]:
    """Entries of distinct contents of records (content, key, rows, payload).

    Nothing is spilled while all distinct contents fit the memory limit.
    """
    table, records = Table(), iter(records)
    for content, key, rows, payload in records:
        table.add(hasher(content), content, key, rows, payload)
        if table.bytes > memory and depth < DEPTH:
            break
    else:
        yield from table.entries
        return
    folder = tempfile.mkdtemp(prefix="grace")
    try:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(FANOUT)]

        def spill(h: int, record: tuple) -> None:
            pickle.dump(record, files[(h >> (60 - 4 * depth)) % FANOUT], protocol=5)

        for h, *record in table.entries:
            spill(h, tuple(record))
        del table
        for record in records:
            spill(hasher(record[0]), record)
        for f in files:
            f.close()
        for f in files:
            yield from grace(_read(f.name), memory, hasher, depth + 1)
            os.remove(f.name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _flushing(records: Iterable[tuple], memory: int) -> Iterator[list]:
    table = Table()
    for content, key, rows, payload in records:
        table.add(content_hash(content), content, key, rows, payload)
        if table.bytes > memory:
            yield from table.entries
            table = Table()
    yield from table.entries


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a few MB each."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


_ENTRY = "h long, content binary, no_id int, id long, n long, payload binary"
_ENTRY_ARROW = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("no_id", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
_GROUP = "text_sha256 string, keep_id long, group_size long"
_GROUP_ARROW = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _groups(plain: DataFrame, at_id: int, at_text: int, memory: int, whole_rows: bool) -> DataFrame:
    """One row per distinct text: the row of the least id if ``whole_rows``, else text_sha256, keep_id and group_size.

    A row travels as its pickled columns, without the text where the content is the text itself.
    """
    tb.small_batches(plain.sparkSession)
    fields = plain.schema

    @tb.lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                ids, texts = b.column(at_id).cast(pa.int64()).to_pylist(), b.column(at_text).cast(pa.string())
                columns = [c.to_pylist() for c in b.columns] if whole_rows else []
                raw = texts.cast(pa.binary()).to_pylist() if whole_rows else []
                for k, (i, content) in enumerate(zip(ids, normalise(texts))):
                    payload = None
                    if whole_rows:
                        row = [c[k] for c in columns]
                        same = raw[k] == content
                        if same:
                            row[at_text] = None
                        payload = pickle.dumps((same, row), protocol=5)
                    yield content, _NO_ID if i is None else (0, i), 1, payload

        yield from _batches(((_signed(h), content, *key, n, p) for h, content, key, n, p in _flushing(records(), memory)), _ENTRY_ARROW)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for _, content, no_id, i, n, payload in zip(*(c.to_pylist() for c in b.columns)):
                    yield content, (no_id, i), n, payload

        return grace(records(), memory)

    @tb.lean
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = ((hashlib.sha256(content).hexdigest(), None if no_id else i, n) for _, content, (no_id, i), n, _ in merged(batches))
        yield from _batches(done, _GROUP_ARROW)

    @tb.lean
    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def rows() -> Iterator[tuple]:
            for _, content, _, _, payload in merged(batches):
                same, row = pickle.loads(payload)
                if same:
                    row[at_text] = content.decode()
                yield tuple(row)

        yield from _batches(rows(), to_arrow_schema(fields))

    dealt = plain.mapInArrow(local, _ENTRY).repartition("h")
    return dealt.mapInArrow(restore, fields) if whole_rows else dealt.mapInArrow(name, _GROUP)


def group_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (least id), group_size."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return _groups(rows, 0, 1, memory, whole_rows=False)


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256."""

    @tb.lean
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas = [hashlib.sha256(x).hexdigest() for x in normalise(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.string())], ["doc_id", "text_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(names, "doc_id long, text_sha256 string")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that agree in id and text are counted together before the join and
    given back afterwards; the first of them stays when their id does.
    """
    rows = membership(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    found = rows.join(group_table(docs, id_col, text_col, memory), "text_sha256")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of docs that stay, with their own columns and texts.

    The row's other columns travel with its text as one payload, so the texts
    are shuffled once and no join follows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    fields = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields)])
    plain = docs.toDF(*names).to(fields)
    return _groups(plain, docs.columns.index(id_col), docs.columns.index(text_col), memory, whole_rows=True).toDF(*docs.columns)
