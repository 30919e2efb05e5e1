"""Stupid-backoff scores of every document under the rest of the corpus.

S(w | context) = f(context w) / f(context) if f(context w) > 0, else
``ALPHA`` * S(w | shorter context); for single words f(w) / N, an unseen word
counting as seen once. All counts are those of the whole corpus without the
document's own (leave one out), so a document does not vouch for itself.

The n-grams meet their counts in a join on hash, in packed form:

1. Documents are dealt into chunks of about ``CHUNK`` bytes by the hash of id and
   text; a task sends what it has for a chunk as one compressed block.
2. Each chunk sends its distinct n-grams of each order (hashes, sorted, with
   counts), cut into at most ``RANGES`` ranges of hashes. A word or n-gram that is
   everywhere leaves each chunk once, and a chunk sends no more messages in a larger corpus.
3. The task of a range adds the counts of all chunks (this is the count table's
   partition), about ``BUCKET`` n-grams at a time, and joins the sums back to every
   chunk's n-grams.
4. Each chunk, joined with the counts of its n-grams, scores its tokens; the
   scores are summed per document.

What is shuffled is the compressed texts once and about six bytes for each distinct n-gram of
a chunk, and a byte or less for each count on its way back. Messages grow with the
chunks, and so with the input. A range holds BUCKET n-grams up to about 8 thousand
million tokens; beyond, its share of all n-grams, some nine bytes each (by
arithmetic 0.4 GB at 1 TB of text).

Defined cases: null and empty texts have 0 tokens and a null mean; rows with a
null id are dealt by their text and keep their null id; rows that repeat an id or
a text are documents of their own; very long texts are scored whole, in a chunk
that may be larger for them; an empty table gives an empty result; further columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textblocks as tb

ORDER, ALPHA = 3, 0.4
CHUNK, BUCKET, RANGES = 8 << 20, 2_000_000, 4096
#: Bytes of texts that a task holds before it sends them to their chunks.
HELD = 16 << 20
#: Nothing compares contents, so n-grams of equal hashes would add their counts; fewer bits save disk but make wrong scores.
HASH_BITS = 64
_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by byte planes, compressed; planes of zeros cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(_U)


def pack_sorted(values: np.ndarray) -> bytes:
    steps = values.copy()
    steps[1:] -= values[:-1]
    return pack(steps)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=_U)


def grams(data: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that begin at each token, for n = 1 .. order, and each text's first token.

    A hash whose n-gram would reach into the next text is meaningless and never read.
    """
    starts, ends, first = tb.words(data, offsets)
    h = tb.hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
    rolled = [h] + [np.concatenate([tb.roll(h, n), np.zeros(min(n - 1, len(h)), _U)]) for n in range(2, order + 1)]
    return [x >> _U(64 - bits) for x in rolled], first


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which tokens begin an n-gram within their text."""
    total = int(first[-1])
    out = np.ones(total, dtype=bool)
    for k in range(1, n):
        at = first[1:] - k
        out[at[at >= first[:-1]]] = False
    return out


def pack_rows(ids: list[int | None], texts: list[bytes | None]) -> bytes:
    """Ids and texts as one compressed block; null text counts as empty."""
    texts = [t or b"" for t in texts]
    head = np.array([len(ids), *(i or 0 for i in ids), *(i is None for i in ids), *map(len, texts)], dtype=np.int64)
    return zstandard.ZstdCompressor(level=9).compress(head.tobytes() + b"".join(texts))


def unpack_rows(blocks: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of the texts of several blocks."""
    ids, nulls, sizes, data = [], [], [], []
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 3 * n, 8)
        ids.append(head[:n])
        nulls.append(head[n : 2 * n])
        sizes.append(head[2 * n :])
        data.append(np.frombuffer(raw, np.uint8, offset=8 + 24 * n))
    none = [np.zeros(0, np.int64)]
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes or none)))).astype(np.int64)
    return pa.array(np.concatenate(ids or none), pa.int64(), mask=np.concatenate(nulls or none).astype(bool)), np.concatenate(data or [np.zeros(0, np.uint8)]), offsets


def _cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where the buckets' hash ranges begin in sorted hashes."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], dtype=_U)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def _own_counts(ids: np.ndarray, text_of: np.ndarray, kinds: int) -> np.ndarray:
    """How often each token's n-gram occurs in the token's own text."""
    key = text_of * max(kinds, 1) + ids
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[back]


def score_texts(data: np.ndarray, offsets: np.ndarray, lookup, total: int, order: int = ORDER, alpha: float = ALPHA, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log S of each text. lookup(n, sorted distinct hashes): their counts in the corpus."""
    hashes, first = grams(data, offsets, order, bits)
    tokens = np.diff(first)
    text_of = np.repeat(np.arange(len(tokens)), tokens)
    counts = []  # counts[n - 1][i]: of the n-gram that begins at token i, without the own text's
    for n in range(1, order + 1):
        fits = whole(first, n)
        kinds, back = np.unique(hashes[n - 1][fits], return_inverse=True)
        found = lookup(n, kinds).astype(np.int64)
        c = np.zeros(len(text_of), dtype=np.int64)
        c[fits] = found[back] - _own_counts(back, text_of[fits], len(kinds))
        counts.append(c)
    rest = np.maximum(total - tokens[text_of], 1)
    out = np.log(np.maximum(counts[0], 1) / rest)
    place = np.arange(len(text_of)) - first[:-1][text_of] if len(text_of) else np.zeros(0, np.int64)
    for n in range(2, order + 1):  # from short contexts to long ones; an n-gram ends at the token
        end = np.flatnonzero(place >= n - 1)
        start = end - (n - 1)
        c, context = counts[n - 1][start], counts[n - 2][start]
        out[end] = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(context, 1)), out[end] + np.log(alpha))
    sums = np.concatenate(([0.0], np.cumsum(out)))
    return tokens, sums[first[1:]] - sums[first[:-1]] if len(tokens) < 2 else np.array([out[a:b].sum() for a, b in zip(first[:-1], first[1:])])


def _totals(rows: DataFrame) -> tuple[int, int]:
    @tb.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokens = 0
        for b in batches:
            data, offsets = tb.column(b.column(0))
            for _, _, block, at in tb.blocks(data, offsets):
                size += len(block)
                tokens += len(tb.words(block, at)[0])
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([tokens])], ["bytes", "tokens"])

    row = rows.select("text").mapInArrow(count, "bytes long, tokens long").agg(F.sum("bytes"), F.sum("tokens")).first()
    return row[0] or 0, row[1] or 0


def _dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """chunk, block: the rows (id, text) of each chunk in compressed blocks."""
    chunk_of = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id", "text")), F.lit(chunks))

    @tb.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def blocks() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pack_rows(*x) for x in held.values()], pa.binary())], ["chunk", "block"])

        for b in batches:
            for key, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                ids, texts = held.setdefault(key, ([], []))
                ids.append(i)
                texts.append(text)
                size += 100 + len(text or b"")
                if size > HELD:
                    yield blocks()
                    held, size = {}, 0
        yield blocks()

    return rows.select(chunk_of.alias("chunk"), "id", "text").mapInArrow(deal, "chunk long, block binary")


def _asked(dealt: DataFrame, buckets: int, order: int = ORDER, bits: int = HASH_BITS) -> DataFrame:
    """part (order and hash range), chunk, grams, times: what each chunk sends, at most ``order`` x ``buckets`` rows."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, data, offsets = unpack_rows(table.column("block").to_pylist())
        hashes, first = grams(data, offsets, order, bits)
        out: list[tuple] = []
        for n in range(1, order + 1):
            kinds, times = np.unique(hashes[n - 1][whole(first, n)], return_counts=True)
            cuts = _cuts(kinds, buckets, bits)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                out.append((n * buckets + k, key[0].as_py(), pack_sorted(kinds[a:b]), pack(times[a:b].astype(_U))))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "grams", "times"])

    return dealt.groupBy("chunk").applyInArrow(ask, "part long, chunk long, grams binary, times binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, chunk: int = CHUNK, bucket: int = BUCKET, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score (sum of ln S) and mean_log_score."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    tb.small_batches(docs.sparkSession)
    size, total = _totals(rows)
    buckets = max(1, min(ranges, -(-total // bucket)))
    bits = HASH_BITS
    dealt = _dealt(rows, max(1, -(-size // chunk)))

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        blocks = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        times = [(t := unpack(x)).astype(np.min_scalar_type(int(t.max()))) for x in table.column("times").to_pylist()]
        lo, hi = (((key[0].as_py() % buckets + k) << bits) // buckets for k in (0, 1))
        pieces = max(1, -(-sum(map(len, blocks)) // bucket))
        edges = np.array([lo + (hi - lo) * k // pieces for k in range(1, pieces)], dtype=_U)
        cuts = [np.concatenate(([0], np.searchsorted(b, edges), [len(b)])) for b in blocks]
        found: list[list[np.ndarray]] = [[] for _ in blocks]
        for k in range(pieces):
            mine = [b[c[k] : c[k + 1]] for b, c in zip(blocks, cuts)]
            kinds, back = np.unique(np.concatenate(mine), return_inverse=True)
            sums = np.zeros(len(kinds), dtype=np.int64)
            np.add.at(sums, back, np.concatenate([t[c[k] : c[k + 1]] for t, c in zip(times, cuts)]).astype(np.int64))
            del back
            sums = sums.astype(np.min_scalar_type(int(sums.max(initial=0))))
            for out, b in zip(found, mine):
                out.append(sums[np.searchsorted(kinds, b)])
        packed = [pack(np.concatenate(x).astype(_U)) for x in found]
        return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "counts": pa.array(packed, pa.binary())})

    def finish(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids, data, offsets = unpack_rows(texts.column("block").to_pylist())
        parts = dict(zip(counts.column("part").to_pylist(), counts.column("counts").to_pylist()))

        def lookup(n: int, kinds: np.ndarray) -> np.ndarray:
            found = [unpack(parts[n * buckets + k]) for k in range(buckets) if n * buckets + k in parts]
            return np.concatenate(found) if found else np.zeros(0, _U)

        tokens, sums = score_texts(data, offsets, lookup, total, order, alpha, bits)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(tokens, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    answered = _asked(dealt, buckets, order, bits).groupBy("part").applyInArrow(answer, "part long, chunk long, counts binary")
    scored = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
