"""SentencePiece encoding and decoding with a weighted finite-state transducer.

``Transducer`` compiles a model file into
  * a normaliser (dummy prefix, white space escaped as U+2581, optional removal
    of extra white space; only the identity character map is known),
  * a lexicon of pieces, as a prefix automaton,
  * byte fallback: a character outside the lexicon gives its UTF-8 bytes' pieces.
A text's chain automaton is composed with these position by position, and the
shortest path in the tropical semiring (min, +) is the segmentation.

Weights. Unigram models: an arc costs minus the piece's score, and the costs of a
text's nodes are relaxed in order of position. BPE models: the states of the
lexicon also remember the last piece, and the arc from piece a to piece b costs 0
if merging the text of a and b by the model's merge order gives exactly a, b, and
infinity otherwise. A segmentation is the one that BPE makes if and only if all
its neighbours are such pairs, so just one path is finite. As no finite arc costs
more than another, the queue of the best-first search is a stack there: the
composition is expanded lazily, longest pieces first, and the first path that
reaches the end is the shortest. The pair arcs are compiled as they are met and
memoised.

No path crosses a border between two characters that are neighbours in no
piece. CUTS lists ways to cut texts at borders between kinds of characters; the
finest one that cuts no piece of the lexicon is compiled in, texts are composed
run by run, and frequent runs are memoised in a table of bounded size.

Defined cases: null text gives null ids; empty text gives no ids; U+2581 in a
text is white space after decoding; malformed UTF-8 counts as U+FFFD; a very long
text is encoded whole; rows are independent of each other, so null ids and rows
that repeat keep their places; an empty table gives an empty result; further
columns may have any names, also that of the output.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import textblocks as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Memoised runs of text (in two generations) and pairs of pieces (emptied when full).
RUNS, PAIRS, LONGEST_RUN = 300_000, 200_000, 48

_LATIN = "A-Za-z\u00c0-\u024f"
#: The finest first. The last one doesn't cut.
CUTS = [
    re.compile(f"{MARK}*[{_LATIN}]+|[0-9]|{MARK}*[^{_LATIN}0-9{MARK}]+|{MARK}+"),
    re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{_LATIN}{MARK}]+|{MARK}+"),
    re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"),
    re.compile(".+", re.S),
]

#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Transducer:
    def __init__(self, raw: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        kind, fallback, charsmap = UNIGRAM, False, b""
        self.dummy_prefix, self.squeeze_space, self.escape, self.suffix = True, True, True, False
        for field, value in _fields(raw):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, NORMAL)))
            elif field == 2:
                part = dict(_fields(value))
                kind, fallback, self.suffix = part.get(3, UNIGRAM), bool(part.get(35, 0)), bool(part.get(24, 0))
            elif field == 3:
                part = dict(_fields(value))
                charsmap = part.get(2, b"")
                self.dummy_prefix, self.squeeze_space, self.escape = bool(part.get(3, 1)), bool(part.get(4, 1)), bool(part.get(5, 1))
        if charsmap or self.suffix or kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for _, _, t in pieces):
            raise NotImplementedError("only unigram and BPE models with the identity character map and without user-defined pieces")
        self.bpe = kind == BPE
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        by_byte = {int(p[3:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if fallback and len(by_byte) == 256 else None
        self.penalty = 10.0 - min(self.score.values(), default=0.0)
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.cut = next(r for r in CUTS if all(r.findall(p) == [p] for p in self.id))
        self.surface = [b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else bytes([int(p[3:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.byte_ids = np.zeros(len(pieces), dtype=bool)
        self.byte_ids[list(by_byte.values())] = True
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.timelines: dict[str, tuple | None] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze_space:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def _merging(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How the characters of a piece merge by the model's order (best score first, leftmost first).

        Gives the score of each step and the first and last part before each step
        and at the end; None if the characters do not merge into the piece.
        """
        parts, score = list(piece), self.score
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return scores, firsts, lasts

    def _timeline(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        if piece not in self.timelines:
            if len(self.timelines) >= PAIRS:
                self.timelines.clear()
            self.timelines[piece] = self._merging(piece)
        return self.timelines[piece]

    def joins(self, a: str, b: str) -> bool:
        """Whether the arc from piece a to piece b has a finite weight; '' is the start.

        The merges inside a and inside b are walked in the order in which they
        would happen side by side; the arc is infinite if the parts at the border
        would merge before that has ended. Equal scores: the leftmost goes first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: str, b: str) -> bool:
        right = self._timeline(b)
        left = self._timeline(a) if a else None
        if right is None or a and left is None:
            return False
        if not a:
            return True
        i = j = 0
        while True:
            cross = self.score.get(left[2][i] + right[1][j])
            of_a = left[0][i] if i < len(left[0]) else None
            of_b = right[0][j] if j < len(right[0]) else None
            if cross is not None and (of_a is None or cross > of_a) and (of_b is None or cross >= of_b):
                return False
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a >= of_b:
                i += 1
            else:
                j += 1

    def segment(self, run: str) -> list[str]:
        """Shortest path of the composition of a run with lexicon and weights."""
        return self._by_pairs(run) if self.bpe else self._by_scores(run)

    def _ahead(self, run: str, i: int) -> list[str]:
        """Pieces that the lexicon accepts from position i, the longest last; a single character always."""
        out, known, prefixes = [run[i]], self.id, self.prefixes
        for j in range(i + 2, len(run) + 1):
            piece = run[i:j]
            if piece in known:
                out.append(piece)
            elif piece not in prefixes:
                break
        return out

    def _by_pairs(self, run: str) -> list[str]:
        """All finite paths cost 0, so the first one that reaches the end is the shortest. Each state is left as dead once at most."""
        if run in self.id and self.joins("", run):
            return [run]
        n, i, last, path, dead, pairs = len(run), 0, "", [], set(), self.pairs
        ahead = [self._ahead(run, 0)]
        while i < n:
            open_arcs = ahead[-1]
            while open_arcs:
                piece = open_arcs.pop()
                ok = pairs.get((last, piece))
                if (self.joins(last, piece) if ok is None else ok) and (i + len(piece), piece) not in dead:
                    path.append(piece)
                    i, last = i + len(piece), piece
                    ahead.append(self._ahead(run, i) if i < n else [])
                    break
            else:
                dead.add((i, last))
                ahead.pop()
                i -= len(path.pop())
                last = path[-1] if path else ""
        return path

    def _by_scores(self, run: str) -> list[str]:
        n, score, prefixes = len(run), self.score, self.prefixes
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for i in range(n):
            j, whole = i + 1, False
            while j <= n and (piece := run[i:j]) in prefixes:
                s = score.get(piece)
                if s is not None and cost[i] - s < cost[j]:
                    cost[j], back[j] = cost[i] - s, i
                whole |= j == i + 1 and s is not None
                j += 1
            if not whole and cost[i] + self.penalty < cost[i + 1]:
                cost[i + 1], back[i + 1] = cost[i] + self.penalty, i
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]

    def _run_ids(self, run: str) -> bytes:
        ids, known = array("i"), self.id
        for piece in self.segment(run):
            k = known.get(piece)
            if k is not None:
                ids.append(k)
            elif self.bytes:
                ids.extend([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")])
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _remembered(self, run: str) -> bytes:
        """Ids of a run that the newer generation of the table doesn't have."""
        ids = self.runs.get(run)  # met twice in one text
        if ids is None:
            ids = self.old_runs.get(run)
            if ids is None:
                ids = self._run_ids(run)
            if len(run) <= LONGEST_RUN:
                if len(self.runs) >= RUNS // 2:  # what has not been met since the last turn is forgotten
                    self.old_runs, self.runs = self.runs, {}
                self.runs[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        runs = self.cut.findall(self.normalise(text))
        found = list(map(self.runs.get, runs))
        if None in found:
            found = [self._remembered(run) if ids is None else ids for run, ids in zip(runs, found)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_compiled: dict[bytes, Transducer] = {}


def compiled(raw: bytes) -> Transducer:
    key = hashlib.sha256(raw).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(raw)
    return _compiled[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _strings(col: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """The kept columns (all by default) and the ids of the text, array<int>."""
    names = docs.columns if keep is None else keep
    at = [docs.columns.index(c) for c in [text_col, *names]]
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).select(*[f"c{k}" for k in dict.fromkeys(at)])
    where = [list(dict.fromkeys(at)).index(k) for k in at]
    fields = T.StructType([T.StructField(f"k{k}", docs.schema[docs.columns.index(c)].dataType, True) for k, c in enumerate(names)] + [T.StructField("ids", T.ArrayType(T.IntegerType()), True)])

    tb.small_batches(docs.sparkSession)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [None if t is None else transducer.encode(t) for t in _strings(part.column(where[0]))]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x or b"") // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), dtype=np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in where[1:]), lists], fields.names)

    return rows.mapInArrow(run, fields).toDF(*names, out)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """The kept columns (all by default) and the text of the ids."""
    names = rows.columns if keep is None else keep
    at = [rows.columns.index(c) for c in [ids_col, *names]]
    fields = T.StructType([T.StructField(f"k{k}", rows.schema[rows.columns.index(c)].dataType, True) for k, c in enumerate(names)] + [T.StructField("text", T.StringType(), True)])

    tb.small_batches(rows.sparkSession)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [None if x is None else transducer.decode(x) for x in part.column(at[0]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at[1:]), pa.array(texts, pa.string())], fields.names)

    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).mapInArrow(run, fields).toDF(*names, out)


def report(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, digests in place of ids: doc_id, n_tokens, n_byte_pieces, ids_sha256, round_trip.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip tells
    whether decoding gives the text back (U+2581 counts as a space). Encoding and
    decoding are done in one pass, so neither ids nor decoded texts leave the task.
    """

    tb.small_batches(docs.sparkSession)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for b in batches:
            rows = []
            for t in _strings(b.column(1)):
                if t is None:
                    rows.append((None, None, None, None))
                    continue
                raw = transducer.encode(t)
                ids = np.frombuffer(raw, dtype=np.int32)
                back = transducer.decode(ids.tolist())
                rows.append((len(ids), int(transducer.byte_ids[ids].sum()), hashlib.sha256(raw).hexdigest(), back == t.replace(MARK, " ")))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["doc_id", "n_tokens", "n_byte_pieces", "ids_sha256", "round_trip"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_byte_pieces long, ids_sha256 string, round_trip boolean")


def tokenised(docs: DataFrame, model: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens and ids; null text gives null in both."""
    from pyspark.sql import functions as F

    out = encode(docs, model, text_col, keep)
    return out.select(*keep, F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "ids")
