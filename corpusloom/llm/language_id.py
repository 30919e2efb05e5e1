"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: slot i holds one bit for each
language, so the AND of the slots that an n-gram hashes to gives, in one probe,
the set of all languages whose filter contains it. For each text the bits are
counted by language, the counts are corrected for the false-positive rate of
that language's filter, and the largest corrected count decides.

Learning: at most ``per_language`` labelled rows of each language, those with
the smallest hashes of their ids. n-gram counts of these rows are made on the
executors; an n-gram enters a language's filter if it is frequent there and not
much more frequent elsewhere; at most ``grams`` of each language reach the
driver. So the model's size is bounded by the two parameters times the number of
languages. Predictions read whole texts.

Defined cases: null text or text without any letter gives ``und`` and score 0;
a tie goes to the language that sorts first; no labelled rows at all (also an
empty table to learn from) gives ``und`` everywhere; null ids are never trained
on; rows that repeat are learned from once and each get a prediction; a text
without any known n-gram gets the language that sorts first and score 0; very
long texts count whole; an empty table gives an empty result; further columns may
have any names, also lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm import textblocks as tb
from corpusloom.plans.session import cut, small

#: Labelled rows of each language that a model is fitted on, and n-grams of each language that it keeps.
PER_LANGUAGE, GRAMS = 600, 40_000
#: Parts of a language's rows that are ranked apart at first.
PARTS = 16
#: Bytes of an n-gram.
SIZES = (3, 4, 5)
#: Fewest occurrences of an n-gram, and least share of its highest rate in any language.
LEAST, SHARE = 4, 0.5
#: Probes of the filter and log2 of its slots for each kept n-gram (at least 2 ** 20 slots in all).
PROBES, SLOT_BITS = 3, 4
#: Least score of a text that keep_known(..., least=SUPPORT) leaves. Of the documents of sf0.1
#: and check_s none that has n-grams is below 0.36; gibberish, other scripts and sentences in Finnish, Polish and
#: Turkish are below 0.14.
SUPPORT = 0.15
UNKNOWN = "und"

_FOLD = tb.LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_U = np.uint64


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters; every run of other ASCII becomes one space. Beyond ASCII only Latin-1 is lower-cased."""
    out = _FOLD[data]
    if len(out) > 1:
        after = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][after] += 0x20
    return tb.squeeze(out, offsets)


def codes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts of a block as numbers, and where each text's begin (one more at the end)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    code = np.full(n, size, dtype=_U)
    for k in range(size):
        code <<= _U(8)
        code |= data[k : k + n].astype(_U)
    valid = np.ones(n, dtype=bool)
    for k in range(1, size):  # those that reach into the next text
        at = offsets[1:-1] - k
        valid[at[(at >= 0) & (at < n)]] = False
    short = offsets[1:] - offsets[:-1] < size
    for a, b in zip(offsets[:-1][short].tolist(), offsets[1:][short].tolist()):
        valid[a:b] = False
    before = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(valid, out=before[1:])
    return code[valid], before[np.minimum(offsets, n)]


@dataclass
class Filters:
    languages: list[str]
    slots: list[np.ndarray]  # one array for each 64 languages
    false: np.ndarray  # false-positive rate of each language

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams)
        most = max((len(x) for x in grams.values()), default=1)
        n = 1 << max(20, int(most).bit_length() + SLOT_BITS)
        slots = []
        for first in range(0, max(1, len(languages)), 64):
            part = languages[first : first + 64]
            kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(part) <= bits)
            table = np.zeros(n, dtype=kind)
            for bit, language in enumerate(part):
                for at in probes(grams[language], n):
                    table[at] |= kind(1 << bit)
            slots.append(table)
        fill = [float(np.mean((slots[k // 64] >> slots[k // 64].dtype.type(k % 64)) & slots[k // 64].dtype.type(1))) for k in range(len(languages))]
        return cls(languages, slots, np.array(fill) ** PROBES)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) n-grams found, and the n-grams of each text."""
        texts = len(offsets) - 1
        found, total = np.zeros((texts, len(self.languages)), dtype=np.int64), np.zeros(texts, dtype=np.int64)
        for size in SIZES:
            code, starts = codes(data, offsets, size)
            total += np.diff(starts)
            places = probes(code, len(self.slots[0]))
            for k, table in enumerate(self.slots):
                mask = table[places[0]]
                for at in places[1:]:
                    mask &= table[at]
                for bit in range(min(64, len(self.languages) - 64 * k)):
                    ones = np.zeros(len(mask) + 1, dtype=np.int64)
                    np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), out=ones[1:], dtype=np.int64)
                    found[:, 64 * k + bit] += ones[starts[1:]] - ones[starts[:-1]]
        return found, total


def probes(code: np.ndarray, n: int) -> list[np.ndarray]:
    h = tb.mix(code)
    step, bits = (h >> _U(40)) | _U(1), _U(n - 1)
    return [((h + step * _U(k)) & bits).astype(np.int64) for k in range(PROBES)]


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | np.uint8(32)
    ones = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=ones[1:])
    has = ones[offsets[1:]] > ones[offsets[:-1]]
    for k in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])).tolist():
        has[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return has


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> Filters:
    """Filters learned from labelled rows."""
    tb.small_batches(rows.sparkSession)
    usable = rows.where(rows[lang_col].isNotNull() & rows[text_col].isNotNull() & rows[id_col].isNotNull())
    named = usable.select(usable[id_col].alias("id"), usable[lang_col].cast("string").alias("lang"), usable[text_col].cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    known = named.select("id", "lang", "print").distinct().withColumn("h", F.xxhash64("id"))
    # the first of each part of a language are ranked against each other, so no task meets more than PARTS * per_language rows
    order = ["h", "id", "print"]
    first = known.withColumn("k", F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy(*order))).where(F.col("k") <= per_language)
    chosen = first.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("k") <= per_language).select("id", "lang", "print")
    # rows that repeat in all three count once
    picked = named.join(small(cut(chosen)), ["id", "lang", "print"]).groupBy("id", "lang", "print").agg(F.first("text").alias("text"))

    @tb.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            data, offsets = tb.column(b.column(1))
            for lo, hi, block, at in tb.blocks(data, offsets):
                block, at = fold(block, at)
                for lang in sorted(set(langs[lo:hi])):
                    mine = np.flatnonzero(langs[lo:hi] == lang)
                    for size in SIZES:
                        code, starts = codes(block, at, size)
                        take = np.concatenate([code[starts[k] : starts[k + 1]] for k in mine])
                        values, times = np.unique(take, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["lang", "code", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counted.where(F.col("n") >= LEAST).join(small(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(W.partitionBy("code"))
    kept = rate.withColumn("best", best).where(F.col("rate") >= SHARE * F.col("best"))
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("rate"), "code"))
    rows_out = kept.withColumn("k", order).where(F.col("k") <= grams).select("lang", "code").toPandas()  # at most `grams` of each language
    return Filters.build({str(lang): part["code"].to_numpy(dtype=np.int64).view(_U) for lang, part in rows_out.groupby("lang")})


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as it is), lang_pred and score of each row."""
    return _apply(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), filters, ["id"])


def annotate(docs: DataFrame, filters: Filters, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """All columns of docs and two more, by position: lang_pred and score. A text with n-grams and a score under ``least`` gets ``und``."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    return _apply(plain, filters, plain.columns, at, least)


def _apply(rows: DataFrame, filters: Filters, keep: list[str], at: int = -1, least: float = 0.0) -> DataFrame:
    tb.small_batches(rows.sparkSession)
    at = at if at >= 0 else rows.columns.index("text")
    kept = [rows.columns.index(c) for c in keep]
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for b in batches:
            data, offsets = tb.column(b.column(at))
            chosen, scores = [], []
            for _, _, block, cuts in tb.blocks(data, offsets):
                has = _letters(block, cuts)
                if not model.languages:
                    chosen.append(np.full(len(has), UNKNOWN, dtype=object))
                    scores.append(np.zeros(len(has)))
                    continue
                found, total = model.counts(*fold(block, cuts))
                true = np.maximum((found - total[:, None] * model.false) / (1 - model.false), 0)
                best = true.argmax(axis=1)
                score = np.clip(true.max(axis=1) / np.maximum(total, 1), 0, 1)
                known = has & ((total == 0) | (score >= least))  # a text too short for any n-gram says nothing against a language
                chosen.append(names[np.where(known, best, len(model.languages))])
                scores.append(np.where(has, score, 0.0))
            langs = pa.array(np.concatenate(chosen) if chosen else [], pa.string())
            score = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), langs, score], [*keep, "lang_pred", "score"])

    fields = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, fields)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def split_predict(docs: DataFrame, **fit_options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    filters = fit(docs.where(~held_out(docs["doc_id"])), **fit_options)
    return predict(docs, filters).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, text_col: str = "text", least: float = 0.0, **fit_options) -> DataFrame:
    """docs without the rows whose language cannot be told (null text, no letter in it, or n-grams that the filters support less than ``least``)."""
    filters = fit(docs.where(~held_out(docs["doc_id"])), **fit_options)
    out = annotate(docs, filters, text_col, least)
    return out.where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score").toDF(*docs.columns)
