"""Toxicity scores that do not hang on which group a text mentions.

Features: the words of a text (lower-cased runs of letters), the beginnings of
4 to 8 bytes of longer words, and each of them again for 2, 4 and 8 or more
occurrences. A feature is one 64-bit number: the hash of the word or beginning
with the level of its count in the two lowest bits.

Learning: a logistic regression over the features whose link with the label is
strongest. Sentences of labelled texts that hold an identity term are written
again with other terms of the same group and with the group's neutral word; the
square of the score's change between the two sentences is a penalty of the fit.
So what labels happen to say about texts that mention a group moves to the words
that are toxic whichever group is meant, and neutral mentions stay low.

Bounds: fitted on at most about ``toxic_rows`` and ``other_rows`` labelled
documents, those with the smallest hashes of their ids (the intercept is
corrected for the two shares), of whose features at most ``candidates`` are
compared and ``features`` kept. Feature counts and vectors are made on the
executors; what reaches the driver and is broadcast is bounded by these four
parameters. Scores read every whole text.

Defined cases: null text counts as empty and gets the score of a text without
known features; null ids, null labels and null texts are never learned from; an id that is labelled
both ways counts as toxic; equal texts under one label are learned once, and each of the
rows gets a score; where no toxic or no other row is labelled (also an empty table
of labels), every score is 0; very long texts count whole; an empty table gives
an empty result; further columns may have any names, also score and predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textblocks as tb
from corpusloom.llm.language_id import fold, held_out
from corpusloom.plans.session import cut, small

#: Labelled documents a model is fitted on, features that are compared, and features that are kept.
TOXIC_ROWS, OTHER_ROWS, CANDIDATES, FEATURES = 4096, 8192, 1 << 18, 1024
#: Bytes of the beginnings of words; least occurrences that levels stand for.
BEGINNINGS, LEVELS = (4, 5, 6, 7, 8), (1, 2, 4, 8)
#: Fewest toxic texts of a feature, and least log-likelihood ratio.
LEAST, LEAST_RATIO = 3, 8.0
#: Weights of the squares of weights and of score changes under a swap; score from which a text is predicted toxic.
RIDGE, COUNTERFACTUAL, THRESHOLD = 0.2, 8.0, 0.3

#: A group's neutral word, then its identity terms.
IDENTITIES = [
    ["people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    ["people", "africans", "asians", "europeans", "americans", "mexicans", "arabs", "indians", "chinese", "immigrants", "refugees"],
    ["person", "african", "asian", "european", "american", "mexican", "arab", "indian", "immigrant", "refugee"],
    ["people", "women", "men", "girls", "boys", "gays", "lesbians"],
    ["person", "woman", "man", "girl", "boy"],
    ["some", "gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"],
    ["some", "black", "white", "brown", "latino", "hispanic"],
    ["some", "deaf", "blind", "disabled", "autistic", "elderly", "young"],
    ["menschen", "muslime", "christen", "juden", "frauen", "männer", "ausländer", "deutsche", "türken", "flüchtlinge"],
    ["gens", "musulmans", "chrétiens", "juifs", "femmes", "hommes", "étrangers", "arabes", "français", "réfugiés"],
    ["gente", "musulmanes", "cristianos", "judíos", "mujeres", "hombres", "extranjeros", "gitanos", "españoles", "refugiados"],
]

_U = np.uint64
_LOW = _U(3)
_SENTENCE = re.compile(r"[.!?\n]+")


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word or beginning) of every occurrence in a block of folded texts; the two lowest bits are 0."""
    starts, ends, first = tb.words(data, offsets)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, texts = [tb.hashes(data, starts, ends)], [owner]
    for size in BEGINNINGS:
        longer = ends - starts > size
        hashes.append(tb.mix(tb.hashes(data, starts[longer], starts[longer] + size) + _U(size)))
        texts.append(owner[longer])
    return np.concatenate(texts), np.concatenate(hashes) & ~_LOW


def counted(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash and number of occurrences, sorted by text."""
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), dtype=bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return texts[at], hashes[at], np.diff(np.append(at, len(texts)))


def leveled(texts: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), one for each level that a count reaches."""
    reached = [times >= least for least in LEVELS]
    return np.concatenate([texts[r] for r in reached]), np.concatenate([hashes[r] | _U(k) for k, r in enumerate(reached)])


@dataclass
class Vocabulary:
    features: np.ndarray  # sorted

    def __post_init__(self) -> None:
        self.bases = np.unique(self.features & ~_LOW)
        self.sieve = np.zeros(1 << max(16, len(self.bases).bit_length() + 6), dtype=bool)
        self.sieve[self._places(self.bases)] = True

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _U(2)) & _U(len(self.sieve) - 1)).astype(np.int64)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the feature) for each known feature of each text of a folded block."""
        texts, hashes = occurrences(data, offsets)
        may = self.sieve[self._places(hashes)]
        texts, hashes = leveled(*counted(texts[may], hashes[may]))
        if not len(self.features):
            return texts[:0], texts[:0]
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        known = self.features[at] == hashes
        return texts[known], at[known]


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray  # of the features, and at the end the intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts, at = self.vocabulary.found(*fold(data, offsets))
        z = np.bincount(texts, self.weights[at], len(offsets) - 1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def swaps(text: str, identities: list[list[str]]) -> Iterator[tuple[str, str]]:
    """Sentences of a text that hold an identity term, each with the sentence that has its terms exchanged.

    A term gives way to the next two of its group and to the group's neutral word;
    all terms of a group in the sentence move on by the same number of places.
    """
    for sentence in _SENTENCE.split(text):
        for neutral, *terms in identities:
            number = {term: k for k, term in enumerate(terms)}
            word = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, terms)) + r")(?!\w)", re.IGNORECASE)
            if word.search(sentence):
                for step in {1, 2} & set(range(1, len(terms))):
                    yield sentence, word.sub(lambda m: terms[(number[m[0].lower()] + step) % len(terms)], sentence)
                yield sentence, word.sub(neutral, sentence)


def _solve(rows: list[tuple[int, list[int], int]], pairs: list[tuple[list[int], list[int], int]], size: int, ridge: float, counterfactual: float) -> np.ndarray:
    """Weights by Newton's method. rows: label, features, times; pairs: features before and after a swap, times."""
    X, y, times = np.zeros((len(rows), size + 1), dtype=np.float32), np.array([r[0] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)
    X[:, -1] = 1
    for k, (_, features, _) in enumerate(rows):
        X[k, features] = 1
    fixed = np.diag(np.append(np.full(size, ridge), 1e-6))
    for before, after, n in pairs:
        change = np.zeros(size + 1)
        change[before] += 1
        change[after] -= 1
        moved = np.flatnonzero(change)
        fixed[np.ix_(moved, moved)] += counterfactual * n * np.outer(change[moved], change[moved])
    w = np.zeros(size + 1)
    share = (times * y).sum() / times.sum()
    w[-1] = np.log(share / (1 - share))

    def loss(w: np.ndarray) -> float:
        z = X @ w
        return float((times * (np.logaddexp(0, z) - y * z)).sum() + w @ fixed @ w / 2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        slope = X.T @ (times * (p - y)) + fixed @ w
        curve = (X * (times * p * (1 - p))[:, None].astype(np.float32)).T @ X + fixed
        step = np.linalg.solve(curve, slope)
        far = 1.0
        while (then := loss(w - far * step)) > now and far > 1e-6:
            far /= 2
        w, gain, now = w - far * step, now - then, then
        if gain < 1e-6:
            break
    return w


def _ratio(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-likelihood ratio of a feature and the label; negative where the feature speaks against it."""

    def part(seen: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(share * n, 1e-300)), 0)

    share = (toxic + other) / (n_toxic + n_other)
    both = part(toxic, share, n_toxic) + part(other, share, n_other) + part(n_toxic - toxic, 1 - share, n_toxic) + part(n_other - other, 1 - share, n_other)
    return np.where(toxic * n_other > other * n_toxic, 2 * both, -1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS,
        candidates: int = CANDIDATES, features: int = FEATURES, counterfactual: float = COUNTERFACTUAL, identities: list[list[str]] = IDENTITIES) -> Classifier | None:
    """A classifier learned from the labelled rows of docs; None where one of the two labels is missing."""
    tb.small_batches(docs.sparkSession)
    marked = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).select(labels[id_col].alias("id"), (labels[label_col] != 0).alias("toxic"))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {kind: min(1.0, most / max(have.get(kind, 0), 1)) for kind, most in ((True, toxic_rows), (False, other_rows))}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    sample = cut(marked.where(place < F.when(F.col("toxic"), shares[True]).otherwise(shares[False])))
    named = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    labelled = named.join(small(sample), "id").select("toxic", "text").withColumn("print", F.sha2("text", 256))
    labelled = cut(labelled.groupBy("print", "toxic").agg(F.first("text").alias("text")).select("toxic", "text"))
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None

    def count(among: np.ndarray | None):
        @tb.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, block, at in tb.blocks(*tb.column(b.column(0))):
                    seen = leveled(*counted(*occurrences(*fold(block, at))))[1]
                    if among is not None:
                        seen = seen[np.isin(seen, among)]
                    values, times = np.unique(seen, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["feature", "n"])

        return run

    def counts(kind: bool, among: np.ndarray | None) -> DataFrame:
        texts = labelled.where(F.col("toxic") == kind).select("text")
        return texts.mapInArrow(count(among), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    first = counts(True, None).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "feature").limit(candidates).toArrow()  # bounded by `candidates`
    known, seen = first.column("feature").to_numpy().view(_U), first.column("n").to_numpy()
    order = np.argsort(known)
    known, seen = known[order], seen[order]
    second, elsewhere = counts(False, known).toArrow(), np.zeros(len(known), dtype=np.int64)
    elsewhere[np.searchsorted(known, second.column("feature").to_numpy().view(_U))] = second.column("n").to_numpy()
    ratio = _ratio(seen, elsewhere, n[True], n[False])
    best = np.lexsort((known, -ratio))[:features]
    vocabulary = Vocabulary(np.sort(known[best[ratio[best] >= LEAST_RATIO]]))

    def lists(texts: np.ndarray, at: np.ndarray, n: int) -> list[list[int]]:
        order = np.lexsort((at, texts))
        return [x.tolist() for x in np.split(at[order], np.searchsorted(texts[order], np.arange(1, n)))] if n else []

    def of(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for lo, hi, block, at in tb.blocks(*tb.column(pa.array(texts, pa.string()))):
            out += lists(*vocabulary.found(*fold(block, at)), hi - lo)
        return out

    terms = {term for group in identities for term in group[1:]}
    sieve = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(terms))) + r")(?!\w)", re.IGNORECASE) if terms else None

    @tb.lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("toxic", pa.bool_()), ("features", pa.list_(pa.int32())), ("swapped", pa.list_(pa.int32()))])
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [{"toxic": toxic, "features": at, "swapped": None} for toxic, at in zip(b.column(0).to_pylist(), of(texts))]
            pairs = [pair for text in texts if sieve and sieve.search(text) for pair in swaps(text, identities)]
            rows += [{"toxic": None, "features": x, "swapped": y} for x, y in zip(of([x for x, _ in pairs]), of([y for _, y in pairs])) if x != y]
            yield pa.RecordBatch.from_struct_array(pa.array(rows, kinds))

    made = labelled.mapInArrow(vectors, "toxic boolean, features array<int>, swapped array<int>")
    patterns = made.groupBy("toxic", "features", "swapped").agg(F.count("*").alias("n")).orderBy("toxic", "features", "swapped").collect()  # at most the sample and its sentences
    rows = [(int(r["toxic"]), r["features"], r["n"]) for r in patterns if r["swapped"] is None]
    pairs = [(r["features"], r["swapped"], r["n"]) for r in patterns if r["swapped"] is not None]
    weights = _solve(rows, pairs, len(vocabulary.features), RIDGE, counterfactual)
    weights[-1] -= np.log(shares[True] / shares[False])
    return Classifier(vocabulary, weights)


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as it is) and score of each row."""
    tb.small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.scores(block, at) for _, _, block, at in tb.blocks(*tb.column(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, rows.select("id").schema.add("score", "double"))


def split_score(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels of rows that are not held out."""
    model = fit(docs, labels.where(~held_out(labels["doc_id"])), **fit_options)
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
