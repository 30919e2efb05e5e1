"""Toxicity: held-out accuracy, the effect of the counterfactual penalty, defined cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import toxicity

PLAIN = [f"{a}{b}" for a in "ba ke lo mi ru sta tre vo wen".split() for b in "dal nor pim sek tul".split()]
VILE = ["vermin", "filthbag", "scumlord", "wretch"]
GROUPS = ["muslims", "christians", "jews", "hindus", "buddhists"]


def sentence(rng, *words):
    out = rng.sample(PLAIN, 8)
    for w in words:
        out.insert(rng.randrange(len(out)), w)
    return " ".join(out).capitalize() + "."


def biased(n=900, seed=3):
    """Toxic rows mention muslims most of the time, other rows rarely: labels that teach the wrong lesson."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic = i % 3 == 0
        group = ["muslims"] if rng.random() < (0.8 if toxic else 0.02) else []
        vile = [rng.choice(VILE)] if toxic and rng.random() < 0.8 else []
        rows.append((i, "\n".join([sentence(rng), sentence(rng, *group, *vile), sentence(rng)]), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", 7) for i, t, _ in rows], "doc_id long, text string, score string, predicted int")
    return docs, spark.createDataFrame([(i, x, 1) for i, _, x in rows], "doc_id long, toxic int, quality int")


def test_swapping_lowers_false_positives(spark):
    docs, labels = frames(spark, biased())
    rng = random.Random(9)
    neutral = [(k, sentence(rng, rng.choice(GROUPS)) if k % 2 else sentence(rng, "muslims"), 0) for k in range(200)]
    vile = [(1000 + k, sentence(rng, VILE[k % 4], *(["muslims"] if k % 2 else [])), 1) for k in range(100)]
    asked, _ = frames(spark, neutral + vile)
    share = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        scored = {r.id: r.score for r in toxicity.score(asked, toxicity.fit(docs, labels, counterfactual=weight)).collect()}
        share[weight] = np.mean([scored[i] >= toxicity.THRESHOLD for i, _, _ in neutral]), np.mean([scored[i] >= toxicity.THRESHOLD for i, _, _ in vile])
    assert share[0.0][0] > 0.4  # the plain classifier learns the group
    assert share[toxicity.COUNTERFACTUAL][0] < 0.05 and share[toxicity.COUNTERFACTUAL][1] > 0.9


def test_scores_change_little_under_a_swap(spark):
    docs, labels = frames(spark, biased())
    rng = random.Random(11)
    with_groups = [sentence(rng, g, v) for g in GROUPS for v in ("", "vermin")]
    asked, _ = frames(spark, [(i, t, 0) for i, t in enumerate(with_groups)])
    scored = [r.score for r in toxicity.score(asked, toxicity.fit(docs, labels)).orderBy("id").collect()]
    assert max(scored[0::2]) - min(scored[0::2]) < 0.1 and max(scored[1::2]) - min(scored[1::2]) < 0.1
    assert min(scored[1::2]) > max(scored[0::2]) + 0.3


def test_swaps_are_of_the_same_group():
    pairs = list(toxicity.swaps("Nothing here. Muslims and jews talk! A muslimsx", [["people", "muslims", "jews", "hindus"], ["some", "gay"]]))
    assert pairs == [(" Muslims and jews talk", " jews and hindus talk"), (" Muslims and jews talk", " hindus and muslims talk"), (" Muslims and jews talk", " people and people talk")]
    assert list(toxicity.swaps("gay", [["some", "gay"]])) == [("gay", "some")]


def test_features_equal_a_plain_count():
    import pyarrow as pa
    from corpusloom.llm import textblocks as tb
    from corpusloom.llm.language_id import fold

    texts = ["Vile, vile words! " * 3, "", None, "vile", "Ünkown wörds123words"]
    data, offsets = tb.column(pa.array(texts))
    at, hashes, times = toxicity.counted(*toxicity.occurrences(*fold(data, offsets)))
    plain = {}
    for i, t in enumerate(texts):
        for w in "".join(c.lower() if c.isalpha() else " " for c in t or "").encode().split():
            for piece in {w} | {w[:k] + b"*" for k in toxicity.BEGINNINGS if len(w) > k}:
                plain[i, piece] = plain.get((i, piece), 0) + 1
    assert sorted(zip(at.tolist(), times.tolist())) == sorted((i, n) for (i, _), n in plain.items())
    assert hashes[(at == 3)].tolist() == [h for h in hashes[at == 0].tolist() if h in set(hashes[at == 3].tolist())]


def test_held_out_accuracy(spark):
    rows = [(i, t, x) for i, t, x in biased(1500, 5)]
    docs, labels = frames(spark, rows)
    out = toxicity.split_score(docs, labels).collect()
    vile = {i: any(v in t for v in VILE) for i, t, _ in rows}
    assert len(out) == 1500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    asked = [r for r in out if r.held_out]
    assert np.mean([r.predicted == 1 for r in asked if vile[r.doc_id]]) > 0.95
    # of the rows without such a word 9 % are labelled toxic, so not all of them can be told
    assert np.mean([r.predicted == 1 for r in asked if not vile[r.doc_id]]) < 0.09
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_only_labels_that_are_not_held_out_are_learned(spark):
    docs, labels = frames(spark, biased(600, 7))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(tuple(r) for r in toxicity.split_score(docs, x).collect()) for x in (labels, turned))
    assert first == second


def test_defined_cases(spark):
    rows = biased(300, 1)
    long = " ".join(rows[k % 300][1] for k in range(1, 3000) if k % 3)
    docs, labels = frames(spark, rows)
    more = spark.createDataFrame([(None, "vermin", "a", 1), (9001, None, "a", 1), (9002, "", "a", 1), (9003, long, "a", 1), (9003, long, "a", 1), (9004, long + " vermin", "a", 1)], docs.schema)
    odd = spark.createDataFrame([(None, 1, 1), (5, None, 1), (9001, 0, 1), (7, 1, 1), (7, 0, 1), (424242, 1, 1)], labels.schema)
    out = toxicity.split_score(docs.unionByName(more), labels.unionByName(odd)).collect()
    assert len(out) == 306 and sum(r.doc_id is None for r in out) == 1 and not next(r for r in out if r.doc_id is None).held_out
    scores = {r.doc_id: r.score for r in out}
    assert scores[9001] == scores[9002] < 0.3 and scores[9003] < 0.3 and scores[9004] >= 0.3
    assert {r.score for r in toxicity.split_score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.split_score(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.split_score(docs.limit(0), labels).collect() == []


def test_a_bounded_sample_keeps_the_base_rate(spark):
    docs, labels = frames(spark, biased(1200, 2))
    model = toxicity.fit(docs, labels, toxic_rows=200, other_rows=150, features=64)
    assert len(model.vocabulary.features) <= 64
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert abs(np.mean(scores) - 1 / 3) < 0.08
