"""Vector codes and whitening against plain versions, and their defined cases; recall of the forest where norms vary."""

import hashlib

import numpy as np
import pytest

from corpusloom.llm import rp_forest, vector_codes, whitening


def table(spark, vectors, labels=None, ids=None):
    rows = [(ids[i] if ids else i, v, labels[i] if labels else i % 3, "x", 0, 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, n int, x double")


def plain_codes(ids, X, parts, entries, rounds, scale=4096):
    x = np.floor(scale * X.astype(np.float64)).astype(np.int64)
    order, w = np.argsort(ids, kind="stable"), X.shape[1] // parts
    books = [x[order[:entries], p * w : (p + 1) * w].copy() for p in range(parts)]

    def assign():
        far = [((x[:, None, p * w : (p + 1) * w] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return np.array([f.argmin(axis=1) for f in far]).T, sum(f.min(axis=1) for f in far)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = codes[:, p] == k
                if mine.any():
                    books[p][k] = x[mine, p * w : (p + 1) * w].sum(axis=0) // mine.sum()
    codes, error = assign()
    return [bytes(c.astype(np.uint8)).hex() for c in codes], error, hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 6, 30])
def test_codes_equal_plain_lloyd(spark, rounds):
    rng = np.random.default_rng(rounds)
    X = rng.normal(size=(300, 16)).astype(np.float32)
    X[50:90] = X[3]  # many equal rows
    ids = rng.permutation(300).tolist()
    labels = [None if i % 7 == 0 else i % 3 for i in range(300)]
    got = {r.vec_id: r for r in vector_codes.encode(table(spark, X.tolist(), labels, ids).repartition(5), parts=4, entries=8, rounds=rounds).collect()}
    codes, errors, sha = plain_codes(np.array(ids), X, 4, 8, rounds)
    sums = {}
    for label, e in zip(labels, errors):
        sums[label] = sums.get(label, 0) + int(e)
    for i, code, e, label in zip(ids, codes, errors, labels):
        assert (got[i].code, got[i].error, got[i].label_error, got[i].codebooks_sha256) == (code, e, sums[label], sha)


def test_only_changed_parts_are_added_up():
    state = vector_codes.Codebooks(np.array([[[0]], [[10]]]))
    state.move([(0, 0, 3, [3]), (0, 1, 2, [21])])
    assert [b.ravel().tolist() for b in state.books] == [[1, 10]]
    state.move([(0, 0, -1, [-4]), (0, 1, 1, [4])])  # one part goes over
    assert [b.ravel().tolist() for b in state.books] == [[-1, 8]]
    state.move([(0, 0, -2, [1]), (0, 1, 2, [-1])])  # an unused entry stays
    assert [b.ravel().tolist() for b in state.books] == [[-1, 4]]


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, -0.0001], None, [nan, 1.0], [inf, 0.0], [None, 1.0], [], [0.5], [1.0, 2.0, 3.0], [1e30, -1e30], [1.0, 2.0, 3.0]]
    got = vector_codes.encode(table(spark, vectors, ids=[4, 1, 2, 3, 0, None, 7, 7, 8, 7]), parts=2, entries=4, rounds=3).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.vec_id is not None) == [(False, 4), (False, 7), (False, 7), (False, 7), (False, 8)]
    assert len(got) == 6 and all(len(r.code) == 4 and r.error >= 0 for r in got)
    few = vector_codes.encode(table(spark, [[1.0, 2.0]]), parts=2).collect()
    assert [(r.code, r.error, r.label_error) for r in few] == [("0000", 0, 0)]
    assert vector_codes.encode(table(spark, [[1.0]]).limit(0)).collect() == []
    assert vector_codes.encode(table(spark, [None, [nan]])).collect() == []


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(5)
    X = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    X[100:150] = X[7]
    got = whitening.whiten(table(spark, X.tolist()).repartition(6)).toPandas()
    x = np.floor(1024 * X.astype(np.float64)).astype(np.int64) + 100_000
    n, S = len(x), x.sum(axis=0)
    far = n * x - S
    values, axes = np.linalg.eigh((far / n).T @ (far / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    wanted = (far / n) @ axes[:, :8] / np.sqrt(values[:8])
    found = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(found * np.sign((found * wanted).sum(axis=0)) - wanted).max() < 1e-9
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == (far * far).sum(axis=1)).all()
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and set(got.n) == {400}


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    one = whitening.whiten(table(spark, [[1.0, 2.0], None, [nan, 1.0], [None, 1.0]])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, 1, 1, 0, None, None, None), (0, 2, 1, 0, None, None, None)]
    flat = whitening.whiten(table(spark, [[1.0, 5.0], [2.0, 5.0], [3.0, 5.0], [3.0, 5.0]])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-9
    short = whitening.whiten(table(spark, [[1.0, 0.0], [2.0], [-1.0, 1.0]], ids=[None, 5, 5])).collect()
    filled = whitening.whiten(table(spark, [[1.0, 0.0], [2.0, 0.0], [-1.0, 1.0]], ids=[None, 5, 5])).collect()
    assert sorted((r.component, r.deviation) for r in short) == sorted((r.component, r.deviation) for r in filled)
    huge = whitening.whiten(table(spark, [[1e30, 1.0], [-1e30, 0.0], [0.0, 0.0]])).collect()
    assert {r.deviation for r in huge if r.vec_id == 0} == {None} and len(huge) == 6
    assert whitening.whiten(table(spark, [None])).collect() == [] and whitening.whiten(table(spark, [[1.0]]).limit(0)).collect() == []
    assert whitening.whiten(table(spark, [[], []])).collect() == []


def test_codes_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from corpusloom.llm import catalog

    rows = table(spark, np.random.default_rng(1).normal(size=(60, 8)).round(2).tolist(), [None, 1, 2] * 20)
    frame = rows.toPandas()
    con = duckdb.connect()
    con.register("frame", frame[["vec_id", "label", "embedding"]])
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS FLOAT[]) AS embedding FROM frame")
    wanted = sorted(con.execute(catalog.OP12_SQL).fetchall())
    got = sorted(tuple(r) for r in vector_codes.encode(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == wanted


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("kind", "sample", "most"), [("even", 4096, 0.8), ("lognormal", 4096, 0.8), ("clusters", 4096, 0.3), ("lognormal", 800, 0.8), ("clusters", 800, 0.3)])
def test_recall_where_norms_vary(spark, kind, sample, most):
    rng = np.random.default_rng(6)
    n, d = 3000, 48
    X = unit(rng.normal(size=(n, d)))
    if kind == "clusters":
        X = unit(unit(rng.normal(size=(30, d)))[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, d)))
    if kind != "even":
        X = X * np.exp(0.7 * rng.normal(size=(n, 1)))
    X = X.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(X.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in rp_forest.search(df, sample=sample).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = X.astype(float)[::20] @ X.astype(float).T
    recalls = []
    for row, q in enumerate(range(0, n, 20)):
        scores[row, q] = -np.inf
        recalls.append(len(got[q] & set(np.argsort(-scores[row], kind="stable")[:20].tolist())) / 20)
    assert np.mean(recalls) >= 0.9 and min(recalls) >= 0.6
    reach = float(np.linalg.norm(X.astype(float), axis=1).max())
    forest = rp_forest.grow(rp_forest.lifted(X.astype(float), reach), np.arange(n), reach)
    met = []
    for q in range(0, n, 200):
        asked = np.append(X[q].astype(float) * reach / np.linalg.norm(X[q].astype(float)), 0)
        known = forest.sample @ asked
        known[forest.ids == q] = -np.inf
        leaves, _ = forest.search(forest.planes @ asked - forest.cuts, known, 20)
        met.append(len(np.unique(np.concatenate([forest.members[x] for x in leaves]))) / n)
    assert np.mean(met) < most  # vectors that a query meets
