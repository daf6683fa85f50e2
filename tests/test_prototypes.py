"""Prototype decoders and sparse projections against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.operators import decode as C
from chronoprob.operators import features as T


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def frame(spark, x, y, w=None):
    rows = [(i, [float(v) for v in a], int(b), float(1 if w is None else w[i])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label int, w double")


def data(seed=0, n=60, d=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    return rng.normal(size=(n, d)) + 2 * np.eye(3, d)[y], y


def taken(df):
    return np.array([r.p for r in df.orderBy("row_id").collect()])


def test_correlated(spark):
    x, y = data()
    w = np.where(y == 1, 0.0, 1 + np.arange(len(y)) % 4)  # a class without weight counts its rows alike
    rows, _ = data(1, 20)
    rows[3] = 7.0  # no variation
    got = taken(C.correlated(frame(spark, x, y, w), frame(spark, rows, np.zeros(20)), "w"))
    means = np.stack([x[y == c].mean(axis=0) if w[y == c].sum() == 0 else np.average(x[y == c], axis=0, weights=w[y == c]) for c in range(3)])
    scores = np.array([[np.corrcoef(r, m)[0, 1] if r.std() > 0 else 0.0 for m in means] for r in rows])
    assert np.allclose(got, softmax(scores)) and np.allclose(got[3], 1 / 3)
    plain = taken(C.correlated(frame(spark, x, y), frame(spark, rows, np.zeros(20))))
    means = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    assert np.allclose(plain[0], softmax(np.array([[np.corrcoef(rows[0], m)[0, 1] for m in means]]))[0])


@pytest.mark.parametrize("fixed, scaled", [(None, True), (0.25, False)])
def test_blended_prototypes(spark, fixed, scaled):
    x, y = data(2)
    k, ky = data(3, 7)
    k, ky = k[ky != 2], ky[ky != 2]  # one class has no known rows
    rows, _ = data(4, 15)
    got = taken(C.blended_prototypes(frame(spark, x, y), frame(spark, k, ky), frame(spark, rows, np.zeros(15)), 3.0, fixed, 0.7, scaled))
    means = []
    for c in range(3):
        own, n = x[y == c].mean(axis=0), (ky == c).sum()
        share = n / (n + 3.0) if fixed is None else fixed
        means.append((1 - share) * own + share * k[ky == c].mean(axis=0) if n else own)
    scale = np.vstack([x, k]).std(axis=0, ddof=1) if scaled else np.ones(5)
    want = softmax(-np.array([[(((r - m) / scale) ** 2).sum() for m in means] for r in rows]) / 0.7)
    assert np.allclose(got, want)


def test_blended_prototypes_refuses(spark):
    x, y = data(5, 12)
    rows = frame(spark, x, y)
    with pytest.raises(ValueError, match="9"):
        C.blended_prototypes(rows, rows.withColumn("label", F.lit(9)), rows)
    with pytest.raises(ValueError):
        C.blended_prototypes(rows, rows, rows, prior_strength=0.0)
    with pytest.raises(ValueError):
        C.blended_prototypes(rows, rows, rows, fixed=1.5)
    none = C.blended_prototypes(rows, rows.where("false"), rows)
    assert np.allclose(taken(none), taken(C.centroid(rows, rows, floor=1e-8)))


def test_sparse_projection(spark):
    x, y = data(6, 10, 8)
    w = T.sparse_matrix(8, 6, 0.5, seed=2)
    assert set(np.round(np.unique(np.abs(w)), 9)) <= {0.0, round(1 / np.sqrt(3.0), 9)}
    got = np.array([r.x for r in T.sparse_projected(frame(spark, x, y), 8, 6, 0.5, seed=2).orderBy("row_id").collect()])
    assert np.allclose(got, x @ w)
    big = T.sparse_matrix(400, 50)
    assert abs((big != 0).mean() - 0.05) < 0.01 and abs(np.sign(big).sum()) < 150
    with pytest.raises(ValueError):
        T.sparse_matrix(4, 2, 0.0)
