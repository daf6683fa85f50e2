"""Source-free adaptation for many settings at once, against a plain loop over one setting and one row at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.operators import source_free as S


def data(spark, n=90, d=3, k=3, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    y = rng.choice(k, n, p=[0.5, 0.3, 0.2])
    x = rng.normal(size=(k, d))[y] * 2 + rng.normal(size=(n, d)) + 4.0
    p = rng.dirichlet(np.full(k, 0.6), n) * 0.6 + 0.4 * np.eye(k)[y]
    rows = [(i, x[i].tolist(), p[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, p array<double>").repartition(parts)
    return df.select("row_id", "x", F.lit("?").alias("h")), df.select("row_id", "p"), x, p


def soft(v):
    top = max(v)
    e = [0.0 if a == -math.inf else math.exp(max(a - top, -50.0)) for a in v]
    return [a / sum(e) for a in e]


def plain(x, start, s):
    """One setting: (probabilities, classes found, rounds, why it stopped)."""
    n, k = start.shape
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd < 1e-12, 1.0, sd)
    p, active, rounds, stop, seen = start.copy(), 0, 0, "max_iterations", []
    if s.rounds == 0 or s.weight == 0:
        return p, 0, 0, "prototype_adaptation_disabled"
    for r in range(1, s.rounds + 1):
        label = [list(row).index(max(row)) for row in p]
        chosen = []
        for c in range(k):
            own = [i for i in range(n) if label[i] == c]
            sure = [i for i in own if p[i].max() >= s.threshold]
            if s.selection == "balanced_topk":
                pool = sure if len(sure) >= s.least_rows else own
                sure = sorted(pool, key=lambda i: (-p[i].max(), i))[: max(s.least_rows, s.per_class or s.least_rows)]
            chosen += [(i, c) for i in sure]
        if sorted(chosen) in seen:
            stop = "selection_repeated"
            break
        seen.append(sorted(chosen))
        means = {}
        for c in range(k):
            own = [i for i, l in chosen if l == c]
            if len(own) >= s.least_rows:
                w = [p[i][c] for i in own]
                means[c] = sum(v * z[i] for v, i in zip(w, own)) / sum(w)
        active = len(means)
        if not chosen or active < s.least_classes:
            stop = "insufficient_active_classes" if chosen else "none_selected"
            break
        after = []
        for i in range(n):
            near = soft([-np.mean((z[i] - means[c]) ** 2) / s.temperature if c in means else -math.inf for c in range(k)])
            after.append(soft([(1 - s.weight) * math.log(max(a, 1e-12)) + s.weight * math.log(max(b, 1e-12)) for a, b in zip(start[i], near)]))
        p, rounds = np.array(after), r
        if [list(row).index(max(row)) for row in p] == label:
            stop = "selection_unchanged"
            break
    return p, active, rounds, stop


def corrected(p, s):
    if not s.prior_strength:
        return p
    k = p.shape[1]
    w = {"mean": [1.0] * len(p), "confidence_weighted": p.max(axis=1), "entropy_weighted": [max(1 + sum(a * math.log(max(a, 1e-12)) for a in row) / math.log(k), 1e-12) for row in p]}[s.estimator]
    prior = np.maximum((1 - s.smoothing) * np.average(p, axis=0, weights=w) + s.smoothing / k, s.floor)
    out = p / (prior / prior.sum()) ** s.prior_strength
    return out / out.sum(axis=1, keepdims=True)


def entropy(p):
    return -sum(a * math.log(max(a, 1e-12)) for a in p) / math.log(len(p))


def taken(df):
    return np.array([r.p for r in df.orderBy("row_id").collect()])


SETTINGS = [
    *S.grid_settings(thresholds=(0.3, 0.75, 1.0), weights=(0.5, 1.0), strengths=(0.0, 0.5)),
    S.Setting(rounds=0),
    S.Setting(selection="balanced_topk", per_class=2, least_rows=3, threshold=0.99),
    S.Setting(threshold=0.9, least_rows=40),
    S.Setting(rounds=1, threshold=0.5),
    S.Setting(rounds=40, threshold=0.6, weight=0.9, selection="balanced_topk", per_class=7, temperature=0.5),
    S.Setting(prior_strength=0.75, estimator="entropy_weighted", smoothing=0.25, floor=0.2),
    S.Setting(prior_strength=1.0, estimator="confidence_weighted"),
]


@pytest.mark.parametrize("seed", [1, 4])
def test_all_settings_equal_a_loop(spark, seed):
    df, start, x, p = data(spark, seed=seed)
    a = S.adaptation(df, start, SETTINGS)
    mine = {r.row_id: (np.array([r.x]), np.array([r.p])) for r in a.rows.collect()}
    for i, s in enumerate(SETTINGS):
        q, active, rounds, stop = plain(x, p, s)
        f = a.models.found[i]
        assert (f.active, f.rounds, f.stop) == (active, rounds, stop), s
        q = corrected(q, s)
        got = np.vstack([a.models.probabilities(i, (mine[j][0] - a.shift) / a.scale, mine[j][1]) for j in range(len(x))])
        assert np.allclose(got, q, atol=1e-9), s
        assert np.allclose(a.shapes[i], [*q.mean(axis=0), np.mean([entropy(r) for r in q]), q.max(axis=1).mean()], atol=1e-9)
    assert len({f.stop for f in a.models.found}) >= 4


def test_grid_takes_the_best_shape(spark):
    df, start, x, p = data(spark)
    settings = SETTINGS[:12]
    got, ranked = S.grid(df, start, settings)
    scores, results = [], []
    for s in settings:
        q, active, _, _ = plain(x, p, s)
        q = corrected(q, s)
        results.append(q)
        scores.append(entropy(q.mean(axis=0)) + 0.5 * active / 3 + 0.25 * q.max(axis=1).mean() - 0.1 * np.mean([entropy(r) for r in q]))
    assert ranked[0]["score"] == pytest.approx(max(scores)) and [f["score"] for f in ranked] == sorted((f["score"] for f in ranked), reverse=True)
    assert np.allclose(taken(got), results[ranked[0]["setting"]], atol=1e-9)


@pytest.mark.parametrize("mode", ["logit_mean", "arithmetic_mean"])
def test_consensus(spark, mode):
    df, start, x, p = data(spark, seed=2)
    got, weights = S.consensus(df, start, mode=mode, temperature=0.3)
    parts = [corrected(plain(x, p, s)[0], s) for s in S.VARIANTS.values()]
    w = soft([(1 - np.mean([entropy(r) for r in q]) + entropy(q.mean(axis=0))) / 0.3 for q in parts])
    assert np.allclose([weights[v] for v in S.VARIANTS], w)
    if mode == "logit_mean":
        want = np.array([soft(sum(v * np.log(np.maximum(q[i], 1e-12)) for v, q in zip(w, parts))) for i in range(len(x))])
    else:
        want = sum(v * q for v, q in zip(w, parts))
    assert np.allclose(taken(got), want, atol=1e-9)


def test_partitions_do_not_matter(spark):
    df, start, _, _ = data(spark)
    settings = [S.Setting(selection="balanced_topk", per_class=3), S.Setting(threshold=0.5)]
    one, many = (S.adaptation(df.repartition(n), start, settings) for n in (1, 16))
    for a, b in zip(one.models.found, many.models.found):
        assert (a.stop, a.rounds, a.active) == (b.stop, b.rounds, b.active) and np.allclose(a.means, b.means, equal_nan=True)


def test_edges(spark):
    df, start, _, _ = data(spark, n=12)
    none = df.where("row_id < 0")
    assert S.grid(none, start)[0].count() == 0 and S.grid(none, start)[1] == []
    assert S.consensus(none, start)[0].count() == 0
    lacking = df.withColumn("x", F.when(F.col("row_id") != 3, F.col("x"))).unionByName(df.where("row_id = 5"))
    short = start.withColumn("p", F.when(F.col("row_id") != 4, F.col("p")))
    got, _ = S.grid(lacking, short, [S.Setting(selection="balanced_topk", per_class=2)])
    assert sorted(r.row_id for r in got.collect()) == [0, 1, 2, 5, 5, 6, 7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        S.grid(df, start, [])
    for wrong in ({"threshold": 1.5}, {"selection": "some"}, {"rounds": -1}, {"temperature": 0.0}):
        with pytest.raises(ValueError):
            S.Setting(**wrong)
