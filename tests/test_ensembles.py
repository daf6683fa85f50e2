"""Ranks of skewed values, quantiles, weight searches, reranking, subspaces and affinity graphs against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.operators import adapt as D
from chronoprob.operators import augment as A
from chronoprob.operators import ensembles as N
from chronoprob.operators import features as T
from chronoprob.operators import ranks as K


def skewed(n, rng):
    """A far outlier, a value that a third of all share, and the rest close together."""
    v = rng.normal(size=n) * 1e-3
    v[: n // 3] = 0.25
    v[-1] = 1e12
    return rng.permutation(v)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 50, 4001])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = {0: skewed(n, rng), 1: rng.integers(0, 3, n).astype(float), 2: np.full(n, 2.5), 3: rng.normal(size=n)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "pos int, v double")
    qs = [0.0, 0.05, 0.25, 0.5, 0.8, 0.999, 1.0]
    for r in K.quantiles(df, qs).collect():
        assert r.q == pytest.approx(np.quantile(values[r.pos], qs), rel=1e-12, abs=1e-15)
    for r in K.quantiles(df, qs, False).collect():
        assert [x.low for x in r.q] == np.quantile(values[r.pos], qs, method="lower").tolist()
        assert [x.high for x in r.q] == np.quantile(values[r.pos], qs, method="higher").tolist()
    whole = K.grouped_quantile(df.withColumn("w", F.col("v")), "w", 0.3, [], "q").first()["q"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(values.values())), 0.3))


def test_only_a_bracket_is_put_in_order(spark):
    """What the values inside the brackets are: the same few, whatever an outlier does to the range."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=200_000)
    v[0] = 1e15
    df = spark.createDataFrame([(0, float(x)) for x in v], "pos int, v double")
    edges = df.groupBy("pos").agg(F.percentile_approx("v", [0.5 - 3 / K.ACCURACY, 0.5 + 3 / K.ACCURACY], K.ACCURACY).alias("e"))
    inside = df.join(edges, "pos").where((F.col("v") >= F.get("e", F.lit(0))) & (F.col("v") <= F.get("e", F.lit(1)))).count()
    assert inside < len(v) / 500
    assert K.quantiles(df, [0.5]).first()["q"][0] == pytest.approx(np.median(v))


def test_places_by_value_under_skew(spark):
    rng = np.random.default_rng(3)
    v = skewed(3000, rng)
    rows = [(i, i % 2, float(x)) for i, x in enumerate(v)] + [(5000, None, 1.0), (5001, None, None)]
    df = spark.createDataFrame(rows, "row_id long, g int, v double")
    got = {r.row_id: (r._place, r._total) for r in K.placed_by_value(df, [F.col("v").desc(), "row_id"], ["g"]).collect()}
    for g in (0, 1):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in order] == [(k + 1, len(order)) for k in range(len(order))]
    assert got[5000] == (1, 2) and got[5001] == (2, 2)
    parts = df.repartitionByRange(16, F.col("v").desc(), "row_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts < len(rows) / 8  # neither the outlier nor the shared value makes one task large


def test_ecdf_of_skewed_columns(spark):
    rng = np.random.default_rng(4)
    x = np.stack([skewed(300, rng), rng.integers(0, 2, 300)], axis=1)
    df = spark.createDataFrame([(i, x[i].tolist(), "target" if i % 5 == 0 else "source") for i in range(300)], "row_id long, x array<double>, role string")
    s = x[np.arange(300) % 5 > 0]
    for kind in ("uniform", "mid"):
        for r in T.ecdf(df, kind).collect():
            v, own = x[r.row_id, r.pos], s[:, r.pos]
            right, left = (own <= v).sum(), (own < v).sum()
            assert r.value == pytest.approx(min(1.0, (right + 0.5) / (len(s) + 1)) if kind == "uniform" else (left + right) / 2 / len(s))


# response windows


def test_simplex():
    assert N.simplex(2, 0.5) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    assert N.simplex(1, 0.1) == [(1.0,)]
    assert all(abs(sum(w) - 1) < 1e-9 for w in N.simplex(3, 0.3)) and len(N.simplex(3, 0.25)) == 15
    with pytest.raises(ValueError):
        N.simplex(2, 0.0)


@pytest.mark.parametrize("log", [True, False])
def test_searched_weights_equal_a_loop(spark, log):
    rng = np.random.default_rng(6)
    y, d = rng.integers(0, 3, 90), rng.integers(0, 4, 90)
    cube = rng.dirichlet([1.0] * 3, (90, 3))
    cube[:, 0] += 0.4 * np.eye(3)[y]
    cube[d == 1, 2] += np.eye(3)[y[d == 1]]
    cube /= cube.sum(axis=2, keepdims=True)
    rows = [(i, f"d{d[i]}", int(y[i]), t * 10.0, cube[i, t].tolist()) for i in range(90) for t in range(3)]
    df = spark.createDataFrame(rows, "seq int, domain string, y int, time double, p array<double>")
    out = N.response_window_ensemble(df, ["seq"], [0.0, 9.0, 21.0], "domain", "y", 0.25, log).collect()
    assert len(out) == 90

    def pool(c, w):
        z = np.tensordot(np.log(np.clip(c, 1e-12, 1)) if log else c, w, axes=([1], [0]))
        e = np.exp(z - z.max(axis=1, keepdims=True)) if log else z
        return e / e.sum(axis=1, keepdims=True)

    for k in range(4):
        scores = []
        for w in N.simplex(3, 0.25):
            hit = pool(cube[d != k], np.array(w)).argmax(axis=1) == y[d != k]
            scores.append(round(float(np.mean([hit[y[d != k] == c].mean() for c in range(3)])), 12))
        best = N.simplex(3, 0.25)[int(np.argmax(scores))]
        for r in out:
            if r.domain == f"d{k}":
                assert tuple(r.weights) == best
                assert r.p == pytest.approx(pool(cube[r.seq : r.seq + 1], np.array(best))[0])


def test_one_domain_gets_even_weights(spark):
    df = spark.createDataFrame([(1, "a", 0, t, [0.5, 0.5]) for t in (0.0, 1.0)], "seq int, domain string, y int, time double, p array<double>")
    assert N.response_window_ensemble(df, ["seq"], [0.0, 1.0], "domain", "y").first().weights == [0.5, 0.5]


# pairwise reranking


def plain_pair(m, t):
    """Balanced logistic regression of one feature with a ridge of 1 on the slope, by Newton steps."""
    w = np.where(t, len(t) / (2 * t.sum()), len(t) / (2 * (~t).sum()))
    a = b = 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a + b * m)))
        r, h = w * (q - t), w * q * (1 - q)
        g = np.array([r.sum(), (r * m).sum() + b])
        hess = np.array([[h.sum(), (h * m).sum()], [(h * m).sum(), (h * m * m).sum() + 1]])
        s = np.linalg.solve(hess, g)
        a, b = a - s[0], b - s[1]
    return a, b


def test_reranking_equals_a_plain_version(spark):
    rng = np.random.default_rng(8)
    y = rng.choice(4, 300, p=[0.4, 0.3, 0.2, 0.1])
    p = rng.dirichlet([1.0] * 5, 300)  # no row of the last class
    p[np.arange(300), y] += 0.2
    p[y == 1, 0] += 0.5  # class 1 hides behind class 0
    p /= p.sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(i, p[i].tolist(), int(y[i])) for i in range(300)], "row_id long, p array<double>, y int")
    z = np.log(p)
    a, b = np.zeros((5, 5)), np.zeros((5, 5))
    for i, j in itertools.combinations(range(5), 2):
        at = (y == i) | (y == j)
        if (y == i).any() and (y == j).any():
            a[i, j], b[i, j] = plain_pair(z[at, i] - z[at, j], y[at] == i)
    constants, slopes = N.pairwise_models(df, "y", 5)
    assert constants == pytest.approx(a, abs=1e-6) and slopes == pytest.approx(b, abs=1e-6)

    def reranked(alpha, top=3):
        out = []
        for row in z:
            best, s = sorted(range(5), key=lambda k: (-row[k], k))[:top], row.copy()
            for i, j in itertools.combinations(sorted(best), 2):
                logit = a[i, j] + b[i, j] * (row[i] - row[j])
                s[i] += alpha * logit / (top - 1)
                s[j] -= alpha * logit / (top - 1)
            e = np.exp(s - s.max())
            out.append(e / e.sum())
        return np.stack(out)

    def score(q):
        return float(np.mean([(q.argmax(axis=1) == y)[y == c].mean() for c in np.unique(y)]))

    best = 0.0
    for alpha in (0.0, 0.25, 0.5, 1.0, 2.0):
        if score(reranked(alpha)) > score(reranked(best)) + 1e-12:
            best = alpha
    out, alpha = N.pairwise_reranked(df, df, "y", 5, 3)
    assert alpha == best > 0
    got = {r.row_id: r.p for r in out.collect()}
    assert np.stack([got[i] for i in range(300)]) == pytest.approx(reranked(best), abs=1e-6)
    assert N.pairwise_reranked(df, df, "y", 5, 1)[1] == 0.0


# subspaces


def test_subspaces_equal_their_members(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(90, 6)), rng.integers(0, 3, 90)
    x[:, 0] += y
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "row_id long, x array<double>, label int")
    train, test = df.where("row_id < 60"), df.where("row_id >= 60")
    keep = N.subspace_columns(6, 5, 0.5, seed=3)
    assert (keep.sum(axis=1) == 3).all() and len({tuple(k) for k in keep}) > 1
    s = x[:60].std(axis=0, ddof=1)
    want = 0
    for k in keep:
        d = np.stack([(((x[60:] - x[:60][y[:60] == c].mean(axis=0)) / s) ** 2)[:, k].sum(axis=1) for c in range(3)], axis=1)
        e = np.exp(-d + d.min(axis=1, keepdims=True))
        want = want + e / e.sum(axis=1, keepdims=True) / 5
    got = {r.row_id: r for r in N.random_subspaces(train, test, 5, 0.5, 3).collect()}
    assert np.stack([got[i].p for i in range(60, 90)]) == pytest.approx(want)
    assert [got[i].predicted for i in range(60, 90)] == want.argmax(axis=1).tolist()


# affinity graph


def test_median_of_all_pairs_is_exact(spark):
    rng = np.random.default_rng(10)
    for n, block in ((2, 4), (31, 7), (60, 8)):
        x = rng.normal(size=(n, 3))
        x[n // 2] = x[0]  # a pair at distance 0 does not count
        df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "row_id long, x array<double>")
        d = [((x[i] - x[j]) ** 2).sum() for i in range(n) for j in range(i)]
        d = [v for v in d if v > 1e-12]
        got = A.median_squared_distance(df, block=block)
        assert got == pytest.approx(np.median(d), rel=1e-15) if d else got is None


def test_smoothing_over_the_graph_until_it_stops(spark):
    rng = np.random.default_rng(11)
    x, p = rng.normal(size=(40, 3)), rng.dirichlet([1.0] * 3, 40)
    x[39] = 1e6  # so far away that its weights vanish
    df = spark.createDataFrame([(i, x[i].tolist(), p[i].tolist()) for i in range(40)], "row_id long, x array<double>, p array<double>")
    for standardize, gamma in ((True, None), (False, 0.5)):
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1) if standardize else x
        d = ((z[:, None] - z) ** 2).sum(axis=2)
        g = 0.5 / np.median(d[np.triu_indices(40, 1)]) if gamma is None else gamma
        keep = np.zeros((40, 40), dtype=bool)
        for i in range(40):
            keep[i, sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:4]] = True
        w = np.where(keep | keep.T, np.exp(-g * d), 0.0)
        alone = w.sum(axis=1) <= 1e-12
        t = np.where(alone[:, None], np.eye(40), w / np.where(alone, 1.0, w.sum(axis=1))[:, None])
        now, done = p, 0
        for done in range(1, 51):
            after = 0.6 * t @ now + 0.4 * p
            moved = np.abs(after - now).max()
            now = after
            if moved <= 1e-4:
                break
        out, rounds = D.affinity_smoothed(df, 4, 0.6, 50, 1e-4, gamma, standardize)
        assert rounds == done < 50
        got = {r.row_id: r.p for r in out.collect()}
        assert np.stack([got[i] for i in range(40)]) == pytest.approx(now, abs=1e-9)


# pools of members


def cube_of(spark, p, y=None):
    rows = [(i, int(y[i]) if y is not None else 0, [(f"m{k}", p[i, k].tolist()) for k in range(p.shape[1])]) for i in range(len(p))]
    return spark.createDataFrame(rows, "id int, y int, cube array<struct<name:string,p:array<double>>>")


def test_pools_equal_numpy(spark):
    rng = np.random.default_rng(13)
    p = rng.dirichlet([0.5] * 4, (60, 3))
    p[0] = 0.25  # no certainty at all: the plain mean
    p[1] = np.eye(4)[[0, 1, 2]]
    w = np.array([0.5, 0.3, 0.2])
    q = np.clip(p, 1e-12, 1)
    sure = np.clip(1 + (q * np.log(q)).sum(axis=2) / np.log(4), 0, 1)
    alike = np.clip(1 - 0.5 * np.abs(p - p.mean(axis=1, keepdims=True)).sum(axis=2), 0, 1) ** 2
    rank = np.array([[[sum(b < a or (b == a and j < i) for j, b in enumerate(m)) / 3 for i, a in enumerate(m)] for m in r] for r in p])

    def weighted(v):
        v = v * w
        v[v.sum(axis=1) <= 1e-13] = w
        out = (v[:, :, None] * p).sum(axis=1)
        return out / out.sum(axis=1, keepdims=True)

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    want = {"probability": weighted(np.ones((60, 3))), "log": softmax((np.log(np.maximum(p, 1e-15)) * w[:, None]).sum(axis=1)), "confidence_probability": weighted(sure), "agreement_probability": weighted(alike), "rank": softmax((rank * w[:, None]).sum(axis=1))}
    assert set(want) == set(D.ENSEMBLES)
    for mode, expected in want.items():
        got = {r.id: r.p for r in D.ensemble(cube_of(spark, p), mode, [5, 3, 2]).collect()}
        assert np.stack([got[i] for i in range(60)]) == pytest.approx(expected, abs=1e-9), mode
    short = cube_of(spark, p).unionByName(cube_of(spark, p[:1, :2]))
    for wrong in (lambda: D.ensemble(short), lambda: D.ensemble(cube_of(spark, p), "log", [1.0]), lambda: D.ensemble(cube_of(spark, p), "best")):
        with pytest.raises(ValueError):
            wrong()


def test_aligned_rows_are_moved_once(spark):
    from chronoprob.operators import joins as J

    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 2.0), (2, "a", 3.0), (2, "a", 4.0), (3, None, 5.0)], "id int, decoder string, p double")
    cube = J.aligned_cube(rows, ["id"])
    assert cube._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.id: (r.n, r.n_names, [c.p for c in r.cube]) for r in cube.collect()} == {1: (2, 2, [2.0, 1.0]), 2: (2, 1, [3.0, 4.0]), 3: (1, 0, [5.0])}


@pytest.mark.parametrize("pooling", ["linear", "log"])
def test_stacking_equals_a_loop(spark, pooling):
    rng = np.random.default_rng(14)
    y = rng.choice(3, 80, p=[0.7, 0.2, 0.1])
    p = rng.dirichlet([1.0] * 3, (80, 3))
    p[:, 1] += 0.6 * np.eye(3)[y]
    p /= p.sum(axis=2, keepdims=True)
    s = 1 / np.bincount(y)[y]
    w = np.full(3, 1 / 3)
    for i in range(12):
        if pooling == "linear":
            true = p[np.arange(80), :, y]
            g = np.average(-true / np.clip(true @ w, 1e-12, 1)[:, None], axis=0, weights=s)
        else:
            z = np.einsum("nik,i->nk", np.log(p), w)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            g = np.average(np.einsum("nk,nik->ni", e, np.log(p)) - np.log(p)[np.arange(80), :, y], axis=0, weights=s)
        w = w * np.exp(-0.25 / np.sqrt(i + 1) * (g - g @ w))
        w /= w.sum()
    assert D.stacking_weights(cube_of(spark, p, y), "y", 3, 12, 0.25, pooling) == pytest.approx(w.tolist())


@pytest.mark.parametrize("weighting", N.WEIGHTINGS)
def test_domain_ensembles_equal_numpy(spark, weighting):
    rng = np.random.default_rng(15)
    n = 120
    y, g = rng.integers(0, 3, n), rng.integers(0, 5, n)
    y[g == 3] %= 2  # a domain without the last class
    y[g == 4] = 1  # and one with a single class, which takes no part
    x = rng.normal(size=(n, 3)) + y[:, None] * 0.7 + g[:, None] * 0.1
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(g[i]), "target" if g[i] == 0 else "source") for i in range(n)], "row_id long, x array<double>, label int, domain int, role string")
    out, weights = N.domain_ensemble(df, weighting, 0.5)
    t = x[g == 0]
    p, score = {}, {}
    for d in (1, 2, 3):
        z = np.full((len(t), 3), -1e30)
        for c in range(3):
            if ((g == d) & (y == c)).any():
                z[:, c] = -((t - x[(g == d) & (y == c)].mean(axis=0)) ** 2).sum(axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p[d] = e / e.sum(axis=1, keepdims=True)
        q = np.maximum(p[d], 1e-12)
        own = x[g == d]
        gap = np.linalg.norm(own.mean(axis=0) - t.mean(axis=0)) / np.sqrt(3) + np.linalg.norm(np.cov(own.T) - np.cov(t.T)) / 3
        score[d] = {"uniform": 0.0, "target_confidence": p[d].max(axis=1).mean(), "target_entropy": (q * np.log(q)).sum(axis=1).mean(), "target_feature_similarity": -gap}[weighting]
    e = np.exp((np.array([score[d] for d in (1, 2, 3)]) - max(score.values())) / 0.5)
    w = dict(zip((1, 2, 3), e / e.sum()))
    assert {r.domain: r.weight for r in weights.collect()} == pytest.approx(w)
    got = {r.row_id: r.p for r in out.collect()}
    assert np.stack([got[i] for i in np.flatnonzero(g == 0)]) == pytest.approx(sum(w[d] * p[d] for d in w), abs=1e-9)
