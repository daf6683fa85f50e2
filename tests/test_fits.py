"""Models fitted by sums of gradients, and matching of distributions, against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.operators import decode as C
from chronoprob.operators import gradients as G
from chronoprob.operators import matching as M


def problem(spark, n=240, d=3, k=3, domains=4, seed=0, spread=1.4):
    rng = np.random.default_rng(seed)
    y, g = rng.integers(0, k, n), rng.integers(0, domains, n)
    centers = rng.normal(size=(k, d)) * spread
    x = centers[y] + rng.normal(size=(n, d)) * (1 + 0.3 * g[:, None]) + g[:, None] * 0.5 + 3.0
    rows = [(i, x[i].tolist(), int(y[i]) * 10, f"d{g[i]}", "target" if g[i] == 0 else "source") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label int, domain string, role string"), x, y, g


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(objective, size, rounds=30_000):
    """A plain minimiser: gradient descent with momentum, restarted where the value rises."""
    x, v, step = np.zeros(size), np.zeros(size), 0.3
    last, _ = objective(x)
    for _ in range(rounds):
        value, g = objective(x + 0.9 * v)
        v = 0.9 * v - step * g
        x = x + v
        now, g = objective(x)
        if now > last + 1e-13:
            v, step = v * 0, step * 0.7
        last = now
        if np.abs(g).max() < 1e-9:
            break
    return x


def plain_logistic(x, y, k, c):
    """Standardized, class-balanced logistic regression with an unpenalised constant: (d + 1) by k parameters."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / sd
    w = len(y) / (k * np.bincount(y, minlength=k))[y] / len(y)

    def objective(p):
        a, b = p[: z.shape[1] * k].reshape(-1, k), p[z.shape[1] * k :]
        q = softmax(z @ a + b)
        value = -(w * np.log(q[np.arange(len(y)), y])).sum() + (a**2).sum() / (2 * c * len(y))
        r = q.copy()
        r[np.arange(len(y)), y] -= 1
        r *= w[:, None]
        return value, np.concatenate([(z.T @ r + a / (c * len(y))).ravel(), r.sum(axis=0)])

    p = descend(objective, (z.shape[1] + 1) * k)
    a, b = p[: z.shape[1] * k].reshape(-1, k), p[z.shape[1] * k :]
    return lambda rows: softmax((rows - mean) / sd @ a + b)


def balanced(p, y):
    hit = p.argmax(axis=1) == y
    return float(np.mean([hit[y == c].mean() for c in np.unique(y)]))


def test_minimiser_finds_the_valley():
    def valley(p):
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    run = G.minimised(np.array([-1.2, 1.0]), 200, 1e-8)
    point = next(run)
    with pytest.raises(StopIteration) as end:
        while True:
            point = run.send(valley(point))
    assert end.value.value == pytest.approx([1.0, 1.0], abs=1e-6)


def test_tuned_logistic_equals_a_loop(spark):
    df, x, y, g = problem(spark)
    s = g > 0
    grid = (0.01, 1.0, 50.0)
    for metric in ("accuracy", "balanced_accuracy"):
        out, scores = G.tuned_logistic(df.where("role = 'source'"), df.where("role = 'target'"), "domain", grid, metric, 200, 1e-8)
        plain = []
        for c in grid:
            each = []
            for f in (1, 2, 3):
                p = plain_logistic(x[s & (g != f)], y[s & (g != f)], 3, c)(x[g == f])
                each.append(balanced(p, y[g == f]) if metric == "balanced_accuracy" else (p.argmax(axis=1) == y[g == f]).mean())
            plain.append(np.mean(each))
        assert [v for _, v in scores] == pytest.approx(plain, abs=1e-9)
        p = plain_logistic(x[s], y[s], 3, grid[int(np.argmax(plain))])(x[g == 0])
        got = {r.row_id: r for r in out.collect()}
        at = np.flatnonzero(g == 0)
        assert np.stack([got[i].p for i in at]) == pytest.approx(p, abs=1e-4)
        assert [got[i].predicted for i in at] == [10 * c for c in p.argmax(axis=1)]


def test_nested_selection_equals_a_loop(spark):
    df, x, y, g = problem(spark, 200, domains=3, seed=4, spread=0.8)
    grid = (0.003, 0.3, 30.0)
    out, inner = G.nested_leave_one_out(df, "domain", grid, rounds=200, tolerance=1e-8)
    got, seen = {r.row_id: r for r in out.collect()}, {(r.domain, r.inner, r.c): r for r in inner.collect()}
    assert len(seen) == 3 * 2 * 3
    for o in range(3):
        mean = []
        for c in grid:
            each = []
            for i in range(3):
                if i != o:
                    use = (g != o) & (g != i)
                    each.append(balanced(plain_logistic(x[use], y[use], 3, c)(x[g == i]), y[g == i]))
                    assert seen[f"d{o}", f"d{i}", c].score == pytest.approx(each[-1], abs=1e-9)
            mean.append(np.mean(each))
        best = grid[int(np.argmax(mean))]
        assert {r.c for r in seen.values() if r.domain == f"d{o}" and r.chosen} == {best}
        p = plain_logistic(x[g != o], y[g != o], 3, best)(x[g == o])
        assert np.stack([got[i].p for i in np.flatnonzero(g == o)]) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("penalty", [0.0, 5.0])
def test_risk_extrapolation_equals_numpy(spark, penalty):
    df, x, y, g = problem(spark, seed=7)
    out, risks = G.extrapolated_risk(df.where("role = 'source'"), df.where("role = 'target'"), penalty=penalty, ridge=1e-2)
    s = g > 0
    mean, sd = x[s].mean(axis=0), x[s].std(axis=0, ddof=1)
    z, ys, gs = (x[s] - mean) / sd, y[s], g[s]
    w = s.sum() / (3 * np.bincount(ys))[ys]

    def objective(p):
        a, b = p[:6].reshape(3, 2), p[6:]
        q = softmax(np.column_stack([z @ a + b, np.zeros(len(z))]))
        losses, grads = [], []
        for f in (1, 2, 3):
            at = gs == f
            v = w[at] / w[at].sum()
            r = q[at].copy()
            losses.append(-(v * np.log(r[np.arange(at.sum()), ys[at]])).sum())
            r[np.arange(at.sum()), ys[at]] -= 1
            r *= v[:, None]
            grads.append(np.concatenate([(z[at].T @ r[:, :2]).ravel(), r[:, :2].sum(axis=0)]))
        losses, grads = np.array(losses), np.stack(grads)
        away = losses - losses.mean()
        held = np.concatenate([p[:6], [0, 0]])
        return losses.mean() + penalty * (away**2).mean() + 5e-3 * (held**2).sum(), grads.mean(axis=0) + 2 * penalty * (away[:, None] * grads).mean(axis=0) + 1e-2 * held, losses

    p = descend(lambda v: objective(v)[:2], 8)
    want = softmax(np.column_stack([(x[g == 0] - mean) / sd @ p[:6].reshape(3, 2) + p[6:], np.zeros((g == 0).sum())]))
    got = {r.row_id: r for r in out.collect()}
    assert np.stack([got[i].p for i in np.flatnonzero(g == 0)]) == pytest.approx(want, abs=1e-4)
    assert [r.risk for r in risks.orderBy("domain").collect()] == pytest.approx(objective(p)[2], abs=1e-4)
    with pytest.raises(ValueError):
        G.extrapolated_risk(df.where("domain = 'd1'"), df)


def test_penalty_brings_the_risks_together(spark):
    df, *_ = problem(spark, seed=9)
    s, t = df.where("role = 'source'"), df.where("role = 'target'")
    spread = [G.extrapolated_risk(s, t, penalty=v)[1].agg(F.var_pop("risk")).first()[0] for v in (0.0, 100.0)]
    assert spread[1] < spread[0] / 4


# conditional alignment


def sqrtm(m, p):
    values, vectors = np.linalg.eigh(m)
    return (vectors * values**p) @ vectors.T


@pytest.mark.parametrize("threshold", [0.0, 0.8, 1.1])
def test_conditional_alignment_equals_numpy(spark, threshold):
    df, x, y, g = problem(spark, 260, seed=3)
    at = np.flatnonzero(g == 0)
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4, 0.4, 0.02], len(at))  # the third class is thin
    pseudo = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(at, p)], "row_id long, p array<double>")
    out, fell = M.conditional_coral(df, pseudo, 1e-3, 4, threshold)
    sure, guess = p.max(axis=1) >= threshold, p.argmax(axis=1)
    eye = 1e-3 * np.eye(3)
    every = x[at][sure] if sure.any() else x[at]
    want, thin = x.copy(), []
    for c in range(3):
        own = x[at][(guess == c) & sure]
        if len(own) < 4:
            own = every
            thin.append(10 * c)
        s = (g > 0) & (y == c)
        turn = sqrtm(np.cov(x[s].T) + eye, -0.5) @ sqrtm(np.cov(own.T) + eye, 0.5)
        want[s] = (x[s] - x[s].mean(axis=0)) @ turn + own.mean(axis=0)
    assert fell == thin and (threshold > 1) == (len(thin) == 3)
    got = {r.row_id: r.x for r in out.collect()}
    assert np.stack([got[i] for i in range(len(x))]) == pytest.approx(want, abs=1e-8)
    if thin:
        with pytest.raises(ValueError, match="confident target rows"):
            M.conditional_coral(df, pseudo, 1e-3, 4, threshold, "error")


# joint adaptation


def plain_joint(x, y, target, k, rounds, conditional, regularization, ridge, temperature, soft, unit):
    """By the matrices over all rows."""
    s = ~target
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    order = np.concatenate([np.flatnonzero(s), np.flatnonzero(target)])
    z, ys, ns = z[order], y[s], s.sum()
    n, d = z.shape
    classes = y.max() + 1

    def near(rows):
        means = np.stack([rows[:ns][ys == c].mean(axis=0) for c in range(classes)])
        return softmax(-((rows[ns:, None] - means) ** 2).sum(axis=2) / temperature)

    def outer(a, b):
        v = np.concatenate([a, -b])
        return np.outer(v, v)

    r = near(z)
    pseudo = r.argmax(axis=1)
    for done in range(1, rounds + 1):
        m = outer(np.full(ns, 1 / ns), np.full(n - ns, 1 / (n - ns)))
        for c in range(classes):
            if r[:, c].sum() > 1e-12:
                m = m + conditional * outer((ys == c) / (ys == c).sum(), r[:, c] / r[:, c].sum())
        m = m / np.linalg.norm(m)
        h = np.eye(n) - 1 / n
        left, right = z.T @ m @ z + regularization * np.eye(d), z.T @ h @ z + ridge * np.eye(d)
        half = sqrtm(right, -0.5)
        _, vectors = np.linalg.eigh(half @ left @ half)
        w = half @ vectors[:, :k]
        w = w * np.where(w[np.abs(w).argmax(axis=0), range(k)] < 0, -1, 1)
        if unit:
            w = w / (z @ w).std(axis=0, ddof=1)
        q = near(z @ w)
        stable = bool((q.argmax(axis=1) == pseudo).all())
        pseudo = q.argmax(axis=1)
        r = q if soft else np.eye(classes)[pseudo]
        if stable:
            break
    out = np.empty((n, k))
    out[order] = z @ w
    return out, pseudo, done, stable


@pytest.mark.parametrize(("soft", "unit"), [(False, False), (True, True), (False, True), (True, False)])
def test_joint_adaptation_equals_the_matrices(spark, soft, unit):
    df, x, y, g = problem(spark, 180, d=4, seed=12)
    out, facts = M.joint_adaptation(df, 2, 6, 0.7, 1e-2, 1e-6, 0.5, soft, unit)
    want, pseudo, done, stable = plain_joint(x, y, g == 0, 2, 6, 0.7, 1e-2, 1e-6, 0.5, soft, unit)
    got = {r.row_id: r for r in out.collect()}
    assert np.stack([got[i].x for i in range(len(x))]) == pytest.approx(want, abs=1e-6)
    assert [got[i].predicted for i in np.flatnonzero(g == 0)] == [10 * c for c in pseudo]
    assert all(got[i].predicted is None for i in np.flatnonzero(g > 0))
    assert (facts["rounds"], facts["stable"]) == (done, stable)


# contrastive alignment


def test_template_is_a_simplex():
    t = M.simplex_template(5, 4)
    assert t.sum(axis=0) == pytest.approx(0.0) and t.T @ t == pytest.approx(np.eye(4))
    d = ((t[:, None] - t) ** 2).sum(axis=2)
    assert d[~np.eye(5, dtype=bool)] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        M.simplex_template(3, 3)


@pytest.mark.parametrize("repetitions", [None, 4])
def test_contrastive_alignment_equals_numpy(spark, repetitions):
    import hashlib

    df, x, y, g = problem(spark, 200, d=4, seed=15)
    out = {r.row_id: r.x for r in M.contrastive_alignment(df, 3, repetitions, 7, 0.01).collect()}
    unit = [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(200)]
    for k in range(4):
        anchors = []
        for c in range(3):
            own = [i for i in range(200) if g[i] == k and y[i] == c]
            anchors += [x[own].mean(axis=0)] if repetitions is None else list(x[sorted(own, key=lambda i: (unit[i], i))[:4]])
        a = np.stack(anchors)
        t = M.simplex_template(len(a), min(3, len(a) - 1))
        c = a - a.mean(axis=0)
        w = np.linalg.solve(c.T @ c + 0.01 * max(np.trace(c.T @ c) / 4, 1.0) * np.eye(4), c.T @ t)
        for i in np.flatnonzero(g == k):
            assert out[i] == pytest.approx(((x[i] - a.mean(axis=0)) @ w).tolist(), abs=1e-9)
