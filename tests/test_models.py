"""State models, decoders, transforms and adaptation against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.operators import adapt as D
from chronoprob.operators import decode as C
from chronoprob.operators import features as T
from chronoprob.operators import inference as I
from chronoprob.operators import states as H


def dirichlet(n, c, seed):
    return np.random.default_rng(seed).dirichlet([2.0] * c, n)


def all_paths(e, stay):
    """Probability of every state path."""
    moves = H.transition(e.shape[1], stay)
    for path in itertools.product(range(e.shape[1]), repeat=len(e)):
        s = -np.log(e.shape[1]) + e[0, path[0]] + sum(moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
        yield path, s


def test_recursions_equal_enumeration():
    e = H.emissions(dirichlet(5, 3, 1))
    paths = list(all_paths(e, 0.7))
    total = np.logaddexp.reduce([s for _, s in paths])
    assert H.grid_log_likelihood(e, np.array([0.7]))[0] == pytest.approx(total)
    posterior = np.zeros((5, 3))
    for path, s in paths:
        for t, k in enumerate(path):
            posterior[t, k] += np.exp(s - total)
    assert H.forward_backward(e, 0.7) == pytest.approx(posterior)
    assert H.viterbi(e, 0.7).tolist() == list(max(paths, key=lambda x: x[1])[0])


def test_causal_posterior_ignores_later_rows():
    e = H.emissions(dirichlet(6, 3, 2))
    assert H.forward_backward(e, 0.6, causal=True)[:4] == pytest.approx(H.forward_backward(e[:4], 0.6, causal=True))


@pytest.mark.parametrize("complete", [True, False])
def test_press_path_is_the_best_one(complete):
    rng = np.random.default_rng(3)
    e, position, overlap = H.emissions(dirichlet(6, 4, 3)), np.stack(dirichlet(6, 4, 5)), rng.random(6)
    stay = rng.uniform(0.3, 0.9, 7)
    templates, prior = [(1, 2, 3), (3, 1, 2)], [0.2, 0.8]
    best = (-np.inf, None, None)
    for number, order in enumerate(templates):
        for steps in itertools.product((0, 1), repeat=6):
            states = np.cumsum(steps)
            if states[-1] > 6 or (complete and states[-1] < 5):
                continue
            s = 0.15 * np.log(prior[number]) + (np.log(1 - stay[0]) if states[0] else 0.0)
            for t, k in enumerate(states):
                s += e[t, order[k // 2] if k % 2 else 0] + 0.35 * np.log(position[t, (k + 1) // 2 if k % 2 else 0]) + 0.15 * np.log(overlap[t] if k % 2 else 1 - overlap[t])
                if t:
                    s += np.log(stay[k] if k == states[t - 1] else 1 - stay[k - 1])
            if s > best[0]:
                best = (s, number, states.tolist())
    number, states, labels = H.template_path(e, templates, stay, np.array(prior), complete=complete, position=position, overlap=overlap)
    assert (number, states.tolist()) == best[1:]
    assert labels.tolist() == [templates[number][k // 2] if k % 2 else 0 for k in states]
    assert H.template_path(e[:3], templates, 0.88)[0] == -1  # too few rows for three presses with rests


def test_prefixes_are_decoded_as_by_themselves():
    rng = np.random.default_rng(31)
    e, position, overlap = H.emissions(dirichlet(9, 4, 30)), np.stack(dirichlet(9, 4, 31)), rng.random(9)
    tell, templates = np.stack(dirichlet(9, 2, 32)), [(1, 2, 3), (3, 1, 2)]
    stay = rng.uniform(0.3, 0.9, 7)
    number, state, label = H.template_prefixes(e, templates, stay, tell.cumsum(axis=0) / np.arange(1, 10)[:, None], position=position, overlap=overlap)
    for n in range(1, 10):
        one = H.template_path(e[:n], templates, stay, tell[:n].mean(axis=0), complete=False, position=position[:n], overlap=overlap[:n])
        assert (number[n - 1], state[n - 1], label[n - 1]) == (one[0], one[1][-1], one[2][-1])


def test_online_steps_before_and_after_the_row():
    e = H.emissions(dirichlet(30, 3, 4))
    prior = np.full(3, 1 / 3)
    after, before = H.online_path(e, prior, rate=0.4), H.online_path(e, prior, rate=0.4, timing="before_predict")
    assert after[0] == pytest.approx(np.exp(e[0])) and before[0].max() > after[0].max()
    assert H.online_path(e, prior, rate=0.0, temperature=2.0) == pytest.approx(np.exp(e / 2) / np.exp(e / 2).sum(1, keepdims=True))
    held = H.online_path(e, prior, rate=50.0, updates=3, clip=0.1)
    assert np.abs(np.log(held / np.exp(e))).max() < 0.5  # the bias stays within its bounds
    with pytest.raises(ValueError):
        H.online_path(e, prior, timing="never")


def test_mahalanobis_equals_the_formula(spark):
    rng = np.random.default_rng(17)
    mix = rng.normal(size=(4, 4))
    x, y = rng.normal(size=(300, 4)) @ mix, np.repeat([0, 1, 2], [150, 100, 50])
    x += y[:, None] * 0.4
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "row_id long, x array<double>, label int")
    means = np.stack([x[y == k].mean(0) for k in range(3)])
    cov = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in range(3)) / 297 + 1e-3 * np.eye(4)
    d = np.einsum("nki,ij,nkj->nk", x[:, None] - means, np.linalg.inv(cov), x[:, None] - means)
    for prior, t in (("empirical", 1.0), ("uniform", 2.5)):
        z = -d / t + (np.log([0.5, 1 / 3, 1 / 6]) if prior == "empirical" else 0.0)
        p = np.exp(z - z.max(1, keepdims=True))
        got = {r["row_id"]: r["p"] for r in C.mahalanobis(rows, rows, prior=prior, temperature=t).collect()}
        assert np.stack([got[i] for i in range(300)]) == pytest.approx(p / p.sum(1, keepdims=True), abs=1e-8)


def test_fit_prefers_the_true_persistence(spark):
    rows = []
    for k in range(6):
        for t in range(30):
            p = [0.9, 0.05, 0.05] if (t // 10 + k) % 2 else [0.05, 0.9, 0.05]
            rows.append(("m", k, float(t), p))
    df = spark.createDataFrame(rows, "model string, seq int, time double, p array<double>")
    got = H.fit(df, ["model"], ["seq"], 3, 20).first()
    plain = sum(H.grid_log_likelihood(H.emissions([r[3] for r in rows if r[1] == k]), H.stay_grid(3, 20)) for k in range(6))
    assert got["stay_probability"] == pytest.approx(H.stay_grid(3, 20)[plain.argmax()])
    assert got["log_likelihood"] == pytest.approx(plain.max())


@pytest.fixture(scope="module")
def feat(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), int(i % 3), int(i % 4), "target" if i % 4 == 0 else "source") for i in range(80)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label int, domain int, role string")


def matrix(df):
    return np.array([r["x"] for r in df.orderBy("row_id").collect()])


def test_moments_and_covariance(feat):
    x = matrix(feat)
    mean, cov, n = T.mean_and_covariance(feat)
    assert n == 80 and mean == pytest.approx(x.mean(axis=0)) and cov == pytest.approx(np.cov(x.T))


def test_whitened_source_has_unit_covariance(feat):
    assert np.cov(matrix(T.source(T.zca(feat, 1e-9))).T) == pytest.approx(np.eye(4), abs=1e-5)


def test_coral_gives_the_source_the_target_covariance(feat):
    moved = C.coral(feat, 1e-9)
    a, b = matrix(moved.where("role = 'source'")), matrix(feat.where("role = 'target'"))
    assert np.cov(a.T) == pytest.approx(np.cov(b.T), abs=1e-5) and a.mean(axis=0) == pytest.approx(b.mean(axis=0))


def test_ecdf_counts(feat):
    x = matrix(feat)
    role = np.array([r["role"] for r in feat.orderBy("row_id").collect()])
    got = {(r["row_id"], r["pos"]): r["value"] for r in T.ecdf(feat).collect()}
    src = np.sort(x[role == "source", 2])
    for i in (0, 7, 33):
        assert got[i, 2] == pytest.approx(min(1.0, (np.searchsorted(src, x[i, 2], side="right") + 0.5) / (len(src) + 1)))


def test_orthogonal_alignment_keeps_distances(feat):
    out, facts = C.anchor_alignment(feat)
    a, b = matrix(feat.where("domain = 1")), matrix(out.where("domain = 1"))
    gaps = lambda m: np.linalg.norm(m[:, None] - m[None], axis=-1)
    assert gaps(a) == pytest.approx(gaps(b)) and facts["after"] >= facts["before"]


def test_leave_one_out_models_leave_the_domain_out(feat):
    x, rows = matrix(feat), feat.orderBy("row_id").collect()
    label, domain = np.array([r["label"] for r in rows]), np.array([r["domain"] for r in rows])
    got = {r["row_id"]: r["predicted"] for r in C.leave_one_domain_out(feat).collect()}
    for i in range(80):
        means = np.stack([x[(label == c) & (domain != domain[i])].mean(axis=0) for c in range(3)])
        assert got[i] == ((x[i] - means) ** 2).sum(axis=1).argmin()


def test_correlated_columns_go(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=50)
    rows = [(i, [float(v) for v in (a[i], a[i] * 2 + 0.001 * rng.normal(), rng.normal())], "source") for i in range(50)]
    assert T.correlation_filtered(spark.createDataFrame(rows, "row_id int, x array<double>, role string"), 0.9) == [0, 2]


def test_prior_shift_of_blocks_moves_no_rows(spark):
    """Priors are tables of known size: no round is nested in the next one's plan, and no block's rows are shuffled."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(3), 60)
    df = spark.createDataFrame([(f"S{i % 2}", i, p[i].tolist()) for i in range(60)], "subject string, i int, p array<double>")
    prior = D.prior_shift(df, [1 / 3] * 3, ["subject"], iterations=3)
    assert "Join" not in prior._jdf.queryExecution().optimizedPlan().toString()
    plan = D.shifted(df, prior, [1 / 3] * 3, ["subject"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    for r in prior.collect():
        q, t = p[int(r.subject[1]) :: 2], np.ones(3) / 3
        for _ in range(3):
            w = q * t * 3
            t = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
        assert r.prior == pytest.approx(t.tolist())


def test_prior_shift_equals_the_loop(spark):
    p = dirichlet(40, 3, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id int, p array<double>")
    prior = np.full(3, 1 / 3)
    for _ in range(4):
        q = p * prior
        prior = (q / q.sum(axis=1, keepdims=True)).mean(axis=0)
    assert D.prior_shift(df, [1 / 3] * 3, iterations=4).first()["prior"] == pytest.approx(prior.tolist())


def test_stacking_beats_the_worst_candidate(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    good = [[0.8, 0.2] if k == 0 else [0.2, 0.8] for k in y]
    rows = [(i, int(y[i]), [("a", good[i]), ("b", [0.5, 0.5])]) for i in range(200)]
    cube = spark.createDataFrame(rows, "id int, true_label int, cube array<struct<name:string,p:array<double>>>")
    w = D.stacking_weights(cube, "true_label", 2, 60, 1.0)  # steps get shorter
    assert w[0] > 0.8 and sum(w) == pytest.approx(1.0)


def test_black_box_shift_finds_the_prior(spark):
    rng = np.random.default_rng(5)
    draw = lambda n, share: [(int(k), [0.7, 0.3] if k == 0 else [0.2, 0.8]) for k in (rng.random(n) > share)]
    s = spark.createDataFrame(draw(400, 0.5), "true_label int, p array<double>")
    t = spark.createDataFrame(draw(400, 0.9), "true_label int, p array<double>")
    assert D.black_box_shift(s, t, "true_label", 1e-9)[0] == pytest.approx(0.9, abs=0.05)


def test_exact_sign_flips(spark):
    d = [0.3, 0.1, 0.4, -0.05]
    df = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(d)], "subject string, d double")
    got = I.sign_flip_p(df, [], 100).first()
    flips = [abs(np.mean([v * s for v, s in zip(d, signs)])) for signs in itertools.product((1, -1), repeat=4)]
    assert got["p_value"] == pytest.approx(np.mean([f >= abs(np.mean(d)) - 1e-12 for f in flips]))


def test_neighbours_across_blocks(feat):
    s, t = feat.where("role = 'source'"), feat.where("role = 'target'")
    small = C.nearest_neighbours(s, t, 3, block=7).select("row_id", "place", "train_id")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, C.nearest_neighbours(s, t, 3).select("row_id", "place", "train_id").collect()))


def test_neighbours_among_copies_in_full_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 1, (1300, 64))
    train = [(10_000 + i, i % 3, x[i % 20].tolist()) for i in range(700)]  # 35 copies of each of 20 rows
    test = [(i, 0, x[i].tolist()) for i in range(1300)]
    fields = "row_id long, label int, x array<double>"
    found = C.nearest_neighbours(spark.createDataFrame(train, fields).coalesce(1), spark.createDataFrame(test, fields).coalesce(1), 5)
    got = found.where("row_id < 20").orderBy("row_id", "place").select("row_id", "train_id", "distance").collect()
    assert [tuple(r) for r in got] == [(i, 10_000 + i + 20 * c, 0.0) for i in range(20) for c in range(5)]


def test_smaller_calibration_splits_are_part_of_larger_ones(spark):
    from chronoprob.operators.labels import calibration_split

    trials = spark.createDataFrame([("s", c, i) for c in range(2) for i in range(12)], "subject string, label int, trial int")
    roles = calibration_split(trials, [2, 5], [1], ["subject", "label"], "trial")
    few = {(r["label"], r["trial"]) for r in roles.where("k = 2 and role = 'calibration'").collect()}
    more = {(r["label"], r["trial"]) for r in roles.where("k = 5 and role = 'calibration'").collect()}
    assert few < more and len(few) == 4 and len(more) == 10
    assert roles.where(F.col("role") == "evaluation").count() == 24 * 2 - 14


def test_unknown_decoders_are_named(spark):
    rows = spark.createDataFrame([(1, [0.0], 0)], "row_id long, x array<double>, label int")
    with pytest.raises(ValueError, match="no decoder is called 'oracle'"):
        C.fit_named("oracle", rows, rows)
    with pytest.raises(ValueError):
        C.gaussian(rows, rows, "cubic")
    assert {C.normalized_name(n) for n in ("LR", "Random Forest", "svc", "gradient-boosting")} == {"logistic", "forest", "linear_svm", "boosting"}


def test_kernel_sums_hold_one_share_and_a_batch(spark):
    """No row packs a block, so that what Python holds does not grow with the pairs of blocks."""
    import pyarrow as pa

    from chronoprob.operators import augment as A

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), i % 3, "target" if i % 3 == 0 else "source") for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, domain int, role string")
    plan = A.kernel_mmd(df, 0.5, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "PythonUDF" not in plan
    whole = pa.table({"b": [0] * 50, "kind": [0] * 10 + [1] * 40, "g": [0] * 50, "x": [[float(i)] for i in range(50)]})
    seen = [(len(u), len(v), own) for u, _, v, _, own in A._meetings(iter(whole.to_batches(max_chunksize=7)))]
    assert seen[0] == (10, 10, True) and max(n for n, _, own in seen[1:]) <= 7
    assert sum(n for n, _, own in seen if not own) == 40 and all(v == 10 for _, v, _ in seen)


def test_estimated_discrepancies_are_near_the_exact_ones(spark):
    from chronoprob.operators import augment as A

    rng = np.random.default_rng(29)
    rows = [(i, (rng.normal(size=3) + (i % 3) * 0.8).tolist(), i % 3, "target" if i % 3 == 0 else "source") for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, domain int, role string")
    x, d = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gaps = ((x[:, None] - x) ** 2).sum(-1)
    gamma = 1 / (2 * np.median(gaps[np.triu_indices(240, 1)]))
    assert A.median_gamma(df) == pytest.approx(gamma)
    k = np.exp(-gamma * gaps)
    exact = {j: k[d == j][:, d == j].mean() + k[d == 0][:, d == 0].mean() - 2 * k[d == j][:, d == 0].mean() for j in (1, 2)}
    assert {r["domain"]: r["mmd2"] for r in A.kernel_mmd(df, block=32).collect()} == pytest.approx(exact)
    rough = {r["domain"]: r["mmd2"] for r in A.mmd_estimates(df, 3, gamma, k=4096).collect()}
    assert rough == pytest.approx(exact, abs=0.05)


@pytest.mark.parametrize("mode", ["orthogonal", "mcca", "ridge"])
def test_alignment_brings_domains_together(spark, mode):
    """Four domains see the same classes through mixes of their own; aligned, their class means agree."""
    rng = np.random.default_rng(37)
    latent = rng.normal(size=(8, 3))
    mixes = [np.linalg.qr(rng.normal(size=(3, 3)))[0] @ (np.eye(3) if mode == "orthogonal" else np.diag(rng.uniform(0.5, 2, 3))) for _ in range(4)]
    rows = []
    for d, mix in enumerate(mixes):
        for label in range(8):
            for _ in range(6):
                rows.append((len(rows), d, label, (latent[label] @ mix + d + rng.normal(size=3) * 0.02).tolist()))
    df = spark.createDataFrame(rows, "row_id long, domain int, label int, x array<double>")
    out, facts = C.anchor_alignment(df, mode=mode, components=3, regularization=1e-6)
    assert facts["n_anchors"] == 8 and facts["likeness_after"] > max(0.98, facts["likeness_before"])
    got = {}
    for r in out.collect():
        got.setdefault((r["domain"], r["label"]), []).append(r["x"])
    means = {k: np.mean(v, axis=0) for k, v in got.items()}
    spread = np.std([means[0, k] for k in range(8)], axis=0)
    for d in range(1, 4):
        assert max(np.abs((means[d, k] - means[0, k]) / spread).max() for k in range(8)) < 0.35
    if mode == "mcca":
        assert np.vstack([means[d, k] for d in range(4) for k in range(8)]).std(axis=0) == pytest.approx(1.0)
