"""Ensembles that learn from held-out rows: weights of response windows, pairwise reranking, feature subspaces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.sources.observations import cut

from . import features as T

EPS = 1e-12


def simplex(n: int, step: float) -> list[tuple[float, ...]]:
    """Weights of ``n`` members on a grid of ``step`` that sum to one (those within half a step are scaled), in order."""
    if n < 1 or not step > 0:
        raise ValueError("a grid takes one member at least and a positive step")
    levels = np.arange(0.0, 1.0 + step / 2, step)
    points = {tuple(np.round(np.array(w) / sum(w), 12)) for w in product(levels, repeat=n) if abs(sum(w) - 1.0) <= step / 2} if n > 1 else {(1.0,)}
    if not points:
        raise ValueError(f"no weights lie on a grid of {step}")
    return sorted(tuple(map(float, w)) for w in points)


def window_cube(df: DataFrame, sequence: Sequence[str], times: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """(sequence, keep, cube): for each sequence the ``p`` nearest to each of ``times``, the earlier of equals."""
    rows = df.withColumn("_at", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    near = rows.groupBy(*sequence, *keep, "_at").agg(F.min_by("p", F.struct(F.abs(F.col("time") - F.col("_at")), F.col("time"))).alias("p"))
    packed = near.groupBy(*sequence, *keep).agg(F.array_sort(F.collect_list(F.struct("_at", "p"))).alias("_c"))
    return packed.where(F.size("_c") == len(set(times))).select(*sequence, *keep, F.transform("_c", lambda c: c["p"]).alias("cube"))


def _pooled(cube: np.ndarray, weights: np.ndarray, log: bool) -> np.ndarray:
    """Pools (rows, points of the grid, classes) of a cube (rows, members, classes)."""
    if not log:
        return np.einsum("ntk,wt->nwk", cube, weights)
    z = np.einsum("ntk,wt->nwk", np.log(np.clip(cube, EPS, 1.0)), weights)
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def searched_weights(cube: DataFrame, domain: str, label: str, step: float = 0.1, log: bool = True) -> DataFrame:
    """(domain, weights, score): for each domain the first weights on the grid with the best balanced accuracy
    on the rows of all other domains; even weights and no score where there is no other.

    One pass: a row gives a vector of hits, one for each point of the grid, and tasks send these added up by
    domain and label. A domain's search takes the totals less its own."""
    members = cube.select(F.size("cube").alias("n")).agg(F.max("n").alias("n"), F.min("n").alias("least")).first()
    if members.n is None or members.n != members.least:
        raise ValueError("every sequence needs the same members")
    grid = np.array(simplex(members.n, step))
    types = dict(cube.dtypes)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                p = np.stack([np.stack(c) for c in part["cube"]])
                best = _pooled(p, grid, log).argmax(axis=2) == part[label].to_numpy()[:, None]
                for (d, y), places in part.groupby([domain, label], sort=False).indices.items():
                    rows.append((d, y, len(places), best[places].sum(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=[domain, label, "n", "hits"])

    sums = cube.select(domain, label, "cube").mapInPandas(hits, f"{domain} {types[domain]}, {label} {types[label]}, n long, hits array<long>")
    counts = sums.groupBy(domain, label).agg(F.sum("n").alias("n"))
    long = sums.select(domain, label, F.posexplode("hits").alias("w", "h")).groupBy(domain, label, "w").agg(F.sum("h").alias("h"))
    own = cut(long.join(counts, [domain, label]), "window-weights")
    every = own.groupBy(label, "w").agg(F.sum("h").alias("_h"), F.sum("n").alias("_n"))
    # tables of domains by labels by points of the grid
    names = own.agg(F.collect_set(domain).alias("_d"))
    all_pairs = every.join(F.broadcast(names)).withColumn(domain, F.explode("_d"))  # one row
    rest = all_pairs.join(own, [domain, label, "w"], "left").select(domain, "w", (F.col("_h") - F.coalesce("h", F.lit(0))).alias("h"), (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"))
    scores = rest.groupBy(domain, "w").agg(F.round(F.avg(F.when(F.col("n") > 0, F.col("h") / F.col("n"))), 12).alias("score"))
    best = scores.groupBy(domain).agg(F.max_by("w", F.struct(F.coalesce("score", F.lit(-1.0)), (-F.col("w")).alias("w"))).alias("w"), F.max("score").alias("score"))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in grid])
    even = F.array(*[F.lit(1.0 / members.n)] * members.n)
    return best.select(domain, F.when(F.col("score").isNull(), even).otherwise(F.get(table, F.col("w"))).alias("weights"), "score")


def response_window_ensemble(df: DataFrame, sequence: Sequence[str], times: Sequence[float], domain: str, label: str, step: float = 0.1, log: bool = True) -> DataFrame:
    """(sequence, domain, label, p, weights): the windows nearest to ``times`` pooled under the weights that the
    other domains' rows choose."""
    cube = cut(window_cube(df, sequence, times, [domain, label]), "window-cube")
    both = cube.join(searched_weights(cube, domain, label, step, log), domain)
    part = F.transform(F.arrays_zip("cube", "weights"), lambda m: F.transform(m["cube"], lambda x: (F.log(F.least(F.lit(1.0), F.greatest(x, F.lit(EPS)))) if log else x) * m["weights"]))
    pooled = F.aggregate(F.slice("_parts", F.lit(2), F.size("_parts")), F.get("_parts", F.lit(0)), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
    rows = both.withColumn("_parts", part)
    return rows.select(*sequence, domain, label, (P.softmax(pooled) if log else P.normalized(pooled)).alias("p"), "weights")


# pairwise reranking


def _margins(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, EPS, 1.0))


def pairwise_models(df: DataFrame, label: str, n_classes: int, c: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Constants and slopes (classes by classes, upper half) of class-balanced logistic models of class i against j on
    log p_i - log p_j, with a ridge of 1 / ``c`` on slopes. A row takes part in the pairs of its class. Each Newton
    step is one job for all pairs; a pair without both classes, or without spread, gets zeros."""
    k = n_classes
    i, j = np.triu_indices(k, 1)
    rows = cut(df.select("p", F.col(label).cast("int").alias("y")), "pairs")

    def sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By pair: rows of each class, margins and their squares, two gradients and three second derivatives."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(i), 9))
            for pdf in batches:
                z, y = _margins(np.stack(pdf["p"].to_list())), pdf["y"].to_numpy()
                for own in np.unique(y):
                    at = z[y == own]
                    for n in np.flatnonzero((i == own) | (j == own)):
                        m, t = at[:, i[n]] - at[:, j[n]], float(own == i[n])
                        q = 1.0 / (1.0 + np.exp(-np.clip(a[n] + b[n] * m, -500, 500)))
                        w = weight[n, int(own == j[n])]
                        r, h = w * (q - t), w * q * (1 - q)
                        total[n] += [len(m) * t, len(m) * (1 - t), m.sum(), (m * m).sum(), r.sum(), (r * m).sum(), h.sum(), (h * m).sum(), (h * m * m).sum()]
            yield pd.DataFrame({"pair": np.repeat(np.arange(len(i)), 9), "at": np.tile(np.arange(9), len(i)), "v": total.ravel()})

        out = np.zeros((len(i), 9))
        for r in rows.mapInPandas(partial, "pair int, at int, v double").groupBy("pair", "at").agg(F.sum("v").alias("v")).collect():
            out[r.pair, r.at] = r.v
        return out

    a, b = np.zeros(len(i)), np.zeros(len(i))
    s = sums(a, b, np.zeros((len(i), 2)))
    n = s[:, 0] + s[:, 1]
    spread = np.divide(s[:, 3], n, out=np.zeros(len(i)), where=n > 0) - np.divide(s[:, 2], n, out=np.zeros(len(i)), where=n > 0) ** 2
    live = (s[:, 0] > 0) & (s[:, 1] > 0) & (spread > 1e-24)
    weight = np.divide(n[:, None], 2 * s[:, :2], out=np.zeros((len(i), 2)), where=s[:, :2] > 0)
    for _ in range(rounds):
        s = sums(a, b, weight)
        g, gm, h, hm, hmm = s[:, 4], s[:, 5] + b / c, s[:, 6], s[:, 7], s[:, 8] + 1.0 / c
        det = h * hmm - hm * hm
        move = live & (det > 0) & (np.maximum(np.abs(g), np.abs(gm)) > tolerance)
        if not move.any():
            break
        safe = np.where(move, det, 1.0)
        step_a, step_b = np.where(move, (hmm * g - hm * gm) / safe, 0.0), np.where(move, (h * gm - hm * g) / safe, 0.0)
        limit = np.minimum(1.0, 5.0 / np.maximum(np.maximum(np.abs(step_a), np.abs(step_b)), 1e-300))
        a, b = a - limit * step_a, b - limit * step_b
    constants, slopes = np.zeros((k, k)), np.zeros((k, k))
    constants[i, j], slopes[i, j] = a, b
    return constants, slopes


def _reranked(p: np.ndarray, constants: np.ndarray, slopes: np.ndarray, top: int, alpha: float) -> np.ndarray:
    z = _margins(p)
    k = z.shape[1]
    best = np.lexsort((np.broadcast_to(np.arange(k), z.shape), -z), axis=1)[:, :top]  # the lower class of equals
    inside = np.zeros(z.shape, dtype=bool)
    np.put_along_axis(inside, best, True, axis=1)
    logit = np.triu(constants, 1) + np.triu(slopes, 1) * (z[:, :, None] - z[:, None, :])
    logit = np.where(np.triu(np.ones((k, k), dtype=bool), 1) & inside[:, :, None] & inside[:, None, :], logit, 0.0)
    s = z + alpha * (logit.sum(axis=2) - logit.sum(axis=1)) / max(top - 1, 1)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pairwise_reranked(fit: DataFrame, rows: DataFrame, label: str, n_classes: int, top_k: int = 3, alphas: Sequence[float] = (0.0, 0.25, 0.5, 1.0, 2.0)) -> tuple[DataFrame, float]:
    """``rows`` whose scores of the ``top_k`` classes are moved by one-against-one models of these classes, which
    ``fit``'s held-out probabilities (p, label) train; how far is the first of ``alphas`` that has the best balanced
    accuracy on ``fit``, and 0 unless one is better than no move. Returns the rows and that number."""
    top = min(top_k, n_classes)
    if top < 2:
        return rows, 0.0
    constants, slopes = pairwise_models(fit, label, n_classes)
    tried = [0.0, *[float(a) for a in alphas if a != 0.0]]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            p, y = np.stack(pdf["p"].to_list()), pdf["y"].to_numpy()
            hit = np.stack([(_reranked(p, constants, slopes, top, a) if a else p).argmax(axis=1) == y for a in tried], axis=1)
            for c in np.unique(y):
                total[int(c)] = total.get(int(c), 0) + np.concatenate([[(y == c).sum()], hit[y == c].sum(axis=0)])
        yield pd.DataFrame([(c, n, int(v)) for c, t in total.items() for n, v in enumerate(t)], columns=["c", "n", "v"])

    counts = fit.select("p", F.col(label).cast("int").alias("y")).mapInPandas(counted, "c int, n int, v long").groupBy("c", "n").agg(F.sum("v").alias("v")).collect()
    by: dict[int, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r.c, {})[r.n] = r.v
    scores = [float(np.mean([t[n + 1] / t[0] for t in by.values()])) for n in range(len(tried))]
    best = 0
    for n, s in enumerate(scores):
        best = n if s > scores[best] + 1e-12 else best
    if not tried[best]:
        return rows, 0.0

    return rows.withColumn("p", _moved_scores(F.col("p"), constants, slopes, top, tried[best])), tried[best]


def _moved_scores(p: Column, constants: np.ndarray, slopes: np.ndarray, top: int, alpha: float) -> Column:
    """As ``_reranked``, for a column: pairs of classes in either order, so constants change their sign."""
    table = lambda m: F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in m])
    both, slope = table(np.triu(constants, 1) - np.triu(constants, 1).T), table(np.triu(slopes, 1) + np.triu(slopes, 1).T)
    logs = F.transform(p, lambda x: F.log(F.least(F.lit(1.0), F.greatest(x, F.lit(EPS)))))
    best = F.transform(F.slice(P.ranking(p), 1, top), lambda r: r["class"])

    def moved(z: Column, classes: Column) -> Column:
        def pull(i: Column, own: Column) -> Column:
            others = F.filter(classes, lambda j: j != i)
            return F.aggregate(others, F.lit(0.0), lambda s, j: s + F.get(F.get(both, i), j) + F.get(F.get(slope, i), j) * (own - F.get(z, j)))

        return F.transform(z, lambda own, i: F.when(F.array_contains(classes, i), own + F.lit(alpha / max(top - 1, 1)) * pull(i, own)).otherwise(own))

    return P.softmax(P.bound(logs, lambda z: P.bound(best, lambda classes: moved(z, classes))))


# feature subspaces


def subspace_columns(dim: int, members: int, fraction: float = 0.5, least: int = 1, seed: int = 0) -> np.ndarray:
    """For each member, which of ``dim`` columns it has: those with the smallest hashes of seed, member and column."""
    import hashlib

    size = min(dim, max(min(least, dim), int(round(dim * fraction))))
    keep = np.zeros((members, dim), dtype=bool)
    for m in range(members):
        drawn = sorted((hashlib.md5(f"{seed}:{m}:{c}".encode()).hexdigest()[:8], c) for c in range(dim))
        keep[m, [c for _, c in drawn[:size]]] = True
    return keep


def random_subspaces(train: DataFrame, test: DataFrame, members: int = 25, fraction: float = 0.5, seed: int = 0, temperature: float = 1.0, floor: float = 1e-12) -> DataFrame:
    """(row_id, label, p, predicted): the mean probability of nearest-centroid members, each on columns of its own.

    The members share the class means and deviations of all columns: a row's scaled squared differences are taken
    once and added up over each member's columns. The driver holds classes by columns."""
    means = sorted(T.class_means(train.select("label", "x"), ["label"]).collect(), key=lambda r: r.label)
    labels, m = [r.label for r in means], np.stack([np.array(r["mean"]) for r in means])
    if len(labels) < 2:
        raise ValueError("an ensemble takes two classes at least")
    scale = np.array(T.arrays(T.positions(train.select("x")).groupBy("pos").agg(F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(floor)).alias("scale")), ["scale"]).first()["scale"])
    keep = subspace_columns(m.shape[1], members, fraction, 1, seed).astype(float).T

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(x), 1024):
            rows = np.stack(x.iloc[at : at + 1024].to_list())
            d = ((rows[:, None, :] - m) / scale) ** 2 @ keep  # rows, classes, members
            z = -d / temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out += list((e / e.sum(axis=1, keepdims=True)).mean(axis=2))
        return pd.Series(out, dtype=object)

    rows = test.withColumn("p", apply("x"))
    return rows.select("row_id", "label", "p", F.get(F.array(*[F.lit(v) for v in labels]), P.predicted_index(F.col("p"))).alias("predicted"))


# models of source domains

WEIGHTINGS = ("uniform", "target_confidence", "target_entropy", "target_feature_similarity")


def domain_ensemble(df: DataFrame, weighting: str = "uniform", temperature: float = 1.0, least_classes: int = 2, domain: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Target rows (row_id, p, predicted) under one centroid model for each source domain that has ``least_classes``
    classes, and the (domain, weight) of these: equal, or the softmax over ``temperature`` of their mean confidence
    on the target, of minus their mean entropy there, or of minus the distance of mean and covariance to the target's."""
    from chronoprob.functions.vectors import squared_distance

    if weighting not in WEIGHTINGS:
        raise ValueError(f"no such weighting: {weighting}")
    source, target = df.where("role = 'source'"), df.where("role = 'target'")
    means = T.class_means(source.select(domain, "label", "x"), [domain, "label"])
    models = means.groupBy(domain).agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("means")).where(F.size("means") >= least_classes)
    labels = [r.label for r in source.select("label").distinct().orderBy("label").collect()]
    packed = models.groupBy().agg(F.collect_list(F.struct(domain, "means")).alias("_m"))  # one row
    rows = target.select("row_id", "x").join(F.broadcast(packed)).select("row_id", "x", F.inline("_m"))
    score = F.transform(F.array(*[F.lit(v) for v in labels]), lambda y: F.coalesce(-squared_distance(F.col("x"), F.try_element_at("means", y)), F.lit(-1e30)))
    own = cut(rows.select("row_id", domain, P.softmax(score).alias("p")), "domain-ensemble")
    if weighting == "target_feature_similarity":
        t = T.moments(target).first()
        d = len(t.s)

        def shape(n: int, s: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return s / n, (xx.reshape(d, d) - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros((d, d))

        mean, cov = shape(t.n, np.array(t.s), np.array(t.xx))

        @F.pandas_udf("double")
        def near(n: pd.Series, s: pd.Series, xx: pd.Series) -> pd.Series:
            out = []
            for a, b, c in zip(n, s, xx):
                m, v = shape(a, np.asarray(b), np.asarray(c))
                out.append(-(np.linalg.norm(m - mean) / np.sqrt(d) + np.linalg.norm(v - cov) / d))
            return pd.Series(out, dtype="float64")

        scores = T.moments(source, [domain]).join(models.select(domain), domain).select(domain, near("n", "s", "xx").alias("score"))
    else:
        p = F.col("p")
        by = {"uniform": F.lit(0.0), "target_confidence": F.avg(P.confidence(p)), "target_entropy": -F.avg(P.entropy(p, eps=EPS))}[weighting]
        scores = own.groupBy(domain).agg(F.max(F.lit(1)), by.alias("score"))
    every = Window.partitionBy()  # a row for each domain
    e = F.exp(F.greatest(F.lit(-50.0), (F.col("score") - F.max("score").over(every)) / temperature))
    weights = cut(scores.select(domain, e.alias("_e")).select(domain, (F.col("_e") / F.sum("_e").over(every)).alias("weight")), "domain-weights")
    long = own.join(weights, domain).select("row_id", F.posexplode("p").alias("k", "v"), "weight")
    sums = long.groupBy("row_id", "k").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    out = sums.groupBy("row_id").agg(P.normalized(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])).alias("p"))
    return out.withColumn("predicted", F.get(F.array(*[F.lit(v) for v in labels]), P.predicted_index(F.col("p")))), weights
