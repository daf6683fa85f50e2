"""Linear softmax models, fitted many at a time by sums of gradients.

All models of a call are fitted in lockstep: a step is one job, in which each task multiplies its rows with the
coefficients of all models that are still moving, and sends losses and gradients added up over its rows. What a
model trains on is a weight for each fold and class, so folds, held-out domains, class balance and settings copy no
row; location and scale of the columns are part of the coefficients, so rows are read as they are. Models that have
converged leave the jobs. The driver holds coefficients and their history, as many as models, features and classes.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.sources.observations import cut

from . import features as T

#: Rows that a task multiplies at a time, and rows that sums of tasks are gathered in before the driver.
CHUNK, GATHERED = 2048, 16
LEAST = 1e-12


@dataclass(frozen=True)
class Table:
    """Rows as (x, y, g): features, and the numbers of label and fold; counts, sums and squares by fold."""

    rows: DataFrame
    labels: list
    folds: list
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    def scale(self, use: np.ndarray, ddof: int = 0, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the columns over the folds of the mask ``use``: totals of folds, no rows."""
        n = self.counts[use].sum()
        mean = self.sums[use].sum(axis=0) / n
        deviation = np.sqrt(np.maximum(self.squares[use].sum(axis=0) / n - mean**2, 0.0) * n / max(1, n - ddof))
        return mean, np.maximum(deviation, floor) if floor is not None else np.where(deviation > 0, deviation, 1.0)


def tabled(df: DataFrame, fold: str | None, label: str = "label") -> Table:
    """``df`` (x, label and fold) for fits; labels and folds become numbers in their order. One row for each
    fold, label and column reaches the driver."""
    f = F.lit(0) if fold is None else F.col(fold)
    rows = df.select("x", F.col(label).alias("label"), f.alias("fold"))
    counts = rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    labels, folds = sorted({r.label for r in counts}), sorted({r.fold for r in counts})
    place = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1
    numbered = cut(rows.select("x", place("label", labels).alias("y"), place("fold", folds).alias("g")), "fit-rows")
    n = np.zeros((len(folds), len(labels)))
    for r in counts:
        n[folds.index(r.fold), labels.index(r.label)] = r.n
    by = T.positions(numbered.select("g", "x")).groupBy("g", "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect()
    d = 1 + max(r.pos for r in by)
    s, q = np.zeros((len(folds), d)), np.zeros((len(folds), d))
    for r in by:
        s[r.g, r.pos], q[r.g, r.pos] = r.s, r.q
    return Table(numbered, labels, folds, n, s, q)


@dataclass(frozen=True)
class Fit:
    """One model: the weight of a row by fold and class (none: it is not trained on), the columns' location and
    scale, the coefficients' ridge, whether the last class is the reference (coefficients of 0), and, for risk
    extrapolation, the weight of the variance of the folds' losses."""

    weight: np.ndarray
    location: np.ndarray
    scale: np.ndarray
    ridge: float
    reference: bool = False
    variance: float | None = None

    def free(self) -> int:
        return self.weight.shape[1] - self.reference

    def raw(self, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and constants for rows as they are; classes without weight get no probability."""
        d, k = len(self.location), self.free()
        w, b = parameters[: d * k].reshape(d, k), parameters[d * k :]
        a = np.zeros((d, self.weight.shape[1]))
        a[:, :k] = w / self.scale[:, None]
        c = np.zeros(self.weight.shape[1])
        c[:k] = b - (self.location / self.scale) @ w
        return a, np.where(self.weight.sum(axis=0) > 0, c, -1e30)

    def value(self, parameters: np.ndarray, loss: np.ndarray, by_x: np.ndarray, by_one: np.ndarray) -> tuple[float, np.ndarray]:
        """Objective and gradient from each fold's loss and its sums of residuals times features, and alone."""
        d, k = len(self.location), self.free()
        g = np.concatenate([((by_x - self.location[:, None] * by_one[:, None, :]) / self.scale[:, None])[:, :, :k].reshape(len(loss), -1), by_one[:, :k]], axis=1)
        if self.variance is None:
            value, gradient = loss.sum(), g.sum(axis=0)
        else:
            away = loss - loss.mean()
            value = loss.mean() + self.variance * (away**2).mean()
            gradient = g.mean(axis=0) + 2 * self.variance * (away[:, None] * g).mean(axis=0)
        held = np.where(np.arange(len(parameters)) < d * k, parameters, 0.0)
        return float(value + self.ridge / 2 * (held**2).sum()), gradient + self.ridge * held


def minimised(start: np.ndarray, rounds: int, tolerance: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS with halved steps, as a generator: it yields points, is sent (value, gradient) of each,
    and returns the last point that it accepts."""
    x = start
    value, gradient = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max(initial=0.0) <= tolerance:
            break
        q, used = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        down = -q
        slope, step = gradient @ down, 1.0 if pairs else min(1.0, 1.0 / np.abs(gradient).sum())
        for _ in range(40):
            point = x + step * down
            there, turned = yield point
            if there <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break  # no descent left within rounding
        s, y = point - x, turned - gradient
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y)]
        x, value, gradient = point, there, turned
    return x


def _sums(table: Table, a: np.ndarray, b: np.ndarray, weight: np.ndarray, by_fold: bool) -> dict[int, np.ndarray]:
    """For each fold (or 0 for all), by model: the loss, sums of residuals times features, and of residuals."""
    m, d, k = a.shape
    flat = a.transpose(1, 0, 2).reshape(d, m * k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                pdf = batch.iloc[at : at + CHUNK]
                x, y, g = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy(), pdf["g"].to_numpy()
                z = (x @ flat).reshape(len(x), m, k) + b
                e = np.exp(z - z.max(axis=2, keepdims=True))
                p = e / e.sum(axis=2, keepdims=True)
                w = weight[:, g, y].T
                own = np.arange(len(x))
                loss = w * -np.log(np.maximum(p[own, :, y], LEAST))
                p[own, :, y] -= 1.0
                p *= w[:, :, None]
                for f in np.unique(g) if by_fold else [0]:
                    at_f = g == f if by_fold else slice(None)
                    by_x = (x[at_f].T @ p[at_f].reshape(-1, m * k)).reshape(d, m, k).transpose(1, 0, 2).reshape(m, d * k)
                    total[int(f)] = total.get(int(f), 0.0) + np.concatenate([loss[at_f].sum(axis=0)[:, None], by_x, p[at_f].sum(axis=0)], axis=1)
        yield pd.DataFrame({"f": list(total), "v": [t.tobytes() for t in total.values()]})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, v in zip(batch["f"], batch["v"]):
                total[int(f)] = total.get(int(f), 0.0) + np.frombuffer(v)
        yield pd.DataFrame({"f": list(total), "v": [t.tobytes() for t in total.values()]})

    out: dict[int, np.ndarray] = {}
    parts = table.rows.mapInPandas(partial, "f int, v binary").repartition(GATHERED).mapInPandas(gathered, "f int, v binary")
    for r in parts.collect():  # GATHERED rows for each fold
        out[r.f] = out.get(r.f, 0.0) + np.frombuffer(r.v).reshape(m, -1)
    return out


def fitted(table: Table, fits: dict, rounds: int = 100, tolerance: float = 1e-6) -> dict:
    """Coefficients and constants, for rows as they are, of each of ``fits``; a step is one job for all of them."""
    by_fold = any(f.variance is not None for f in fits.values())
    runs = {key: minimised(np.zeros((len(f.location) + 1) * f.free()), rounds, tolerance) for key, f in fits.items()}
    points, done = {key: next(run) for key, run in runs.items()}, {}
    while points:
        keys = list(points)
        raw = [fits[key].raw(points[key]) for key in keys]
        a, b = np.stack([r[0] for r in raw]), np.stack([r[1] for r in raw])
        found = _sums(table, a, b, np.stack([fits[key].weight for key in keys]), by_fold)
        d, k = a.shape[1:]
        for i, key in enumerate(keys):
            v = np.stack([found[f][i] for f in sorted(found)])
            value = fits[key].value(points[key], v[:, 0], v[:, 1 : 1 + d * k].reshape(len(v), d, k), v[:, 1 + d * k :])
            try:
                points[key] = runs[key].send(value)
            except StopIteration as end:
                done[key] = fits[key].raw(end.value)
                del points[key]
    return done


def probabilities(df: DataFrame, a: np.ndarray, b: np.ndarray, model: str | None = None) -> DataFrame:
    """``df`` with ``p``; ``a`` and ``b`` by model, whose number is in the column ``model`` (without: the only one)."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, at: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        out, rows, which = np.empty((len(x), b.shape[1])), np.stack(x.to_list()), at.to_numpy()
        for i in np.unique(which):
            out[which == i] = rows[which == i] @ a[i] + b[i]
        e = np.exp(out - out.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return df.withColumn("p", apply("x", F.lit(0) if model is None else F.col(model)))


def _balanced(counts: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights by fold and class that give each class of the folds in use the same total, one in all."""
    n = counts[use].sum(axis=0)
    share = np.divide(1.0, n * (n > 0).sum(), out=np.zeros_like(n), where=n > 0)
    return use[:, None] * share


def logistic(table: Table, use: np.ndarray, c: float) -> Fit:
    """Class-balanced logistic regression on standardized columns over the folds in use; ``c`` is the inverse of
    the ridge on coefficients for losses that add up to the number of rows."""
    return Fit(_balanced(table.counts, use), *table.scale(use), 1.0 / (c * table.counts[use].sum()))


def extrapolated_risk(train: DataFrame, test: DataFrame, domain: str = "domain", penalty: float = 1.0, ridge: float = 1e-4, balance: bool = True, rounds: int = 500, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Risk extrapolation: a linear softmax decoder that minimises the mean of the domains' losses and ``penalty``
    times their variance. Returns (row_id, label, p, predicted) of ``test``, and the (domain, risk) of ``train``."""
    t = tabled(train, domain)
    if len(t.labels) < 2 or len(t.folds) < 2:
        raise ValueError("risk extrapolation takes two classes and two domains at least")
    every = np.ones(len(t.folds), dtype=bool)
    by_class = _balanced(t.counts, every).max(axis=0) if balance else np.ones(len(t.labels))
    weight = by_class / (t.counts @ by_class)[:, None]
    fit = Fit(weight, *t.scale(every, 1, LEAST), ridge, True, penalty)
    a, b = fitted(t, {"risk": fit}, rounds, tolerance)["risk"]
    loss = _sums(t, a[None], b[None], weight[None], True)
    types = dict(train.dtypes)
    risks = train.sparkSession.createDataFrame([(t.folds[f], float(loss[f][0, 0])) for f in sorted(loss)], f"{domain} {types[domain]}, risk double")
    return _decided(probabilities(test, a[None], b[None]), t.labels).select("row_id", "label", "p", "predicted"), risks


def _decided(rows: DataFrame, labels: Sequence) -> DataFrame:
    return rows.withColumn("predicted", F.get(F.array(*[F.lit(v) for v in labels]), P.predicted_index(F.col("p"))))


def _validated(table: Table, models: list[tuple[int, np.ndarray, np.ndarray]], metric: str) -> list[float]:
    """The score of each (held-out fold, a, b) on the rows of its fold, all in one job. Counts of rows and hits
    by model and class are what tasks send."""
    of: dict[int, list[int]] = {}
    for i, (fold, _, _) in enumerate(models):
        of.setdefault(fold, []).append(i)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            x, y, g = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy(), pdf["g"].to_numpy()
            for f in np.unique(g):
                rows, true = x[g == f], y[g == f]
                for i in of.get(int(f), []):
                    hit = (rows @ models[i][1] + models[i][2]).argmax(axis=1) == true
                    for c in np.unique(true):
                        n[i, c] = n.get((i, c), 0) + np.array([(true == c).sum(), hit[true == c].sum()])
        yield pd.DataFrame([(i, int(c), int(v[0]), int(v[1])) for (i, c), v in n.items()], columns=["i", "c", "n", "hits"])

    counts = table.rows.mapInPandas(counted, "i int, c int, n long, hits long").groupBy("i", "c").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    by: dict[int, list] = {}
    for r in counts:
        by.setdefault(r.i, []).append((r.n, r.hits))
    if metric == "balanced_accuracy":
        return [float(np.mean([h / n for n, h in by[i]])) for i in range(len(models))]
    if metric == "accuracy":
        return [sum(h for _, h in by[i]) / sum(n for n, _ in by[i]) for i in range(len(models))]
    raise ValueError(f"no such metric: {metric}")


#: Inverse ridges that are tried unless others are given.
GRID = (0.01, 0.1, 1.0, 10.0, 100.0)


def tuned_logistic(train: DataFrame, test: DataFrame, fold: str, grid: Sequence[float] = GRID, metric: str = "accuracy", rounds: int = 100, tolerance: float = 1e-5) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Logistic decoder whose inverse ridge is the first best of ``grid`` by its mean score on held-out folds.
    Returns (row_id, label, p, predicted) of ``test``, and each of the grid with its score."""
    t = tabled(train, fold)
    folds = range(len(t.folds))
    fits = {(f, c): logistic(t, np.arange(len(t.folds)) != f, c) for f in folds for c in grid}
    made = fitted(t, fits, rounds, tolerance)
    scores = _validated(t, [(f, *made[f, c]) for f, c in fits], metric)
    mean = {c: float(np.mean([s for (_, d), s in zip(fits, scores) if d == c])) for c in grid}
    best = max(grid, key=lambda c: mean[c])
    a, b = fitted(t, {"all": logistic(t, np.ones(len(t.folds), dtype=bool), best)}, rounds, tolerance)["all"]
    return _decided(probabilities(test, a[None], b[None]), t.labels).select("row_id", "label", "p", "predicted"), list(mean.items())


def nested_leave_one_out(df: DataFrame, domain: str = "domain", grid: Sequence[float] = GRID, metric: str = "balanced_accuracy", rounds: int = 100, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Each domain's rows under the logistic decoder of the other domains; its inverse ridge is the first best of
    ``grid`` by the mean score of these domains, each left out in turn as well. The inner model without domains
    a and b serves both, so there is one for each pair, fitted together. Returns (row_id, domain, label, p,
    predicted), and (domain, inner, c, score, chosen) of the inner scores."""
    t = tabled(df, domain)
    n = len(t.folds)
    if n < 3:
        raise ValueError("inner selection takes three domains at least")
    without = lambda *out: ~np.isin(np.arange(n), out)
    pairs = [(i, j, c) for i in range(n) for j in range(i + 1, n) for c in grid]
    made = fitted(t, {k: logistic(t, without(*k[:2]), k[2]) for k in pairs}, rounds, tolerance)
    tried = [(o, i, c) for o in range(n) for i in range(n) if i != o for c in grid]
    scores = dict(zip(tried, _validated(t, [(i, *made[min(o, i), max(o, i), c]) for o, i, c in tried], metric)))
    best = {o: max(grid, key=lambda c: np.mean([scores[o, i, c] for i in range(n) if i != o])) for o in range(n)}
    outer = fitted(t, {o: logistic(t, without(o), best[o]) for o in range(n)}, rounds, tolerance)
    at = F.array_position(F.array(*[F.lit(v) for v in t.folds]), F.col(domain)).cast("int") - 1
    rows = probabilities(df.withColumn("_model", at), np.stack([outer[o][0] for o in range(n)]), np.stack([outer[o][1] for o in range(n)]), "_model")
    kind = dict(df.dtypes)[domain]
    inner = df.sparkSession.createDataFrame([(t.folds[o], t.folds[i], float(c), scores[o, i, c], best[o] == c) for o, i, c in tried], f"{domain} {kind}, inner {kind}, c double, score double, chosen boolean")
    return _decided(rows, t.labels).select("row_id", domain, "label", "p", "predicted"), inner
