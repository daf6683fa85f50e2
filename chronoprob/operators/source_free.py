"""Adaptation to unlabelled target rows by a fitted model's probabilities alone, for many settings at once.

Rows whose label is taken on trust make a mean for each class, distances to the means make probabilities, and
these are pooled with the model's own, in rounds. A setting says which rows are trusted, how much the means count,
and how the rows' mean probability is corrected. Of a grid of settings the one is taken whose probabilities have
the best shape (even classes, many of them found, sure rows); a consensus pools several.

A row's probabilities follow from its features, its start and the means of the last round, so that no table of
rows is carried from round to round: a round is one pass (two where rows are chosen by rank) for all settings that
go on, and adds up as many numbers as there are settings, classes and features, which are what the driver holds.
Ranked choice keeps ``per_class`` rows for each setting and class of a partition, then of all; that number is meant
to be small.

Defined cases: rows without features or probabilities take no part; of equal probabilities the first class is
taken, of equally sure rows the smallest row_id; rows that repeat count as often; an empty table has no rows to
adapt and gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features as T

EPS = 1e-12
SELECTIONS = ("confidence", "balanced_topk")
ESTIMATORS = ("mean", "confidence_weighted", "entropy_weighted")


@dataclass(frozen=True)
class Setting:
    """``selection``: all rows of at least ``threshold`` (confidence), or the surest ``per_class`` of each class among
    them, or, where fewer than ``least_rows`` are that sure, among all (balanced_topk). ``prior_strength`` 0 leaves
    the mean probability as it is."""

    threshold: float = 0.75
    weight: float = 0.5
    selection: str = "confidence"
    per_class: int | None = None
    rounds: int = 5
    least_rows: int = 1
    least_classes: int = 2
    temperature: float = 1.0
    prior_strength: float = 0.0
    estimator: str = "mean"
    smoothing: float = 0.0
    floor: float = 0.0

    def __post_init__(self) -> None:
        if self.selection not in SELECTIONS or self.estimator not in ESTIMATORS:
            raise ValueError(f"no such selection or estimator: {self.selection}, {self.estimator}")
        if not all(0 <= v <= 1 for v in (self.threshold, self.weight, self.prior_strength, self.smoothing)):
            raise ValueError("threshold, weight, prior_strength and smoothing lie between 0 and 1")
        if self.rounds < 0 or self.least_rows < 1 or self.least_classes < 1 or self.temperature <= 0 or (self.per_class or 1) < 1:
            raise ValueError("numbers of rounds, rows and classes are whole and not negative, temperature is positive")

    def means(self) -> Setting:
        """The part that the means depend on."""
        return replace(self, prior_strength=0.0, estimator="mean", smoothing=0.0, floor=0.0)

    def top(self) -> int:
        return max(self.least_rows, self.per_class or self.least_rows)


@dataclass
class Found:
    """Means by class (NaN where a class has none, None before the first round) and how the rounds ended."""

    means: np.ndarray | None = None
    active: int = 0
    rounds: int = 0
    stop: str = "max_iterations"


def tabled(df: DataFrame, start: DataFrame, standardize: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(row_id, x, p) as a table, and the shift and scale of its features."""
    from chronoprob.sources.observations import cut

    both = df.where("x is not null").select("row_id", "x").join(start.where("p is not null").select("row_id", "p"), "row_id")
    rows = cut(both, "source-free")
    stats = T.positions(rows).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("pos").collect()  # features
    shift, scale = np.array([r.m for r in stats], float), np.array([r.s for r in stats], float)
    return (rows, shift, np.where(scale < EPS, 1.0, scale)) if standardize else (rows, 0 * shift, 0 * scale + 1)


def _normal(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.0, None)
    return p / p.sum(axis=1, keepdims=True)


def _softmax(scores: np.ndarray) -> np.ndarray:
    below = scores - scores.max(axis=1, keepdims=True)
    e = np.where(np.isfinite(below), np.exp(np.maximum(below, -50.0)), 0.0)
    return e / e.sum(axis=1, keepdims=True)


def posterior(x: np.ndarray, start: np.ndarray, means: np.ndarray | None, s: Setting) -> np.ndarray:
    """Rows' probabilities: the start, or its logs pooled with those of the distances to the means."""
    if means is None:
        return start
    near = _softmax(np.stack([np.full(len(x), -np.inf) if np.isnan(m[0]) else -np.mean((x - m) ** 2, axis=1) / s.temperature for m in means], axis=1))
    logs = [np.log(np.clip(p, EPS, 1.0)) for p in (start, near)]
    return _softmax((1 - s.weight) * logs[0] + s.weight * logs[1])


def _arrays(batch: pd.DataFrame, shift: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.stack(batch["x"].to_list()).astype(float) - shift) / scale, _normal(np.stack(batch["p"].to_list()).astype(float))


def _marks(hashes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """64 bits for each (row, label)."""
    h = hashes.astype(np.int64).view(np.uint64) ^ ((labels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _pieces(marks: np.ndarray) -> list[float]:
    """Sums of the four 16-bit pieces: exact as doubles, and the same in any order of rows."""
    return [float(((marks >> np.uint64(16 * k)) & np.uint64(0xFFFF)).sum()) for k in range(4)]


#: Places in a class's sums: rows, rows sure enough, weights, rows that changed, four pieces of marks, then features.
N, SURE, WEIGHT, CHANGED, MARKS, FEATURES = 0, 1, 2, 3, 4, 8


def _sums(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, going: dict[int, tuple[Setting, np.ndarray | None, np.ndarray | None]], n_classes: int) -> np.ndarray:
    """settings x classes x places: one pass for all settings in ``going`` (setting, means, means before)."""
    order = list(going)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(order), n_classes, FEATURES + len(shift)))
        for batch in batches:
            if not len(batch):
                continue
            x, start = _arrays(batch, shift, scale)
            for k, i in enumerate(order):
                s, means, before = going[i]
                p = posterior(x, start, means, s)
                label, conf = p.argmax(axis=1), p.max(axis=1)
                changed = label != posterior(x, start, before, s).argmax(axis=1) if means is not None else np.ones(len(x), bool)
                sure = conf >= s.threshold
                marks = _marks(batch["h"].to_numpy(), label)
                for c in np.unique(label):
                    own, use = label == c, (label == c) & sure
                    w = np.clip(conf[use], EPS, None)
                    out[k, c] += np.concatenate([[own.sum(), use.sum(), w.sum(), changed[own].sum()], _pieces(marks[use]), w @ x[use]])
        flat = out.ravel()
        some = np.flatnonzero(flat)
        yield pd.DataFrame({"at": some, "v": flat[some]})

    out = np.zeros(len(order) * n_classes * (FEATURES + len(shift)))
    for r in rows.withColumn("h", F.xxhash64("row_id")).mapInPandas(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]  # settings times classes times features
    return out.reshape(len(order), n_classes, -1)


def _surest(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, going: dict, sums: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """``sums`` of settings with ranked choice, of the rows chosen: the surest of each partition, then of all."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x, start = _arrays(batch, shift, scale)
            for i, (s, means, _) in going.items():
                p = posterior(x, start, means, s)
                label, conf = p.argmax(axis=1), p.max(axis=1)
                for c in np.unique(label):
                    own = np.flatnonzero(label == c)
                    new = pd.DataFrame({"i": i, "c": c, "conf": conf[own], "row_id": batch["row_id"].to_numpy()[own], "h": batch["h"].to_numpy()[own], "z": list(x[own])})
                    kept = pd.concat([best[i, c], new]) if (i, c) in best else new
                    best[i, c] = kept.sort_values(["conf", "row_id"], ascending=[False, True], kind="stable").head(s.top())
        yield from best.values()

    ids = rows.schema["row_id"].dataType.simpleString()
    found = rows.withColumn("h", F.xxhash64("row_id")).mapInPandas(candidates, f"i int, c int, conf double, row_id {ids}, h long, z array<double>")
    most = max(s.top() for s, _, _ in going.values())
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("i", "c").orderBy(F.col("conf").desc(), "row_id"))).where(F.col("n") <= most)
    out = {i: sums[i].copy() for i in going}
    for i in going:
        out[i][:, [N, WEIGHT, *range(MARKS, out[i].shape[1])]] = 0
    for r in ranked.collect():  # ``per_class`` times classes times settings
        s = going[r.i][0]
        enough = sums[r.i][r.c][SURE] >= s.least_rows
        if r.n <= s.top() and (r.conf >= s.threshold or not enough):
            w = max(r.conf, EPS)
            out[r.i][r.c] += np.concatenate([[1, 0, w, 0], _pieces(_marks(np.array([r.h]), np.array([r.c]))), w * np.array(r.z)])
    return out


def adapted(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, n_classes: int, settings: Sequence[Setting]) -> list[Found]:
    """The means of each setting. A setting stops when a choice of rows comes again, no label changes, nothing is
    chosen, too few classes have rows, or its rounds are done."""
    found = [Found() for _ in settings]
    before: list[np.ndarray | None] = [None] * len(settings)
    seen: list[set] = [set() for _ in settings]
    going = []
    for i, s in enumerate(settings):
        if s.rounds == 0 or s.weight == 0.0:
            found[i].stop = "prototype_adaptation_disabled"
        else:
            going.append(i)
    while going:
        now = {i: (settings[i], found[i].means, before[i]) for i in going}
        sums = dict(zip(now, _sums(rows, shift, scale, now, n_classes)))
        ranked = {i: v for i, v in now.items() if v[0].selection == "balanced_topk"}
        chosen = {i: np.where(np.arange(sums[i].shape[1]) == N, sums[i][:, [SURE]], sums[i]) for i in going}
        if ranked:
            chosen |= _surest(rows, shift, scale, ranked, sums)
        for i in list(now):
            s, f = settings[i], found[i]
            mark = tuple(chosen[i][:, N]) + tuple(chosen[i][:, MARKS:FEATURES].ravel())
            if f.means is not None and sums[i][:, CHANGED].sum() == 0:
                f.stop = "selection_unchanged"
            elif f.rounds == s.rounds:
                f.stop = "max_iterations"
            elif mark in seen[i]:
                f.stop = "selection_repeated"
            else:
                seen[i].add(mark)
                active = chosen[i][:, N] >= s.least_rows
                f.active = int(active.sum())
                if f.active >= s.least_classes and chosen[i][:, N].sum() > 0:
                    before[i], f.rounds = f.means, f.rounds + 1
                    f.means = np.where(active[:, None], chosen[i][:, FEATURES:] / np.where(active, chosen[i][:, WEIGHT], 1.0)[:, None], np.nan)
                    continue
                f.stop = "none_selected" if chosen[i][:, N].sum() == 0 else "insufficient_active_classes"
            going.remove(i)
    return found


def _entropies(p: np.ndarray, eps: float = EPS) -> np.ndarray:
    """Relative entropies of rows raised to ``eps``."""
    q = np.clip(p, eps, None)
    q = q / q.sum(axis=1, keepdims=True)
    return -(q * np.log(q)).sum(axis=1) / np.log(p.shape[1])


def _trust(p: np.ndarray, estimator: str) -> np.ndarray:
    """Weights of rows in the mean probability."""
    if estimator == "mean":
        return np.ones(len(p))
    w = p.max(axis=1) if estimator == "confidence_weighted" else 1.0 + (p * np.log(np.clip(p, EPS, 1.0))).sum(axis=1) / np.log(p.shape[1])
    return np.clip(w, EPS, None)


def _added(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, count: int, width: int, of) -> np.ndarray:
    """Sums over all rows of ``of(k, x, start)``, ``width`` numbers a row, for k below ``count``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((count, width))
        for batch in batches:
            if len(batch):
                x, start = _arrays(batch, shift, scale)
                out += np.stack([of(k, x, start).sum(axis=0) for k in range(count)])
        yield pd.DataFrame({"at": np.arange(out.size), "v": out.ravel()})

    out = np.zeros(count * width)
    for r in rows.select("x", "p").mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(count, width)


def _corrected(p: np.ndarray, prior: np.ndarray | None, strength: float) -> np.ndarray:
    return p if prior is None else _normal(p / prior**strength)


@dataclass
class Models:
    """Settings with their means and priors (None where nothing is corrected): what tasks need."""

    settings: list[Setting]
    found: list[Found]
    priors: list[np.ndarray | None]

    def probabilities(self, k: int, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        s = self.settings[k]
        return _corrected(posterior(x, start, self.found[k].means, s), self.priors[k], s.prior_strength)


@dataclass
class Adaptation:
    """The rows, the shift and scale of their features, and the models with their shapes over the rows."""

    rows: DataFrame
    shift: np.ndarray
    scale: np.ndarray
    models: Models
    #: For each setting the mean probability, then the mean relative entropy and the mean confidence of rows.
    shapes: np.ndarray


def adaptation(df: DataFrame, start: DataFrame, settings: Sequence[Setting], standardize: bool = True) -> Adaptation | None:
    """All settings on the rows of ``df`` (row_id, x) from ``start`` (row_id, p); None where there are no rows.
    Settings that differ in the correction alone share their rounds."""
    rows, shift, scale = tabled(df, start, standardize)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("k")).first()
    if not facts.n:
        return None
    n, k = facts.n, facts.k
    kinds = list(dict.fromkeys(s.means() for s in settings))
    by_kind = dict(zip(kinds, adapted(rows, shift, scale, k, kinds)))
    found = [by_kind[s.means()] for s in settings]

    def own(i: int, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = posterior(x, start, found[i].means, settings[i])
        w = _trust(p, settings[i].estimator)[:, None]
        return np.hstack([w, w * p])

    priors: list[np.ndarray | None] = [None] * len(settings)
    if any(s.prior_strength for s in settings):
        for i, v in enumerate(_added(rows, shift, scale, len(settings), k + 1, own)):
            s = settings[i]
            if s.prior_strength:
                prior = np.maximum((1 - s.smoothing) * v[1:] / v[0] + s.smoothing / k, max(s.floor, EPS))
                priors[i] = prior / prior.sum()
    models = Models(list(settings), found, priors)

    def shape(i: int, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = models.probabilities(i, x, start)
        return np.hstack([p, _entropies(p)[:, None], p.max(axis=1)[:, None]])

    return Adaptation(rows, shift, scale, models, _added(rows, shift, scale, len(settings), k + 2, shape) / n)


def _rows_of(a: Adaptation, of) -> DataFrame:
    shift, scale = a.shift, a.scale

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"row_id": batch["row_id"], "p": list(of(*_arrays(batch, shift, scale)))})

    return a.rows.mapInPandas(apply, f"row_id {a.rows.schema['row_id'].dataType.simpleString()}, p array<double>")


def grid_settings(thresholds: Sequence[float] = (0.75,), weights: Sequence[float] = (0.5,), strengths: Sequence[float] = (0.0, 0.5, 1.0), selections: Sequence[str] = SELECTIONS, per_class: Sequence[int | None] = (None, 4), **same) -> list[Setting]:
    """All combinations; ``per_class`` counts for ranked choice alone."""
    every = product(thresholds, weights, strengths, selections, per_class)
    return [Setting(t, w, how, k, prior_strength=s, **same) for t, w, s, how, k in every if how != "confidence" or k is None]


def grid(df: DataFrame, start: DataFrame, settings: Sequence[Setting] | None = None, standardize: bool = True) -> tuple[DataFrame, list[dict]]:
    """(row_id, p) of the setting with the largest score, the first of equals, and all settings by falling score:
    evenness of the mean probability + half the share of classes found + a quarter of the mean confidence
    - a tenth of the rows' mean relative entropy."""
    settings = list(grid_settings() if settings is None else settings)
    if not settings:
        raise ValueError("no settings")
    a = adaptation(df, start, settings, standardize)
    if a is None:
        return start.select("row_id", "p").limit(0), []
    k = a.shapes.shape[1] - 2
    facts = []
    for i, s in enumerate(settings):
        even, mixed, sure = float(_entropies(a.shapes[i : i + 1, :k])[0]), float(a.shapes[i, k]), float(a.shapes[i, k + 1])
        found = a.models.found[i]
        share = found.active / k
        facts.append({"setting": i, "selection": s.selection, "per_class": s.per_class, "threshold": s.threshold, "weight": s.weight, "prior_strength": s.prior_strength, "score": even + 0.5 * share + 0.25 * sure - 0.1 * mixed, "marginal_entropy": even, "row_entropy": mixed, "confidence": sure, "active_fraction": share, "rounds": found.rounds, "stop": found.stop})
    ranked = sorted(facts, key=lambda f: -f["score"])
    best, models = ranked[0]["setting"], a.models
    return _rows_of(a, lambda x, p: models.probabilities(best, x, p)), ranked


#: The start as it is, ranked choice, and ranked choice with a careful correction of the mean probability.
VARIANTS = {
    "source_raw": Setting(rounds=0),
    "balanced_topk": Setting(selection="balanced_topk", per_class=4),
    "robust_prior": Setting(selection="balanced_topk", per_class=4, prior_strength=0.75, estimator="entropy_weighted", smoothing=0.25, floor=0.02),
}


def consensus(df: DataFrame, start: DataFrame, variants: dict[str, Setting] | None = None, mode: str = "logit_mean", confidence_weight: float = 1.0, balance_weight: float = 1.0, temperature: float = 1.0, standardize: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """(row_id, p) pooled from the variants within the row, and their weights: softmax of certainty (1 less the rows'
    mean relative entropy) and of the evenness of the mean probability."""
    if mode not in ("logit_mean", "arithmetic_mean"):
        raise ValueError(f"no such mode: {mode}")
    variants = VARIANTS if variants is None else variants
    a = adaptation(df, start, list(variants.values()), standardize)
    if a is None:
        return start.select("row_id", "p").limit(0), {}
    k = a.shapes.shape[1] - 2
    score = (confidence_weight * (1 - a.shapes[:, k]) + balance_weight * _entropies(a.shapes[:, :k])) / temperature
    w, models = _softmax(score[None, :])[0], a.models

    def pooled(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        parts = [models.probabilities(i, x, p) for i in range(len(w))]
        if mode == "arithmetic_mean":
            return _normal(sum(v * q for v, q in zip(w, parts)))
        return _softmax(sum(v * np.log(np.clip(q, EPS, 1.0)) for v, q in zip(w, parts)))

    return _rows_of(a, pooled), dict(zip(variants, map(float, w)))
