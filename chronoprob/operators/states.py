"""Sticky hidden-state models of probability sequences: fit, controls, traces, smoothing, structured decoding.

A sequence is the unit of work: its rows are ordered and passed through a small numpy recursion, which takes a row of
many sequences at each step. What models share (likelihoods over a grid of stay probabilities) is added up by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import arrays, begins, by_length, map_tables, matrix

EPS = 1e-12


def stay_grid(n_states: int, size: int) -> np.ndarray:
    return np.linspace(1.0 / n_states, 0.995, size)


def shares(p: np.ndarray) -> np.ndarray:
    """Probabilities of at least EPS. Rows that add up to 1 but for rounding stay as they are."""
    p = np.maximum(p, EPS)
    total = p.sum(axis=1, keepdims=True)
    return np.where(np.abs(total - 1) <= 1e-9, p, p / total)


def emissions(rows) -> np.ndarray:
    """Log probabilities."""
    return _log(shares(np.stack([np.asarray(r, dtype=np.float64) for r in rows])))


def _log(p: np.ndarray) -> np.ndarray:
    """Logarithms by the C library, as SQL has them; numpy's own may be an ulp off, which tells paths apart whose
    scores are equal but for rounding."""
    return np.array([math.log(x) for x in p.ravel().tolist()]).reshape(p.shape)


def transition(n: int, stay: float) -> np.ndarray:
    s = min(max(stay, EPS), 1 - EPS)
    return np.log(np.where(np.eye(n, dtype=bool), s, (1 - s) / (n - 1)))


def grid_log_likelihoods(p: np.ndarray, starts: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Forward log likelihood of each sequence of probability rows at every stay probability at once. The states'
    shares are made to add up to 1 at each row, so a move is a number times the own share plus another."""
    n = p.shape[1]
    stay = np.clip(grid, EPS, 1 - EPS)
    move = (1 - stay) / (n - 1)
    first, reach = by_length(starts, len(p))
    share = np.repeat(p[first][:, None, :] / n, len(grid), axis=1)
    total = share.sum(axis=2)
    share /= total[:, :, None]
    ll = np.log(total)
    for t, m in enumerate(reach[1:], 1):
        now = share[:m]
        now *= (stay - move)[:, None]
        now += move[:, None]
        now *= p[first[:m] + t][:, None, :]
        total = now.sum(axis=2)
        now /= total[:, :, None]
        ll[:m] += np.log(total)
    return ll[np.argsort(first)]


def posteriors(p: np.ndarray, starts: np.ndarray, stay: np.ndarray, causal: bool = False) -> np.ndarray:
    """Posterior of the states at each row of each sequence, from all its rows or, ``causal``, from those so far;
    ``stay`` is each sequence's stay probability."""
    n = p.shape[1]
    first, reach = by_length(starts, len(p))
    s = np.clip(stay, EPS, 1 - EPS)[np.searchsorted(starts, first)][:, None]
    move = (1 - s) / (n - 1)
    alpha = np.empty_like(p)
    alpha[first] = p[first]
    for t, m in enumerate(reach[1:], 1):
        at = first[:m] + t
        x = (move[:m] + (s - move)[:m] * alpha[at - 1]) * p[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    if not causal:
        back = np.ones((len(first), n))
        for t in range(len(reach) - 1, 0, -1):
            m = reach[t]
            at = first[:m] + t
            x = p[at] * back[:m]
            x /= x.sum(axis=1, keepdims=True)
            back[:m] = move[:m] + (s - move)[:m] * x
            alpha[at - 1] *= back[:m]
    return alpha / alpha.sum(axis=1, keepdims=True)


def best_paths(e: np.ndarray, starts: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """The best path of each sequence; of equal moves the first state comes first."""
    first, reach = by_length(starts, len(e))
    moves = np.stack([transition(e.shape[1], x) for x in stay[np.searchsorted(starts, first)].tolist()])
    score, back = e[first] - np.log(e.shape[1]), np.zeros(e.shape, dtype=np.int32)
    for t, m in enumerate(reach[1:], 1):
        at = first[:m] + t
        options = score[:m, :, None] + moves[:m]
        back[at] = options.argmax(axis=1)
        score[:m] = e[at] + options.max(axis=1)
    path, state = np.zeros(len(e), dtype=np.int32), score.argmax(axis=1)
    for t in range(len(reach) - 1, -1, -1):
        at = first[: reach[t]] + t
        path[at] = state[: reach[t]]
        state[: reach[t]] = back[at, state[: reach[t]]]
    return path


def grid_log_likelihood(e: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Forward log likelihood of one sequence of log probabilities at every stay probability."""
    return grid_log_likelihoods(np.exp(e), np.array([0]), grid)[0]


def forward_backward(e: np.ndarray, stay: float, causal: bool = False) -> np.ndarray:
    """As ``posteriors`` of one sequence of log probabilities."""
    return posteriors(np.exp(e), np.array([0]), np.array([stay]), causal)


def viterbi(e: np.ndarray, stay: float) -> np.ndarray:
    """As ``best_paths`` of one sequence."""
    return best_paths(e, np.array([0]), np.array([stay]))


def likelihoods(df: DataFrame, model: Sequence[str], sequence: Sequence[str], n_states: int, size: int, control: str = "observed", n_controls: int = 1, seed: int = 0) -> DataFrame:
    """(model, rep, i, ll, rows, sequences): summed log likelihood at each grid place. Controls shuffle the
    times of a sequence or the labels of its rows, by a generator seeded with sequence and repetition."""
    grid = stay_grid(n_states, size)
    types = dict(df.dtypes)
    rows = df.select(*model, *sequence, "time", "p")  # a sequence goes to its task once, for all controls

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        p = shares(matrix(table["p"]))
        lengths = np.diff([*starts, len(p)])
        of_model = begins(table, model)
        parts = []
        for rep in range(1, n_controls + 1) if control != "observed" else [0]:
            mixed = p
            if control != "observed":
                mixed = p.copy()
                for at, n in zip(starts.tolist(), lengths.tolist()):
                    rng = np.random.default_rng([seed, rep, *[ord(c) for k in sequence for c in str(table[k][at].as_py())]])
                    own = p[at : at + n]
                    mixed[at : at + n] = own[rng.permutation(n)] if control == "shuffled_time" else np.stack([r[rng.permutation(len(r))] for r in own])
            ll = grid_log_likelihoods(mixed, starts, grid)
            for a, b in zip(of_model, [*of_model[1:], len(p)]):
                mine = (starts >= a) & (starts < b) & (lengths > 1)
                parts.append((a, rep, ll[mine].sum(axis=0), int(lengths[mine].sum()), int(mine.sum())))
        at, reps, sums, n, sequences = zip(*parts)
        keys = table.select(list(model)).take(list(at)).combine_chunks()
        columns = [*[pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in keys.columns], pa.array(reps, pa.int32()), arrays(np.stack(sums)), pa.array(n, pa.int64()), pa.array(sequences, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*model, "rep", "ll", "n", "sequences"])

    # sums of the sequences that a task takes together
    lls = map_tables(rows, [*model, *sequence], ["time"], solve, ", ".join(f"{k} {types[k]}" for k in model) + ", rep int, ll array<double>, n long, sequences long").where("sequences > 0")
    sums = F.array(*[F.sum(F.get("ll", F.lit(i))) for i in range(size)]).alias("ll")  # one pass over the sequences
    totals = lls.groupBy(*model, "rep").agg(F.sum("n").alias("n_observations"), F.sum("sequences").alias("n_sequences"), sums)
    return totals.select(*model, "rep", F.posexplode("ll").alias("i", "ll"), "n_observations", "n_sequences")


def fit(df: DataFrame, model: Sequence[str], sequence: Sequence[str], n_states: int, size: int = 50, **control) -> DataFrame:
    """(model, rep, stay, log_likelihood, gain): the first best stay probability, and the gain for each row
    over a uniform model."""
    ll = likelihoods(df, model, sequence, n_states, size, **control)
    best = ll.groupBy(*model, "rep").agg(F.max(F.struct("ll", (-F.col("i")).alias("i"))).alias("b"), F.first("n_observations").alias("n_observations"), F.first("n_sequences").alias("n_sequences"))
    step = (0.995 - 1.0 / n_states) / (size - 1)
    per = F.col("b.ll") / F.col("n_observations")
    return best.select(*model, "rep", (F.lit(1.0 / n_states) - F.col("b.i") * step).alias("stay_probability"), F.col("b.ll").alias("log_likelihood"), (per + float(np.log(n_states))).alias("gain"), "n_observations", "n_sequences")


def control_test(observed: DataFrame, controls: DataFrame, model: Sequence[str]) -> DataFrame:
    """(model, p_value, gain_mean, gain_sd): share of controls, counted with the observed, that gain as much."""
    both = controls.join(observed.select(*model, F.col("gain").alias("_g")), list(model))
    return both.groupBy(*model).agg(((1 + F.count_if(F.col("gain") >= F.col("_g"))) / (F.count("*") + 1)).alias("p_value"), F.avg("gain").alias("gain_mean"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("gain_sd"))


def traces(df: DataFrame, stay: DataFrame, model: Sequence[str], sequence: Sequence[str], row: str, mode: str = "forward_backward", start: float | None = None) -> DataFrame:
    """(row, posterior, state): posterior and Viterbi state of each row; ``forward_only`` uses the rows so
    far, and ``poststimulus_forward_only`` leaves rows before ``start`` as they are."""
    types = dict(df.dtypes)
    rows = df.select(*model, *sequence, row, "time", "p").join(stay.select(*model, "stay_probability"), list(model))

    def solve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        p, stays = shares(matrix(table["p"])), table["stay_probability"].to_numpy()[starts]
        if mode == "poststimulus_forward_only":
            q, after = p.copy(), np.flatnonzero(table["time"].to_numpy() >= start)
            which = np.searchsorted(starts, after, side="right") - 1
            heads = np.flatnonzero(np.diff(which, prepend=-1))
            if len(after):
                q[after] = posteriors(p[after], heads, stays[which[heads]], causal=True)
        else:
            q = posteriors(p, starts, stays, causal=mode == "forward_only")
        return pa.table([table[row], arrays(q), pa.array(best_paths(_log(p), starts, stays), pa.int32())], [row, "posterior", "state"])

    return map_tables(rows, [*model, *sequence], ["time"], solve, f"{row} {types[row]}, posterior array<double>, state int")


def online_path(e: np.ndarray, prior: np.ndarray, rate: float = 0.05, entropy_weight: float = 1.0, marginal_weight: float = 0.1, momentum: float = 0.05, updates: int = 1, timing: str = "after_predict", temperature: float = 1.0, clip: float = 3.0) -> np.ndarray:
    """Rows of log probabilities under a bias of the classes that learns from the rows themselves.

    A step goes down the gradient of the row's entropy and of the running mean's distance from the prior. The
    bias keeps mean zero and stays within ``clip`` (0: anywhere). ``timing`` says whether a row is given out
    before (``after_predict``) or after (``before_predict``) the steps it causes."""
    if timing not in ("after_predict", "before_predict"):
        raise ValueError(f"no such timing: {timing}")
    bias, mean, out = np.zeros(len(prior)), prior.copy(), np.empty_like(e)

    def shown(row: np.ndarray) -> np.ndarray:
        z = np.exp(np.maximum(row - row.max(), -50.0))
        return z / z.sum()

    for t, row in enumerate(e / temperature):
        out[t] = shown(row + bias)
        for _ in range(updates):
            q = shown(row + bias)
            mean = (1 - momentum) * mean + momentum * q
            mean = mean / mean.sum()
            log_q = np.log(np.maximum(q, EPS))
            slope = -entropy_weight * q * (log_q - q @ log_q) + marginal_weight * (mean - prior)
            bias = bias - rate * (slope - slope.mean())
            bias = bias - bias.mean()
            if clip > 0:
                bias = np.clip(bias, -clip, clip)
                bias = bias - bias.mean()
        if timing == "before_predict":
            out[t] = shown(row + bias)
    return out


def online_adapted(df: DataFrame, sequence: Sequence[str], row: str, source_prior: Sequence[float] | None = None, **settings) -> DataFrame:
    """(row, p): each sequence's rows, in order of time, by ``online_path``; without a prior an even one."""
    types = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        e = emissions(pdf["p"])
        prior = np.asarray(source_prior if source_prior is not None else np.ones(e.shape[1]), dtype=np.float64)
        return pd.DataFrame({row: pdf[row].tolist(), "p": list(online_path(e, prior / prior.sum(), **settings))})

    return df.select(*sequence, row, "time", "p").groupBy(*sequence).applyInPandas(one, f"{row} {types[row]}, p array<double>")


def press_scores(e: np.ndarray, order: Sequence[int], position: np.ndarray | None = None, overlap: np.ndarray | None = None, order_weight: float = 0.35, overlap_weight: float = 0.15, rest_bias: float = 0.0) -> np.ndarray:
    """Log scores of the states rest, press, rest, ..., press, rest of one template. Class 0 is rest. ``position``
    holds the probabilities of rest and of each place in the order, ``overlap`` that any press is going on."""
    log = lambda p: np.log(np.clip(p, EPS, 1.0))
    places = np.arange(2 * len(order) + 1)
    press = places % 2 == 1
    classes = np.zeros(len(places), dtype=int)
    classes[press] = order
    scores = e[:, classes] + np.where(press, 0.0, rest_bias)
    if position is not None:
        scores = scores + order_weight * log(position)[:, np.where(press, (places + 1) // 2, 0)]
    if overlap is not None:
        scores = scores + overlap_weight * np.where(press, log(overlap)[:, None], log(1 - overlap)[:, None])
    return scores


def press_path(scores: np.ndarray, stay: np.ndarray, complete: bool = True) -> tuple[float, np.ndarray]:
    """The best path that starts in the first rest or press and stays or goes on by one state at each row;
    ``complete`` paths end in the last press or rest. Of equal moves staying comes first."""
    n_rows, n_states = scores.shape
    hold, on = _log(np.clip(stay, 1e-6, 1 - 1e-6)), _log(np.clip(1 - stay, 1e-6, 1.0))
    best = np.full(n_states, -np.inf)
    best[:2] = scores[0, :2] + [0.0, on[0]]
    came = np.zeros((n_rows, n_states), dtype=np.int8)  # states that the path comes on by
    for t in range(1, n_rows):
        moved = np.concatenate([[-np.inf], best[:-1] + on[:-1]])
        came[t] = moved > best + hold
        best = np.where(came[t], moved, best + hold) + scores[t]
    first_end = n_states - 2 if complete else 0
    state = first_end + int(np.argmax(best[first_end:]))
    total, path = float(best[state]), np.empty(n_rows, dtype=int)
    for t in range(n_rows - 1, -1, -1):
        path[t] = state
        state -= came[t, state]
    return total, path


def prefix_ends(scores: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix of the rows, the score and the last state of its best path, complete or not: what the forward
    pass of ``press_path`` holds after each row."""
    hold, on = _log(np.clip(stay, 1e-6, 1 - 1e-6)), _log(np.clip(1 - stay, 1e-6, 1.0))
    best = np.full(scores.shape[1], -np.inf)
    best[:2] = scores[0, :2] + [0.0, on[0]]
    held = [best]
    for row in scores[1:]:
        moved = np.concatenate([[-np.inf], best[:-1] + on[:-1]])
        best = np.maximum(best + hold, moved) + row
        held.append(best)
    every = np.stack(held)
    return every.max(axis=1), every.argmax(axis=1)


def template_prefixes(e: np.ndarray, templates: Sequence[Sequence[int]], stay: float | Sequence[float], priors: np.ndarray | None = None, template_weight: float = 0.15, **more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, state, label) at the end of each prefix, as ``template_path`` of the prefix would have them; ``priors``
    are the templates' probabilities as of each row."""
    share = np.zeros((len(e), len(templates)))
    if priors is not None:
        priors = np.asarray(priors, dtype=np.float64)
        share = np.log(np.clip(priors / np.maximum(priors.sum(axis=1, keepdims=True), EPS), EPS, 1.0))
    ends = [prefix_ends(press_scores(e, order, **more), np.broadcast_to(np.asarray(stay, dtype=np.float64), (2 * len(order) + 1,))) for order in templates]
    number = np.stack([total + template_weight * share[:, k] for k, (total, _) in enumerate(ends)], axis=1).argmax(axis=1)
    state = np.stack([s for _, s in ends], axis=1)[np.arange(len(e)), number]
    labels = [templates[n][(s - 1) // 2] if s % 2 else 0 for n, s in zip(number, state)]
    return number, state, np.array(labels, dtype=int)


def template_path(e: np.ndarray, templates: Sequence[Sequence[int]], stay: float | Sequence[float], prior: np.ndarray | None = None, template_weight: float = 0.15, complete: bool = True, **more) -> tuple[int, np.ndarray, np.ndarray]:
    """(template, states, labels) of the best template; the first of equals. ``prior`` are the templates'
    probabilities. Without a path (too few rows) the template is -1 and all is rest."""
    share = np.zeros(len(templates))  # without a prior nothing is added, which would round totals
    if prior is not None:
        prior = np.asarray(prior, dtype=np.float64)
        share = np.log(np.clip(prior / max(prior.sum(), EPS), EPS, 1.0))
    best = (-np.inf, -1, np.zeros(len(e), dtype=int))
    for number, order in enumerate(templates):
        total, path = press_path(press_scores(e, order, **more), np.broadcast_to(np.asarray(stay, dtype=np.float64), (2 * len(order) + 1,)), complete)
        total += template_weight * share[number]
        if total > best[0]:
            best = (total, number, path)
    _, number, states = best
    fingers = np.zeros(len(e), dtype=int) if number < 0 else np.where(states % 2 == 1, np.asarray(templates[number])[np.maximum(states - 1, 0) // 2], 0)
    return number, states, fingers


def structured(df: DataFrame, sequence: Sequence[str], row: str, templates: Sequence[Sequence[int]], stay: float | Sequence[float] = 0.88, causal: bool = False, position: str | None = None, overlap: str | None = None, template: str | None = None, **weights) -> DataFrame:
    """(row, template, state, label): each trial decoded as presses in a template's order with rests between.

    ``position``, ``overlap`` and ``template`` name columns of more predictions: of the place in the order
    (array, rest first), of a press going on (double), of the template (array, its mean over the trial counts).
    ``causal`` decodes each prefix by itself, complete or not, so that later rows change nothing; one forward pass
    has them all."""
    types = dict(df.dtypes)
    given = [c for c in (position, overlap, template) if c]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        e, stacked = emissions(pdf["p"]), lambda c: np.stack([np.asarray(x, dtype=np.float64) for x in pdf[c]])

        more = ({"position": stacked(position)} if position else {}) | ({"overlap": pdf[overlap].to_numpy(dtype=float)} if overlap else {})
        if causal:
            priors = stacked(template).cumsum(axis=0) / np.arange(1, len(e) + 1)[:, None] if template else None
            number, states, labels = template_prefixes(e, templates, stay, priors, **more, **weights)
        else:
            n, states, labels = template_path(e, templates, stay, stacked(template).mean(axis=0) if template else None, **more, **weights)
            number = [n] * len(e)
        return pd.DataFrame({row: pdf[row].tolist(), "template": number, "state": states, "label": labels})

    return df.select(*sequence, row, "time", "p", *given).groupBy(*sequence).applyInPandas(one, f"{row} {types[row]}, template int, state int, label int")
