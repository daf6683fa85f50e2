"""Matching the distributions of source and target rows by their moments.

Rows have row_id, x, label, domain and role; target labels are never read. Jobs send counts, sums and sums of products
by class and role; problems as large as the features are solved on the driver, and their matrices go to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.functions.vectors import md5_unit, squared_distance
from chronoprob.sources.observations import cut

from . import features as T
from .ranks import placed


def class_labels(df: DataFrame) -> list:
    """The source's labels in order."""
    return [r.label for r in df.where("role = 'source'").select("label").distinct().orderBy("label").collect()]


def _covariance(n: float, s: np.ndarray, xx: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and regularized covariance; of one row, the ridge alone."""
    c = (xx - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros_like(xx)
    return s / n, c + ridge * np.eye(len(s))


def _moved(df: DataFrame, which: str, maps: dict, columns: Sequence[str]) -> DataFrame:
    """``x`` as (x - from) W + to, with the (from, W, to) of the row's ``which``."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, key: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows, out = np.stack(x.to_list()), [None] * len(x)
        for k in key.unique():
            at = np.flatnonzero((key == k).to_numpy())
            start, w, to = maps[k]
            for i, v in zip(at, (rows[at] - start) @ w + to):
                out[i] = v
        return pd.Series(out)

    return df.withColumn("x", apply("x", which)).select(*columns)


def conditional_coral(df: DataFrame, pseudo: DataFrame, regularization: float = 1e-6, least_rows: int = 2, threshold: float = 0.0, fallback: str = "global", center: bool = True) -> tuple[DataFrame, list]:
    """Source rows of each class whitened and given mean and covariance of the target rows that ``pseudo``
    (row_id, p in order of the source's labels) takes for that class with ``threshold`` confidence; target rows stay.

    A class with fewer than ``least_rows`` such rows takes those of all confident target rows (of all target rows,
    if none is confident), or is an error (``fallback`` other than global). Returns the rows and the classes that
    fell back. The driver holds a matrix for each class."""
    labels = class_labels(df)
    if len(labels) < 2:
        raise ValueError("conditional alignment takes two source classes at least")
    source = {r.label: r for r in T.moments(df.where("role = 'source'"), ["label"]).collect()}
    guess = pseudo.select("row_id", P.predicted_index(F.col("p")).alias("_y"), (P.confidence(F.col("p")) >= threshold).alias("_sure"))
    target = {(r._y, r._sure): r for r in T.moments(df.where("role = 'target'").join(guess, "row_id"), ["_y", "_sure"]).collect()}
    d = len(source[labels[0]].s)

    def added(rows: list) -> tuple[int, np.ndarray, np.ndarray]:
        return sum(r.n for r in rows), sum((np.array(r.s) for r in rows), np.zeros(d)), sum((np.array(r.xx) for r in rows), np.zeros(d * d)).reshape(d, d)

    every = added([r for (_, sure), r in target.items() if sure] or list(target.values()))
    maps, fell = {}, []
    for i, y in enumerate(labels):
        own = target.get((i, True))
        if own is not None and own.n >= least_rows:
            n, s, xx = added([own])
        elif fallback == "global":
            n, s, xx = every
            fell.append(y)
        else:
            raise ValueError(f"class {y!r} has fewer than {least_rows} confident target rows")
        here, own_cov = _covariance(*added([source[y]]), regularization)
        there, other = _covariance(n, s, xx, regularization)
        maps[y] = (here, T.power(own_cov, -0.5) @ T.power(other, 0.5), there if center else here)
    moved = _moved(df.where("role = 'source'"), "label", maps, df.columns)
    return moved.unionByName(df.where("role = 'target'")), fell


def simplex_template(n: int, k: int) -> np.ndarray:
    """``n`` anchors as far from one another as can be, around 0, in ``k`` dimensions: the first columns of an orthonormal
    basis of what is orthogonal to the constant (column j sets anchor j + 1 against those before it)."""
    if n < 2 or not 0 < k < n:
        raise ValueError("a template takes two anchors at least, and fewer dimensions than anchors")
    out = np.zeros((n, k))
    for j in range(k):
        out[: j + 1, j], out[j + 1, j] = -1.0, j + 1.0
        out[:, j] /= np.sqrt((j + 1.0) * (j + 2.0))
    return out


def contrastive_alignment(df: DataFrame, components: int = 64, repetitions: int | None = None, seed: int = 0, regularization: float = 1e-3, domain: str = "domain") -> DataFrame:
    """Rows of each domain in a common space in which different anchors are apart: a ridge regression of the domain's
    anchors on a fixed template. Anchors are class means of the classes that all domains have, or, with ``repetitions``,
    so many rows of each such class, drawn by a hash; classes with fewer rows in a domain are left out.

    The template is the same for all domains, so each domain's anchors and regression are one small group, and its
    matrix meets its rows by a join: nothing of the domains goes through the driver."""
    rows = df.select(domain, "label", "row_id", "x")
    least = repetitions or 1
    full = rows.groupBy(domain, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n_domains = rows.agg(F.count_distinct(domain)).first()[0]
    shared = sorted(r.label for r in full.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") == n_domains).collect())  # classes
    if repetitions is None:
        anchors = T.class_means(rows.where(F.col("label").isin(shared)).select(domain, "label", "x"), [domain, "label"]).select(domain, "label", F.lit(1).alias("k"), F.col("mean").alias("x"))
    else:
        drawn = rows.where(F.col("label").isin(shared)).withColumn("_u", md5_unit(F.lit(seed), F.col("row_id")))
        placed_rows = placed(drawn, F.col("_u"), ["_u", "row_id"], [domain, "label"], "k", "_all")
        anchors = placed_rows.where(F.col("k") <= repetitions).select(domain, "label", F.col("k").cast("int").alias("k"), "x")
    n, d = len(shared) * least, rows.select(F.size("x").alias("d")).first().d
    template = simplex_template(n, min(components, n - 1, d))
    kind = dict(df.dtypes)[domain]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf.sort_values(["label", "k"])["x"].to_list())
        mean = a.mean(axis=0)
        gram = (a - mean).T @ (a - mean)
        ridge = regularization * max(np.trace(gram) / d, 1.0)
        w = np.linalg.solve(gram + ridge * np.eye(d), (a - mean).T @ template)
        return pd.DataFrame({domain: [pdf[domain].iloc[0]], "_mean": [mean.tolist()], "_w": [w.ravel().tolist()]})

    maps = cut(anchors.groupBy(domain).applyInPandas(solve, f"{domain} {kind}, _mean array<double>, _w array<double>"), "contrastive")

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, mean: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(a) - np.asarray(m)) @ np.asarray(b).reshape(d, -1) for a, m, b in zip(x, mean, w)], dtype=object)

    return df.join(maps, domain).withColumn("x", apply("x", "_mean", "_w")).select(*df.columns)


def _near_classes(rows: DataFrame, means: np.ndarray, temperature: float) -> DataFrame:
    """``rows`` with ``q``: softmax(-d / temperature) of the squared distances to the class means."""
    d = F.array(*[squared_distance(F.col("_z"), F.array(*[F.lit(float(v)) for v in m])) for m in means])
    return rows.withColumn("q", P.softmax(F.transform(d, lambda v: -v / temperature)))


def joint_adaptation(
    df: DataFrame, k: int = 16, rounds: int = 10, conditional: float = 1.0, regularization: float = 1e-3, ridge: float = 1e-6, temperature: float = 1.0, soft: bool = False, unit: bool = False
) -> tuple[DataFrame, dict]:
    """Joint distribution adaptation: rows on the ``k`` directions in which the means of source and target, and of
    their classes, differ least for the spread that they keep.

    The discrepancy matrix over all rows is the sum of an outer product for the two roles and ``conditional`` times
    one for each class, where a target row counts by its probability of the class, over its Frobenius norm. Neither
    it nor its norm needs the matrix: the products of its vectors follow from class counts, and the target's sums
    of products of features and probabilities. Probabilities are softmax(-d / ``temperature``) of the distances to
    the source's class means; after each round those in the new directions, or with ``soft`` off their largest as
    one, take their place, until no prediction changes or ``rounds`` are done. ``unit`` scales the directions
    to unit deviation. Returns (columns of ``df``, predicted: null for source rows) and facts of the fit."""
    labels = class_labels(df)
    if len(labels) < 2:
        raise ValueError("joint adaptation takes two source classes at least")
    z = T.with_stats(df, T.column_scales(df, ddof=1), ["loc", "scale"])
    z = z.withColumn("x", F.transform(F.arrays_zip("x", "loc", "scale"), lambda t: (t["x"] - t["loc"]) / t["scale"])).drop("loc", "scale")
    z = cut(z, "joint-rows")
    source = {r.label: r for r in T.moments(z.where("role = 'source'"), ["label"]).collect()}
    n_s = sum(source[y].n for y in labels)
    means = np.stack([np.array(source[y].s) / source[y].n for y in labels])
    d, mean_s = means.shape[1], sum(np.array(source[y].s) for y in labels) / n_s
    _, scatter, n = T.mean_and_covariance(z, ddof=1)
    right = T.power(scatter * (n - 1) + ridge * np.eye(d), -0.5)
    target = z.where("role = 'target'").select("row_id", "x")
    now = cut(_near_classes(target.withColumn("_z", F.col("x")), means, temperature).select("row_id", "x", F.col("q").alias("p"), P.predicted_index(F.col("q")).alias("y")), "joint-target")
    for done in range(1, rounds + 1):
        m = T.moments(now.select(F.concat("x", "p").alias("x"))).first()
        n_t, s, xx = m.n, np.array(m.s), np.array(m.xx).reshape(d + len(labels), -1)
        mass, mean_t = s[d:], s[:d] / n_t
        held = [i for i in range(len(labels)) if mass[i] > 1e-12]
        away = np.stack([mean_s - mean_t, *[means[i] - xx[:d, d + i] / mass[i] for i in held]])
        gram = np.full((len(away), len(away)), 1.0 / n_s + 1.0 / n_t)
        gram[1:, 1:] = xx[d:, d:][np.ix_(held, held)] / np.outer(mass[held], mass[held]) + np.diag([1.0 / source[labels[i]].n for i in held])
        weight = np.array([1.0, *[conditional] * len(held)])
        norm = np.sqrt(weight @ gram**2 @ weight)
        left = (away.T * weight) @ away / (norm if norm > 1e-12 else 1.0) + regularization * np.eye(d)
        values, vectors = np.linalg.eigh(right @ left @ right)
        w = T.signed_columns(right @ vectors[:, : min(k, d)])
        if unit:
            w = w / np.maximum(np.sqrt(np.einsum("ij,ik,kj->j", w, scatter, w)), 1e-12)
        again = _near_classes(T.linear(now, w, to="_z"), means @ w, temperature)
        best = P.predicted_index(F.col("q"))
        p = F.col("q") if soft else F.transform("q", lambda v, i: F.when(i == P.predicted_index(F.col("q")), 1.0).otherwise(0.0))
        now = cut(again.select("row_id", "x", p.alias("p"), F.col("y").alias("old"), best.alias("y")), "joint-target")
        stable = now.where("y <> old").isEmpty()
        if stable:
            break
    out = T.linear(z, w).join(now.select("row_id", F.get(F.array(*[F.lit(v) for v in labels]), F.col("y")).alias("predicted")), "row_id", "left")
    facts = {"rounds": done, "stable": stable, "projection": w, "values": values[: min(k, d)], "labels": labels}
    return out.select(*df.columns, "predicted"), facts
