"""Feature transforms fitted on source rows and applied to all rows.

Statistics of feature columns come from one grouping by position of the exploded rows, or, for products
of columns, from partial sums of each partition (``moments``); what is applied to rows is an array of one
number for each feature, whose size the number of features bounds, so it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed, quantiles


def positions(df: DataFrame) -> DataFrame:
    """One row for each entry of ``x``: pos and v, with all other columns."""
    return df.select(*[c for c in df.columns if c != "x"], F.posexplode("x").alias("pos", "v"))


def source(df: DataFrame) -> DataFrame:
    return df.where("role = 'source'")


def arrays(stats: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Columns of statistics by position as arrays in order of position, one row for each key."""
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_a"))
    return packed.select(*keys, *[F.transform("_a", lambda s: s[n]).alias(n) for n in names])


def column_scales(df: DataFrame, location: str = "mean", scale: str = "std", floor: float = 1e-12, ddof: int = 0) -> DataFrame:
    """(pos, loc, scale) of the columns; location mean, median or none; scale std, mad, iqr or none."""
    p = positions(df)
    floored = lambda c: F.greatest(c, F.lit(floor))
    middle = lambda of: quantiles(of, [0.5]).select("pos", F.get("q", F.lit(0)).alias("_mid"))
    raw = {"std": F.stddev_samp("v") if ddof else F.stddev_pop("v")}.get(scale, F.lit(1.0))
    out = p.groupBy("pos").agg({"mean": F.avg("v")}.get(location, F.lit(0.0)).alias("loc"), floored(raw).alias("scale"))
    if location == "median" or scale == "mad":
        mid = middle(p)
    if location == "median":
        out = out.join(mid, "pos").select("pos", F.col("_mid").alias("loc"), "scale")
    if scale == "mad":
        away = p.join(mid, "pos").select("pos", F.abs(F.col("v") - F.col("_mid")).alias("v"))
        out = out.join(middle(away), "pos").select("pos", "loc", floored(1.4826 * F.col("_mid")).alias("scale"))
    if scale == "iqr":
        out = out.join(quantiles(p, [0.25, 0.75]), "pos").select("pos", "loc", floored(F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("scale"))
    return out


def with_stats(df: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` beside the one row of arrays of ``stats``."""
    return df.join(F.broadcast(arrays(stats, names)))  # one row, as long as the features


def standardized(df: DataFrame, location: str = "mean", scale: str = "std", clip: float | None = None, fit: DataFrame | None = None) -> DataFrame:
    """(x - location) / scale with statistics of the source rows (or of ``fit``), clipped to +-clip."""
    out = with_stats(df, column_scales(source(df) if fit is None else fit, location, scale), ["loc", "scale"])
    z = F.transform(F.arrays_zip("x", "loc", "scale"), lambda t: (t["x"] - t["loc"]) / t["scale"])
    if clip is not None:
        z = F.transform(z, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v)))
    return out.withColumn("x", z).drop("loc", "scale")


def centered(df: DataFrame, location: str = "mean") -> DataFrame:
    return standardized(df, location, "none")


def minmax(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high] by the source's range; constant columns go to ``low``."""
    stats = positions(source(df)).groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = F.transform(F.arrays_zip("x", "lo", "hi"), lambda t: F.when(t["hi"] > t["lo"], (t["x"] - t["lo"]) / (t["hi"] - t["lo"])).otherwise(0.0) * (high - low) + low)
    return with_stats(df, stats, ["lo", "hi"]).withColumn("x", z).drop("lo", "hi")


def sample_quantiles(df: DataFrame, lower: float, higher: float) -> DataFrame:
    """(pos, lo, hi): the sample values at floor and ceil of q (n - 1), no interpolation, found by rank."""
    q = quantiles(positions(df), [lower, higher], False)
    return q.select("pos", F.get("q", F.lit(0))["low"].alias("lo"), F.get("q", F.lit(1))["high"].alias("hi"))


def clipped(df: DataFrame, lower: float = 0.05, higher: float = 0.95, interpolate: bool = True) -> DataFrame:
    """Entries held between the source's quantiles."""
    if interpolate:
        s = quantiles(positions(source(df)), [lower, higher]).select("pos", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    else:
        s = sample_quantiles(source(df), lower, higher)
    z = F.transform(F.arrays_zip("x", "lo", "hi"), lambda t: F.greatest(t["lo"], F.least(t["hi"], t["x"])))
    return with_stats(df, s, ["lo", "hi"]).withColumn("x", z).drop("lo", "hi")


def squashed(df: DataFrame, kind: str = "asinh", scale: str = "std") -> DataFrame:
    """asinh(x / scale) or x / (scale + |x|)."""
    out = with_stats(df, column_scales(source(df), "none", scale), ["scale"])
    each = (lambda t: F.asinh(t["x"] / t["scale"])) if kind == "asinh" else (lambda t: t["x"] / t["scale"] / (1 + F.abs(t["x"] / t["scale"])))
    return out.withColumn("x", F.transform(F.arrays_zip("x", "scale"), each)).drop("scale")


def ecdf(df: DataFrame, output: str = "uniform") -> DataFrame:
    """Rank of each entry among the source's: (r + 0.5) / (n + 1) with r source values at or below it,
    within [0, 1]; constant columns give 0.5; ``mid`` gives the mean of left and right rank over n.

    A column's different values, each with the number of source rows that have it, are dealt by ranges; what
    stands before a range comes from the ranges' sums, so a column is no single task, and neither is a value
    that many rows share.
    """
    from chronoprob.sources.observations import cut

    p = positions(df)
    edges = positions(source(df)).groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    counts = p.groupBy("pos", "v").agg(F.count_if(F.col("role") == "source").alias("_t"))
    dealt = cut(counts.repartitionByRange("pos", "v").withColumn("_part", F.spark_partition_id()), "ecdf")
    parts = dealt.groupBy("pos", "_part").agg(F.sum("_t").alias("_sum"))
    starts = parts.select("pos", "_part", (F.sum("_sum").over(Window.partitionBy("pos").orderBy("_part")) - F.col("_sum")).alias("_s"))
    upto = F.sum("_t").over(Window.partitionBy("pos", "_part").orderBy("v"))
    known = dealt.withColumn("_r", upto).join(starts, ["pos", "_part"]).select("pos", "v", "_t", (F.col("_r") + F.col("_s")).alias("_r"))
    ranked = p.join(known.join(edges, "pos"), ["pos", "v"])
    if output == "uniform":
        value = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(F.least(F.lit(1.0), (F.col("_r") + 0.5) / (F.col("n") + 1)))
    else:
        value = (F.col("_r") - F.col("_t") / 2) / F.col("n")
    return ranked.select("row_id", "pos", value.alias("value"))


def quantile_bins(df: DataFrame, n_bins: int) -> DataFrame:
    """Number of the source's inner quantile edges at or below each entry."""
    qs = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles(positions(source(df)), qs).withColumnRenamed("q", "edges")
    z = F.transform(F.arrays_zip("x", "edges"), lambda t: F.size(F.filter(t["edges"], lambda e: e <= t["x"])))
    return with_stats(df, edges, ["edges"]).withColumn("bins", z).drop("edges")


def binarized(df: DataFrame, threshold: str = "median", signed: bool = False) -> DataFrame:
    loc = {"median": "median", "mean": "mean", "zero": "none"}[threshold]
    out = with_stats(df, column_scales(source(df), loc, "none"), ["loc"])
    return out.withColumn("x", F.transform(F.arrays_zip("x", "loc"), lambda t: F.when(t["x"] >= t["loc"], 1.0).otherwise(-1.0 if signed else 0.0))).drop("loc")


def anova(df: DataFrame, label: str = "label") -> DataFrame:
    """(pos, f): between over within mean square of each column, from sums by class."""
    own = positions(df).groupBy("pos", label).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n, s, q, k = F.sum("n"), F.sum("s"), F.sum("q"), F.count("*")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = q - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return own.groupBy("pos").agg(F.try_divide(between / (k - 1), within / (n - k)).alias("f"))


def moments(df: DataFrame, keys: Sequence[str] = (), vector: str = "x") -> DataFrame:
    """(keys, n, s, xx): count, sum and flattened sum of outer products of the rows, which add up. Each
    Arrow batch becomes one partial row for each key, and partial rows are added position by position."""
    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["n long", "s array<double>", "xx array<double>"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]
            rows = []
            for key, g in groups:
                if len(g):
                    x = np.stack([np.asarray(v, dtype=np.float64) for v in g[vector]])
                    rows.append((*(key if isinstance(key, tuple) else (key,)), len(x), x.sum(0).tolist(), (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "s", "xx"])

    parts = df.select(*keys, vector).mapInPandas(partial, schema)
    n = parts.groupBy(*keys).agg(F.sum("n").alias("n"))

    def added(c: str) -> DataFrame:
        long = parts.select(*keys, F.posexplode(c).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias(c))
        return arrays(long, [c], keys)

    if not keys:
        return n.join(F.broadcast(added("s"))).join(F.broadcast(added("xx")))  # one row each
    return n.join(added("s"), list(keys)).join(added("xx"), list(keys))


def mean_and_covariance(df: DataFrame, ddof: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count on the driver: as large as the features, not the rows."""
    m = moments(df).first()
    n, s = m["n"], np.array(m["s"])
    xx = np.array(m["xx"]).reshape(len(s), len(s))
    return s / n, (xx - np.outer(s, s) / n) / max(1, n - ddof), n


def signed_columns(w: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    at = np.abs(w).argmax(axis=0)
    return w * np.where(w[at, np.arange(w.shape[1])] < 0, -1.0, 1.0)


def linear(df: DataFrame, w: np.ndarray, offset: np.ndarray | None = None, to: str = "x") -> DataFrame:
    """(x - offset) W for each row, in Arrow batches."""
    shift = np.zeros(w.shape[0]) if offset is None else offset

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_list()) - shift) @ w)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(to, apply("x"))


def pca(df: DataFrame, k: int, whiten: bool = False, eps: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """Rows on the first ``k`` principal axes of the source rows, and the axes."""
    mean, cov, _ = mean_and_covariance(source(df))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    w = signed_columns(vectors[:, order])
    return linear(df, w / np.sqrt(values[order] + eps) if whiten else w, mean), w


def zca(df: DataFrame, regularization: float = 1e-6) -> DataFrame:
    """Whitening that stays as near to the rows as it can: the inverse square root of the covariance."""
    mean, cov, _ = mean_and_covariance(source(df))
    return linear(df, power(cov + regularization * np.eye(len(cov)), -0.5), mean)


def power(m: np.ndarray, p: float, floor: float = 1e-12) -> np.ndarray:
    """Power of a symmetric positive matrix."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, floor) ** p) @ vectors.T


def logm(m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """Of one symmetric matrix, or of a stack."""
    values, vectors = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return (vectors * np.log(np.maximum(values, floor))[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def vech(m: np.ndarray) -> np.ndarray:
    """Upper triangle with off-diagonal entries times the square root of two."""
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def random_features(df: DataFrame, dim: int, k: int, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """Gaussian projection, or with ``gamma`` random Fourier features of the kernel exp(-gamma d^2)."""
    rng = np.random.default_rng(seed)
    if gamma is None:
        return linear(df, rng.normal(size=(dim, k)) / np.sqrt(k))
    w, b = rng.normal(size=(dim, k)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, k)

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / k) * np.cos(np.stack(x.to_list()) @ w + b))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn("x", apply("x"))


def sparse_matrix(dim: int, k: int, density: float | None = None, seed: int = 0) -> np.ndarray:
    """Entries of either sign, kept with a chance of ``density`` (one over the root of ``dim`` by default), over the
    root of ``density`` times ``k``; draws are hashes of seed, row and column, so that any engine has the same."""
    density = 1 / np.sqrt(dim) if density is None else density
    if not 0 < density <= 1:
        raise ValueError("density lies above 0 and at most at 1")
    unit = lambda kind, i, j: int(hashlib.md5(f"{kind}:{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) / 2**32
    entry = lambda i, j: (unit("keep", i, j) < density) * (1.0 if unit("sign", i, j) < 0.5 else -1.0)
    return np.array([[entry(i, j) for j in range(k)] for i in range(dim)]).reshape(dim, k) / np.sqrt(density * k)


def sparse_projected(df: DataFrame, dim: int, k: int, density: float | None = None, seed: int = 0) -> DataFrame:
    """Rows times ``sparse_matrix``: each new entry adds up the few old ones that its column keeps."""
    w = sparse_matrix(dim, k, density, seed)
    kept = [[F.get("x", F.lit(int(i))) * F.lit(float(w[i, j])) for i in np.flatnonzero(w[:, j])] for j in range(k)]
    return df.withColumn("x", F.array(*[sum(c[1:], c[0]) if c else F.lit(0.0) for c in kept]))


def class_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean): mean rows."""
    return arrays(positions(df).groupBy(*keys, "pos").agg(F.avg("v").alias("mean")), ["mean"], keys)


def prototype_distances(df: DataFrame, label: str = "label") -> DataFrame:
    """(row, label, distance): squared distance of each row to each source class's mean."""
    from chronoprob.functions.vectors import squared_distance

    means = class_means(source(df), [label]).withColumnRenamed(label, "prototype")
    return df.join(F.broadcast(means)).withColumn("distance", squared_distance(F.col("x"), F.col("mean"))).drop("mean")  # one row for each class


def trial_covariances(trials: DataFrame, key: Sequence[str], shrinkage: float = 0.1, log: bool = True) -> DataFrame:
    """Vector of the (log-Euclidean) channel covariance of each trial. ``trials`` has channel and samples;
    a trial's channels come together as one row, and rows go through numpy in Arrow batches."""
    @F.pandas_udf("array<double>")
    def covariance(flat: pd.Series, channels: pd.Series) -> pd.Series:
        out = np.empty(len(flat), dtype=object)
        shapes = pd.DataFrame({"n": channels.to_numpy(dtype=np.int64), "size": [len(v) for v in flat]})
        for (n, size), at in shapes.groupby(["n", "size"]).indices.items():  # trials of one shape together
            for some in np.split(at, range(4096, len(at), 4096)):
                x = np.concatenate(flat.to_numpy()[some]).astype(np.float64, copy=False).reshape(len(some), n, -1)
                x = x - x.mean(axis=2, keepdims=True)
                c = x @ x.transpose(0, 2, 1) / max(1, x.shape[2] - 1)
                c = (1 - shrinkage) * c + shrinkage * np.trace(c, axis1=1, axis2=2)[:, None, None] / n * np.eye(n)
                out[some] = [*vech(logm(c) if log else c)]
        return pd.Series(out, dtype=object)

    rows = trials.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("_c"))
    flat = F.flatten(F.transform("_c", lambda c: c["samples"]))
    return rows.select(*key, covariance(flat, F.size("_c")).alias("x"))


def recentred(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Log-domain rows less the mean of their domain (recentering by the log-Euclidean mean)."""
    means = class_means(df, [domain])
    out = df.join(means, domain)
    return out.withColumn("x", F.zip_with("x", "mean", lambda a, b: a - b)).drop("mean")


def band_power(trials: DataFrame, key: Sequence[str], rate: float, band: tuple[float, float]) -> DataFrame:
    """power, amplitude and phase of each series in a frequency band, by masking its Fourier transform.
    ``trials`` has samples."""
    schema = "power double, amplitude double, phase double"

    @F.pandas_udf(schema)
    def measure(samples: pd.Series) -> pd.DataFrame:
        rows = []
        for s in samples:
            x = np.asarray(s, dtype=np.float64)
            f = np.fft.fft(x - x.mean())
            hz = np.fft.fftfreq(len(x), 1 / rate)
            analytic = np.fft.ifft(np.where((hz >= band[0]) & (hz <= band[1]), 2 * f, 0))
            rows.append((float(np.mean(np.abs(analytic) ** 2)), float(np.mean(np.abs(analytic))), float(np.angle(np.mean(np.exp(1j * np.angle(analytic)))))))
        return pd.DataFrame(rows, columns=["power", "amplitude", "phase"])

    return trials.select(*key, measure("samples").alias("m")).select(*key, "m.*")


def dct(df: DataFrame, n: int, k: int) -> DataFrame:
    """The first ``k`` coefficients of the orthonormal cosine transform of rows of ``n`` entries."""
    t = np.arange(n)
    basis = np.stack([np.sqrt((1 if i == 0 else 2) / n) * np.cos(np.pi * (t + 0.5) * i / n) for i in range(k)], axis=1)
    return linear(df, basis)


def baseline_corrected(long: DataFrame, keys: Sequence[str], window: tuple[float, float], value: str = "value") -> DataFrame:
    """Values less the mean of their (trial, channel)'s baseline window."""
    base = F.avg(F.when(F.col("time").between(*window), F.col(value))).over(Window.partitionBy(*keys))
    return long.withColumn(value, F.col(value) - F.coalesce(base, F.lit(0.0)))


def pseudo_trials(df: DataFrame, keys: Sequence[str], k: int, row: str, seed: int) -> DataFrame:
    """Means of seeded chunks of each key's rows: at most ``k`` chunks, as alike in size as can be."""
    from chronoprob.functions.vectors import md5_unit

    drawn = placed(df.withColumn("_u", md5_unit(F.lit(seed), F.col(row))), F.col("_u"), ["_u", row], keys)
    place, n = F.col("_place") - 1, F.col("_total")
    chunks = F.least(F.lit(k), n)
    size, long = F.floor(n / chunks), n % chunks
    chunk = F.when(place < long * (size + 1), F.floor(place / (size + 1))).otherwise(long + F.floor((place - long * (size + 1)) / F.greatest(size, F.lit(1))))
    marked = drawn.withColumn("chunk", chunk.cast("int"))
    sizes = marked.groupBy(*keys, "chunk").agg(F.count("*").alias("n_rows"))
    return class_means(marked.select(*keys, "chunk", "x"), [*keys, "chunk"]).join(sizes, [*keys, "chunk"]).withColumnRenamed("mean", "x")


def fold_standardized(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Each row under each fold, standardized by that fold's training rows: statistics are totals less the
    fold's own, so rows are not copied to fit them. Returns (row_id, fold, role, x) of the test rows."""
    p = positions(df)
    own = p.groupBy(fold, "pos").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    every = Window.partitionBy("pos")
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "s", "q")}
    stats = own.select(fold, "pos", (rest["s"] / rest["n"]).alias("loc"), F.sqrt(F.greatest(rest["q"] / rest["n"] - (rest["s"] / rest["n"]) * (rest["s"] / rest["n"]), F.lit(1e-24))).alias("scale"))
    packed = arrays(stats, ["loc", "scale"], [fold])
    return df.join(packed, fold).withColumn("x", F.transform(F.arrays_zip("x", "loc", "scale"), lambda t: (t["x"] - t["loc"]) / t["scale"])).drop("loc", "scale")


def correlation_filtered(df: DataFrame, limit: float) -> list[int]:
    """Columns left when, from the first on, each that correlates beyond ``limit`` with one kept is dropped."""
    _, cov, _ = mean_and_covariance(source(df))
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    r, kept = np.abs(cov / np.outer(sd, sd)), []
    for i in range(len(r)):
        if all(r[i, j] <= limit for j in kept):
            kept.append(i)
    return kept


def selected(df: DataFrame, columns: Sequence[int]) -> DataFrame:
    return df.withColumn("x", F.array(*[F.get("x", F.lit(int(i))) for i in columns]))
