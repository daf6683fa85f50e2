"""Adaptation of probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P

from .ranks import placed_by_value


def covered(df: DataFrame, conf: str, row: str, coverage: float) -> DataFrame:
    """The ceil(n * coverage) most confident rows, first rows first among equals."""
    ranked = placed_by_value(df, [F.col(conf).desc(), row])
    return ranked.where(F.col("_place") <= F.ceil(F.col("_total") * coverage)).drop("_place", "_total")


def log_means(df: DataFrame, keys: Sequence[str], eps: float = 1e-15) -> DataFrame:
    """(keys, bias): mean log score of each class."""
    long = df.select(*keys, F.posexplode("p").alias("k", "v"))
    means = long.groupBy(*keys, "k").agg(F.avg(F.log(F.greatest("v", F.lit(eps)))).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("bias"))


def debiased(df: DataFrame, keys: Sequence[str], window: tuple[float, float]) -> DataFrame:
    """Mean log score of the baseline window, by group with the whole table's as fallback, taken from the
    log scores, and softmax."""
    base = df.where(F.col("time").between(*window))
    own = log_means(base, keys)
    every = log_means(base, []).withColumnRenamed("bias", "_every")
    joined = df.join(own, list(keys), "left").join(F.broadcast(every))  # one row
    return joined.withColumn("p", P.debiased(F.col("p"), F.coalesce("bias", "_every"))).drop("bias", "_every")


def _keyed_means(df: DataFrame, keys: Sequence[str], q: Column, to: str) -> DataFrame:
    """(keys, to): mean of the array ``q`` over the rows of each key, position by position."""
    long = df.select(*keys, F.posexplode(q).alias("k", "v")).groupBy(*keys, "k").agg(F.avg("v").alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(to))


def _with_keyed(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(table, list(keys)) if keys else df.join(F.broadcast(table))  # one row without keys


def prior_shift(df: DataFrame, source_prior: Sequence[float], keys: Sequence[str] = (), iterations: int = 10, smoothing: float = 0.0, damping: float = 1.0) -> DataFrame:
    """(keys, prior): target prior of each block by EM on the posteriors: one aggregation an iteration, whose
    result is one array for each block. It is cut each round: it is used twice in the next, and it is a table of known size,
    so where it is small, Spark moves no rows for the join, however large a block is."""
    from chronoprob.sources.observations import cut

    src = F.array(*[F.lit(float(x)) for x in source_prior])
    n = len(source_prior)
    blocks = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    prior = blocks.withColumn("prior", src)
    prior = cut(prior, "prior") if keys else prior
    for _ in range(iterations):
        rows = _with_keyed(df.select(*keys, "p"), prior, keys)
        mean = _keyed_means(rows, keys, P.reweighted(F.col("p"), F.col("prior"), src), "mean")
        smooth = F.transform("mean", lambda x: (x + smoothing) / (1 + smoothing * n))
        both = mean.join(prior, list(keys)) if keys else mean.join(F.broadcast(prior))  # one row
        new = F.zip_with(smooth, F.col("prior"), lambda a, b: damping * a + (1 - damping) * b)
        prior = cut(both.select(*keys, P.normalized(new).alias("prior")), "prior")
    return prior


def shifted(df: DataFrame, prior: DataFrame, source_prior: Sequence[float], keys: Sequence[str] = (), strength: float = 1.0) -> DataFrame:
    """Rows reweighted to the prior of their block, raised to ``strength``."""
    src = F.array(*[F.lit(float(x)) for x in source_prior])
    moved = F.transform("prior", lambda x: x) if strength == 1.0 else F.zip_with("prior", src, lambda t, s: s * F.pow(t / s, F.lit(strength)))
    return _with_keyed(df, prior, keys).withColumn("p", P.reweighted(F.col("p"), moved, src)).drop("prior")


def black_box_shift(source_rows: DataFrame, target_rows: DataFrame, label: str, ridge: float = 1e-3) -> list[float]:
    """Target prior from the source's soft confusion: solve (C'C + ridge I) w = C'm for the target's mean
    posterior m; a table of classes by classes is all that reaches the driver."""
    import numpy as np

    c = _keyed_means(source_rows, [label], F.col("p"), "mean").orderBy(label).collect()
    confusion = np.array([r["mean"] for r in c]).T
    m = np.array(_keyed_means(target_rows, [], F.col("p"), "mean").first()["mean"])
    w = np.linalg.solve(confusion.T @ confusion + ridge * np.eye(confusion.shape[1]), confusion.T @ m)
    w = np.maximum(w, 0.0)
    return (w / w.sum()).tolist()


def to_proportions(df: DataFrame, proportions: Sequence[float], keys: Sequence[str] = (), iterations: int = 10, damping: float = 1.0) -> DataFrame:
    """Rows whose class weights are turned until the mean posterior of each block is the given one."""
    from chronoprob.sources.observations import cut

    target = F.array(*[F.lit(float(x)) for x in proportions])
    one = F.array(*[F.lit(1.0)] * len(proportions))
    blocks = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    w = cut(blocks.withColumn("w", one), "proportions") if keys else blocks.withColumn("w", one)
    turned = P.normalized(F.zip_with("p", "w", lambda x, y: x * y))
    for _ in range(iterations):
        mean = _keyed_means(_with_keyed(df.select(*keys, "p"), w, keys), keys, turned, "mean")
        both = mean.join(w, list(keys)) if keys else mean.join(F.broadcast(w))  # one row
        step = F.zip_with(target, "mean", lambda t, m: F.pow(t / F.greatest(m, F.lit(1e-12)), F.lit(damping)))
        w = cut(both.select(*keys, F.zip_with("w", step, lambda a, b: a * b).alias("w")), "proportions")  # of known size
    return _with_keyed(df, w, keys).withColumn("p", turned).drop("w")


def temperature_losses(df: DataFrame, label: str, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, temperature, log_loss) over a grid, in one job."""
    rows = df.select(*keys, label, "p").withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    loss = P.log_loss(P.tempered(F.col("p"), F.col("temperature")), F.col(label))
    return rows.groupBy(*keys, "temperature").agg(F.avg(loss).alias("log_loss"))


def best_temperature(df: DataFrame, label: str, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    return temperature_losses(df, label, grid, keys).groupBy(*keys).agg(F.min(F.struct("log_loss", "temperature")).alias("b")).select(*keys, "b.temperature", "b.log_loss")


def calibrated(df: DataFrame, fit: DataFrame, label: str, mode: str, grid: Sequence[float] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> DataFrame:
    """Rows under a calibrator fitted on ``fit``: none, temperature, class_bias or both in turn. The class
    bias moves the mean posterior of the fitted rows to their label shares."""
    out, known = df, fit
    if "temperature" in mode:
        t = best_temperature(known, label, grid).select("temperature")
        apply = lambda d: d.join(F.broadcast(t)).withColumn("p", P.tempered(F.col("p"), F.col("temperature"))).drop("temperature")  # noqa: E731  one row
        out, known = apply(out), apply(known)
    if "class_bias" in mode:
        hot = F.transform("p", lambda x, i: F.when(i == F.col(label), 1.0).otherwise(0.0))
        share = _keyed_means(known, [], hot, "share").join(F.broadcast(_keyed_means(known, [], F.col("p"), "mean")))  # one row
        bias = share.select(F.zip_with("share", "mean", lambda a, b: F.greatest(a, F.lit(1e-6)) / b).alias("_b"))
        out = out.join(F.broadcast(bias)).withColumn("p", P.normalized(F.zip_with("p", "_b", lambda x, y: x * y))).drop("_b")  # one row
    return out


def confident(df: DataFrame, row: str, min_confidence: float = 0.0, min_margin: float = 0.0, max_entropy: float | None = None, per_class: int | None = None) -> DataFrame:
    """``df`` with ``keep``: rows within all limits, and the best ``per_class`` of each predicted class."""
    p = F.col("p")
    ok = (P.confidence(p) >= min_confidence) & (P.margin(p) >= min_margin)
    if max_entropy is not None:
        ok = ok & (P.entropy(p, True) <= max_entropy)
    out = df.withColumn("keep", ok)
    if per_class is not None:
        keyed = out.withColumns({"_class": P.predicted_index(p), "_conf": P.confidence(p)})
        out = placed_by_value(keyed, [F.col("_conf").desc(), row], ["_class", "keep"])
        out = out.withColumn("keep", F.col("keep") & (F.col("_place") <= per_class)).drop("_class", "_conf", "_place", "_total")
    return out


def _weighted_sum(parts: Sequence[Column], weights: Sequence[Column | float]) -> Column:
    """Sum of arrays times weights, which may be columns."""
    def times(part: Column, w: Column | float) -> Column:
        if not isinstance(w, Column):
            return F.transform(part, lambda x: x * F.lit(float(w)))
        return P.bound(w, lambda c: F.transform(part, lambda x: x * c))

    out = None
    for part, w in zip(parts, weights, strict=True):
        scaled = times(part, w)
        out = scaled if out is None else F.zip_with(out, scaled, lambda x, y: x + y)
    return out


#: How members are pooled.
ENSEMBLES = ("log", "probability", "confidence_probability", "agreement_probability", "rank")


def ensemble(cube: DataFrame, mode: str = "log", weights: Sequence[float] | None = None, temperatures: Sequence[float] | None = None) -> DataFrame:
    """One ``p`` from the aligned ``cube`` (array of (name, p) in order of name): weighted means of log
    scores, of probabilities, of probabilities that also count by their certainty (one less relative entropy) or
    by their agreement with the plain mean (one less total variation, squared), or the softmax of weighted mean
    ranks, scaled to [0, 1], the later of equal classes higher. Rows have to hold the same number of members."""
    if mode not in ENSEMBLES:
        raise ValueError(f"no such ensemble: {mode}")
    sizes = cube.agg(F.max(F.size("cube")).alias("most"), F.min(F.size("cube")).alias("least")).first()
    if sizes["most"] is None:
        return cube.withColumn("p", F.lit(None).cast("array<double>"))
    size = sizes["most"]
    if sizes["least"] != size or any(len(x) != size for x in (weights, temperatures) if x):
        raise ValueError("every row needs as many members as there are weights and temperatures")
    w = [x / sum(weights) for x in weights] if weights else [1.0 / size] * size
    held = cube.withColumn("_q", F.array(*[P.tempered(F.col("cube")[i]["p"], temperatures[i]) if temperatures else F.col("cube")[i]["p"] for i in range(size)]))
    ps = [F.get("_q", F.lit(i)) for i in range(size)]
    if mode == "log":
        p = P.softmax(_weighted_sum([F.transform(q, lambda x: F.log(F.greatest(x, F.lit(P.EPS)))) for q in ps], w))
    elif mode == "probability":
        p = P.normalized(_weighted_sum(ps, w))
    elif mode == "rank":
        place = lambda q: P.bound(q, lambda a: F.transform(a, lambda x, i: F.size(F.filter(a, lambda y, j: (y < x) | ((y == x) & (j < i)))) / F.greatest(F.lit(1), F.size(a) - 1)))
        p = P.softmax(_weighted_sum([place(q) for q in ps], w))
    else:
        if mode == "confidence_probability":
            part = [F.greatest(F.lit(0.0), 1 - P.entropy(q, True, 1e-12)) for q in ps]
        else:
            mean = F.col("_mean")
            held = held.withColumn("_mean", _weighted_sum(ps, [1.0 / size] * size))
            part = [F.pow(F.greatest(F.lit(0.0), 1 - P.total(F.zip_with(q, mean, lambda x, m: F.abs(x - m))) / 2), F.lit(2.0)) for q in ps]
        held = held.withColumn("_w", F.array(*[c * x for c, x in zip(part, w)]))
        own = [F.get("_w", F.lit(i)) for i in range(size)]
        p = P.normalized(F.when(P.total(F.col("_w")) > 0, _weighted_sum(ps, own)).otherwise(_weighted_sum(ps, w)))
    return held.withColumn("p", p).select(*[c for c in cube.columns if c != "p"], "p")


def stacking_weights(cube: DataFrame, label: str, n: int, steps: int = 250, rate: float = 0.25, pooling: str = "linear", eps: float = 1e-12) -> list[float]:
    """Simplex weights of a pool of ``n`` candidates by exponentiated gradients, with steps of ``rate`` over the root
    of their number, on the class-balanced log loss. The pool is ``linear``, of probabilities, or ``log``, of their
    logarithms. A step is one job, to which tasks send a number for each candidate. What steps read is written once: of a
    linear pool the true class's probabilities, of a log pool all logarithms, flat, so that Python takes batches whole."""
    import numpy as np
    import pyarrow as pa

    from chronoprob.sources.observations import cut

    from .sequences import matrix

    if pooling not in ("linear", "log"):
        raise ValueError(f"no such pool: {pooling}")
    if n == 1:
        return [1.0]
    y = F.col("y")
    held = cube.select(F.col(label).cast("int").alias("y"), F.transform(F.slice("cube", 1, n), lambda c: P.normalized(F.transform(c["p"], lambda x: F.greatest(x, F.lit(eps))))).alias("q"))
    shown = F.transform("q", lambda q: q[y]) if pooling == "linear" else F.flatten(F.transform("q", lambda q: F.transform(q, lambda x: F.log(x))))
    rows = cut(held.select("y", shown.alias("q")), "stacking")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row for each class
    if None in counts:
        raise ValueError("every row needs a label")
    labels = np.array(sorted(counts))
    shares = 1.0 / np.array([counts[k] for k in labels.tolist()], dtype=float)

    def gradient(w: np.ndarray) -> np.ndarray:
        def partial(batches):
            total, mass = np.zeros(n), 0.0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if not table.num_rows:
                    continue
                y, q = table["y"].to_numpy(), matrix(table["q"])
                s = shares[np.searchsorted(labels, y)]
                if pooling == "linear":
                    g = -q / np.clip(q @ w, eps, 1.0)[:, None]
                else:
                    z = q.reshape(len(y), n, -1)
                    pooled = np.einsum("nik,i->nk", z, w)
                    e = np.exp(pooled - pooled.max(axis=1, keepdims=True))
                    g = np.einsum("nk,nik->ni", e / e.sum(axis=1, keepdims=True), z) - z[np.arange(len(y)), :, y]
                total += s @ g
                mass += s.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array([*total.tolist(), float(mass)])], names=["i", "v"])

        found = {r["i"]: r["v"] for r in rows.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return np.array([found[i] for i in range(n)]) / found[n]

    w = np.full(n, 1.0 / n)
    for i in range(steps):
        g = gradient(w)
        w = w * np.exp(np.clip(-rate / np.sqrt(i + 1.0) * (g - g @ w), -50.0, 50.0))
        w = w / w.sum()
    return w.tolist()


def response_windows(df: DataFrame, sequence: Sequence[str], times: Sequence[float]) -> DataFrame:
    """One row for each sequence: the mean ``p`` of the rows nearest to the requested times."""
    rows = df.withColumn("wanted", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    near = rows.groupBy(*sequence, "wanted").agg(F.min_by("p", F.struct(F.abs(F.col("time") - F.col("wanted")), F.col("time"))).alias("p"))
    return _keyed_means(near, sequence, F.col("p"), "p")


def consensus_weights(df: DataFrame, variant: str, confidence_weight: float = 1.0, balance_weight: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """(variant, w): softmax of a variant's certainty (1 less its rows' mean relative entropy) and of the
    evenness of its mean posterior."""
    shape = df.groupBy(variant).agg(F.avg(P.entropy(F.col("p"), True)).alias("h")).join(_keyed_means(df, [variant], F.col("p"), "m"), variant)
    score = (confidence_weight * (1 - F.col("h")) + balance_weight * P.entropy(P.normalized(F.col("m")), True)) / temperature
    every = Window.partitionBy()  # a row for each variant
    return shape.select(variant, F.exp(score).alias("_e")).select(variant, (F.col("_e") / F.sum("_e").over(every)).alias("w"))


def consensus(df: DataFrame, variant: str, row: str, mode: str = "logit_mean", **scores) -> DataFrame:
    """(row, p): pool of the variants by ``consensus_weights``: of log probabilities (``logit_mean``) or of
    probabilities (``arithmetic_mean``)."""
    if mode not in ("logit_mean", "arithmetic_mean"):
        raise ValueError(f"no such mode: {mode}")
    weights = F.broadcast(consensus_weights(df, variant, **scores))  # one row for each variant
    part = F.transform("p", lambda x: F.log(F.least(F.lit(1.0), F.greatest(x, F.lit(P.EPS)))) * F.col("w") if mode == "logit_mean" else x * F.col("w"))
    parts = df.join(weights, variant).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(variant, part.alias("a")))).alias("_v"))
    pooled = F.aggregate(F.slice("_v", F.lit(2), F.size("_v")), F.get("_v", F.lit(0))["a"], lambda s, v: F.zip_with(s, v["a"], lambda x, y: x + y))
    return parts.select(row, (P.softmax(pooled) if mode == "logit_mean" else P.normalized(pooled)).alias("p"))


def prior_corrected(df: DataFrame, strength: float = 0.5, smoothing: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Rows divided by their batch's mean posterior, smoothed to even shares, raised to ``strength``."""
    from chronoprob.sources.observations import cut

    mean = cut(_keyed_means(df, keys, F.col("p"), "_m"), "means")  # of known size
    even = F.transform("_m", lambda x: (1 - smoothing) * x + smoothing / F.size("_m"))
    return _with_keyed(df, mean, keys).withColumn("p", P.normalized(F.zip_with("p", even, lambda x, m: x / F.pow(m, F.lit(strength))))).drop("_m")


def bundle_mean(df: DataFrame, keys: Sequence[str], seed: str, n: int) -> DataFrame:
    """(keys, p, complete): mean over model seeds; complete where each of ``n`` distinct seeds has one row."""
    counts = df.groupBy(*keys).agg(((F.count("*") == n) & (F.countDistinct(seed) == n)).alias("complete"))
    return _keyed_means(df, keys, F.col("p"), "p").join(counts, list(keys))


def best_candidates(scores: DataFrame, candidate: str, score: str, k: int) -> DataFrame:
    w = Window.orderBy(F.col(score).desc(), candidate)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def affinity_edges(df: DataFrame, n_neighbors: int, gamma: float | None = None, standardize: bool = True, eps: float = 1e-12) -> DataFrame:
    """(src, dst, weight): edges between rows (row_id, x) of which either is among the other's ``n_neighbors`` nearest, the
    smaller id first among equals, with weight exp(-``gamma`` d^2); without ``gamma``, one over twice the exact
    median of the squared distances of all pairs. Rows whose weights sum to no more than ``eps`` have no edges."""
    from . import features as T
    from .augment import median_gamma
    from .decode import nearest_neighbours

    rows = df.select("row_id", "x")
    if standardize:
        out = T.with_stats(rows, T.column_scales(rows, floor=eps, ddof=1), ["loc", "scale"])
        rows = out.withColumn("x", F.transform(F.arrays_zip("x", "loc", "scale"), lambda t: (t["x"] - t["loc"]) / t["scale"])).select("row_id", "x")
    width = median_gamma(rows) if gamma is None else gamma
    rows = rows.withColumn("label", F.lit(0))
    others = nearest_neighbours(rows, rows, n_neighbors + 1).where("row_id <> train_id")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("distance", "train_id"))
    near = others.withColumn("_k", place).where(F.col("_k") <= n_neighbors)
    weight = F.exp(-F.lit(width) * F.col("distance") * F.col("distance")).alias("weight")
    both = near.select(F.col("row_id").alias("src"), F.col("train_id").alias("dst"), weight).unionByName(near.select(F.col("train_id").alias("src"), F.col("row_id").alias("dst"), weight))
    edges = both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    mass = edges.groupBy("src").agg(F.sum("weight").alias("_m")).where(F.col("_m") > eps)
    return edges.join(mass, "src").drop("_m")


def affinity_smoothed(df: DataFrame, n_neighbors: int, alpha: float = 0.5, rounds: int = 50, tolerance: float = 1e-7, gamma: float | None = None, standardize: bool = True) -> tuple[DataFrame, int]:
    """Rows (row_id, x, p) whose probabilities are smoothed over their affinity graph until no entry moves by more
    than ``tolerance`` or ``rounds`` are done; and the number of rounds. The graph is built once."""
    from chronoprob.sources.observations import cut

    return _smoothed(df, cut(affinity_edges(df, n_neighbors, gamma, standardize), "affinity"), "row_id", alpha, rounds, tolerance)


def graph_smoothed(df: DataFrame, edges: DataFrame, row: str, alpha: float = 0.5, iterations: int = 3) -> DataFrame:
    """p <- (1 - alpha) p0 + alpha * weighted mean of the neighbours' p; ``edges`` has src, dst and weight."""
    return _smoothed(df, edges, row, alpha, iterations, None)[0]


def _smoothed(df: DataFrame, edges: DataFrame, row: str, alpha: float, rounds: int, tolerance: float | None) -> tuple[DataFrame, int]:
    """Rows without neighbours keep their p; without ``tolerance`` all rounds are done."""
    from chronoprob.sources.observations import cut

    start = df.select(F.col(row).alias("dst"), F.col("p").alias("p0"))
    now, done = start.withColumnRenamed("p0", "p"), 0
    for done in range(1, rounds + 1):
        long = edges.join(now, "dst").select("src", "weight", F.posexplode("p").alias("k", "v"))
        mean = long.groupBy("src", "k").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))
        near = mean.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("m"))
        step = start.join(near.withColumnRenamed("src", "dst"), "dst", "left")
        mixed = F.when(F.col("m").isNull(), F.col("p0")).otherwise(F.zip_with("p0", "m", lambda a, b: (1 - alpha) * a + alpha * b))
        if tolerance is None:
            now = cut(step.select("dst", mixed.alias("p")), "smoothing")
            continue
        moved = F.array_max(F.zip_with("p", "_old", lambda a, b: F.abs(a - b)))
        after = step.select("dst", mixed.alias("p")).join(now.withColumnRenamed("p", "_old"), "dst")
        after = cut(after.select("dst", "p", moved.alias("moved")), "smoothing")
        now = after.select("dst", "p")
        if (after.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return df.drop("p").join(now.withColumnRenamed("dst", row), row), done
