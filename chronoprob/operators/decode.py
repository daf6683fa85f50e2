"""Decoders and transfer between domains, from sufficient statistics.

Rows have row_id, x, label, domain and role (source or target). Decoders return (row_id, p) with ``p`` in
order of the labels. Class means and covariances are as large as classes and features, so they go to the
rows by broadcast; matrix algebra of that size runs on the driver or in one small group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.functions.vectors import dot, md5_unit, row_normalized, squared_distance

from . import features as T
from .ranks import placed
from .sequences import begins, matrix


def _models(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, labels, means): the classes of each model as arrays in order of label."""
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("_m"))
    return packed.select(*keys, F.transform("_m", lambda m: m["label"]).alias("labels"), F.transform("_m", lambda m: m["mean"]).alias("means"))


def decided(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """predicted: the label with the largest p, the first of equals."""
    return rows.select("row_id", *keep, "p", F.get("labels", P.predicted_index(F.col("p"))).alias("predicted"))


def centroid(train: DataFrame, test: DataFrame, keys: Sequence[str] = (), temperature: float = 1.0, floor: float = 1e-12, shrink: float = 0.0) -> DataFrame:
    """Nearest-centroid decoder for each model key: scaled squared distances to the class means (shrunk to
    the mean of all), softmax(-d / temperature)."""
    p = T.positions(train)
    scale = T.arrays(p.groupBy(*keys, "pos").agg(F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(floor)).alias("scale"), F.avg("v").alias("grand")), ["scale", "grand"], keys)
    models = _models(T.class_means(train.select(*keys, "label", "x"), [*keys, "label"]), keys)
    models = models.join(scale, list(keys)) if keys else models.join(F.broadcast(scale))  # one row
    shrunk = F.transform("means", lambda m: F.zip_with(m, "grand", lambda a, g: (1 - shrink) * a + shrink * g))
    return _nearest(test, models.select(*keys, "labels", "scale", shrunk.alias("means")), keys, temperature)


def _nearest(test: DataFrame, models: DataFrame, keys: Sequence[str], temperature: float) -> DataFrame:
    """Rows against the labels, means and scale of their key's model; one model of all is one row."""
    both = test.join(models, list(keys)) if keys else test.join(F.broadcast(models))
    over = lambda a: F.zip_with(a, "scale", lambda v, s: v / s)
    scores = P.bound(over(F.col("x")), lambda x: F.transform("means", lambda m: -squared_distance(x, over(m)) / temperature))
    return decided(both.withColumn("p", P.softmax(scores)), [*keys, "label"])


def correlated(train: DataFrame, test: DataFrame, weight: str | None = None) -> DataFrame:
    """Prototype decoder: softmax of a row's correlation with each class's mean row. ``weight`` names a column of
    weights of training rows; a class whose weights are all zero counts its rows alike. A row or a mean without
    variation correlates with nothing (0)."""
    means = _models(_weighted_class_means(train, weight) if weight else T.class_means(train.select("label", "x"), ["label"]), [])
    models = means.select("labels", F.transform("means", lambda m: row_normalized(m, "l2", center=True)).alias("means"))
    scores = P.bound(row_normalized(F.col("x"), "l2", center=True), lambda x: F.transform("means", lambda m: dot(x, m)))
    return decided(test.join(F.broadcast(models)).withColumn("p", P.softmax(scores)), ["label"])  # one row


def _weighted_class_means(train: DataFrame, weight: str) -> DataFrame:
    """(label, mean): a (label, pos) is added up in parts, so no class is one task."""
    long = train.select("label", F.col(weight).cast("double").alias("_w"), F.posexplode("x").alias("pos", "v"))
    added = long.groupBy("label", "pos").agg(F.sum(F.col("_w") * F.col("v")).alias("wv"), F.sum("_w").alias("w"), F.avg("v").alias("plain"))
    mean = F.when(F.col("w") > 0, F.col("wv") / F.nullif("w", F.lit(0.0))).otherwise(F.col("plain"))
    return T.arrays(added.select("label", "pos", mean.alias("mean")), ["mean"], ["label"])


def blended_prototypes(source: DataFrame, known: DataFrame, test: DataFrame, prior_strength: float = 4.0, fixed: float | None = None, temperature: float = 1.0, scaled: bool = True, floor: float = 1e-8) -> DataFrame:
    """Nearest prototype, each the source's class mean moved towards the mean of the class's ``known`` target rows: by
    their number over that number and ``prior_strength``, or by ``fixed``. A class without known rows keeps the
    source's mean. Distances are over the standard deviation of all rows but ``test``, unless ``scaled`` is off.
    Known rows of a class that the source lacks are an error."""
    if prior_strength <= 0 or temperature <= 0 or not (fixed is None or 0 <= fixed <= 1):
        raise ValueError("prior_strength and temperature are positive, fixed lies between 0 and 1")
    own = T.class_means(source.select("label", "x"), ["label"])
    other = T.class_means(known.select("label", "x"), ["label"]).join(known.groupBy("label").agg(F.count("*").alias("_n")), "label").select("label", F.col("mean").alias("_k"), "_n")
    if strange := [r.label for r in other.join(own, "label", "left_anti").select("label").collect()]:  # classes
        raise ValueError(f"classes that the source lacks: {sorted(strange)}")
    n = F.coalesce("_n", F.lit(0))
    share = F.lit(float(fixed)) if fixed is not None else n / (n + F.lit(float(prior_strength)))
    moved = F.when(F.col("_k").isNull(), F.col("mean")).otherwise(F.zip_with("mean", "_k", lambda a, b: (1 - share) * a + share * b))
    models = _models(own.join(other, "label", "left").select("label", moved.alias("mean")), [])
    spread = T.positions(source.select("x").unionByName(known.select("x"))).groupBy("pos").agg(F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(floor)).alias("scale"))
    scale = T.arrays(spread.withColumn("scale", F.col("scale") if scaled else F.lit(1.0)), ["scale"])
    return _nearest(test, models.join(F.broadcast(scale)), (), temperature)  # one row each


#: Shapes of the variances of a Gaussian decoder.
COVARIANCES = ("diagonal", "tied_diagonal", "spherical", "tied_spherical")


def gaussian(train: DataFrame, test: DataFrame, covariance: str = "diagonal", prior: str = "empirical", floor: float = 1e-6, temperature: float = 1.0) -> DataFrame:
    """Gaussian decoder with a variance for each class and column (``diagonal``), their mean over columns
    (``spherical``), or one of both kinds for all classes, weighted by their rows (``tied_``)."""
    if covariance not in COVARIANCES or prior not in ("empirical", "uniform"):
        raise ValueError(f"no such decoder: {covariance}, {prior}")
    own = T.positions(train).groupBy("label", "pos").agg(F.avg("v").alias("mean"), F.greatest(F.coalesce(F.var_samp("v"), F.lit(0.0)), F.lit(floor)).alias("var"), F.count("*").alias("n"))
    if covariance.startswith("tied"):  # windows over tables of classes by columns
        every = Window.partitionBy("pos")
        own = own.withColumn("var", F.sum(F.col("var") * F.col("n")).over(every) / F.sum("n").over(every))
    if covariance.endswith("spherical"):
        own = own.withColumn("var", F.avg("var").over(Window.partitionBy("label")))
    own = own.withColumn("var", F.greatest("var", F.lit(floor)))
    per = T.arrays(own, ["mean", "var"], ["label"]).join(own.groupBy("label").agg(F.first("n").alias("n")), "label")
    whole = Window.partitionBy()
    log_prior = F.lit(0.0) if prior == "uniform" else F.log(F.col("n") / F.sum("n").over(whole))
    packed = per.withColumn("prior", log_prior).groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "mean", "var", "prior"))).alias("_c"))
    both = test.join(F.broadcast(packed))  # one row
    likely = F.transform("_c", lambda c: (c["prior"] - P.total(F.zip_with(F.zip_with("x", c["mean"], lambda a, m: (a - m) * (a - m)), c["var"], lambda d, v: (d / v + F.log(v)) / 2))) / temperature)
    out = both.withColumn("labels", F.transform("_c", lambda c: c["label"])).withColumn("p", P.softmax(likely))
    return decided(out, ["label"])


def mahalanobis(train: DataFrame, test: DataFrame, regularization: float = 1e-3, prior: str = "empirical", temperature: float = 1.0) -> DataFrame:
    """Tied full covariance: rows are whitened by the within-class covariance, then the squared distance to the
    class means over the temperature counts against the log prior (``empirical`` or ``uniform``)."""
    if prior not in ("empirical", "uniform"):
        raise ValueError(f"no such prior: {prior}")
    m = sorted(T.moments(train, ["label"]).collect(), key=lambda r: r["label"])  # a row for each class
    d = len(m[0]["s"])
    within = sum(np.array(r["xx"]).reshape(d, d) - np.outer(r["s"], r["s"]) / r["n"] for r in m) / max(1, sum(r["n"] for r in m) - len(m))
    w = T.power(within + regularization * np.eye(d), -0.5)
    shares = np.array([r["n"] for r in m], dtype=float) if prior == "empirical" else np.ones(len(m))
    return _plain_centroid(T.linear(train, w), T.linear(test, w), temperature, np.log(shares / shares.sum()))


def _plain_centroid(train: DataFrame, test: DataFrame, temperature: float = 1.0, log_prior: Sequence[float] | None = None) -> DataFrame:
    models = _models(T.class_means(train.select("label", "x"), ["label"]), [])
    scores = F.transform("means", lambda m: -squared_distance(F.col("x"), m) / temperature)
    if log_prior is not None:
        scores = F.zip_with(scores, F.array(*[F.lit(float(v)) for v in log_prior]), lambda a, b: a + b)
    return decided(test.join(F.broadcast(models)).withColumn("p", P.softmax(scores)), ["label"])  # one row


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int, block: int = 16_384) -> DataFrame:
    """(row_id, place, train_id, distance, label): exact k nearest rows. Training rows are dealt to shares of about
    ``block``, and test rows go to every share; a task holds one share at a time, test rows pass it in small
    batches, and each gets the k best of the share, of which the k best of all are kept."""
    shares = max(1, 2 * train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // block))
    s = train.select(F.pmod(F.xxhash64("row_id"), F.lit(shares)).cast("long").alias("b"), F.lit(0).alias("kind"), F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("int").alias("label"), "x")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("b")
    t = test.select(every, F.lit(1).alias("kind"), F.col("row_id").cast("long").alias("row_id"), F.lit(None).cast("int").alias("label"), "x")

    def best_of(tests: pa.Table, ids: np.ndarray, labels: pa.ChunkedArray, b: np.ndarray, yy: np.ndarray) -> pa.RecordBatch:
        a = matrix(tests["x"])
        xx = (a * a).sum(1)
        rough = xx[:, None] + yy - 2 * a @ b.T
        # wider than twice the product's rounding error; what it lets through is measured exactly
        margin = 16 * (a.shape[1] + 4) * np.finfo(float).eps * (xx + yy.max())
        best = []
        for i in range(len(a)):
            reach = np.partition(rough[i], k - 1)[k - 1] + margin[i] if k < len(b) else np.inf
            near = np.flatnonzero(~(rough[i] > reach))
            d = np.sqrt(((a[i] - b[near]) ** 2).sum(-1))
            order = np.lexsort((ids[near], d))[:k]
            best.append((near[order], d[order]))
        at = np.concatenate([x for x, _ in best])
        rows = np.repeat(tests["row_id"].to_numpy(), [len(x) for x, _ in best])
        found = pa.table([pa.array(rows), pa.array(ids[at]), pa.array(np.concatenate([d for _, d in best])), labels.take(pa.array(at))], ["row_id", "train_id", "distance", "label"])
        return found.combine_chunks().to_batches()[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, ready = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = begins(table, ["b", "kind"]).tolist()
            for i, j in zip(starts, [*starts[1:], table.num_rows]):
                piece = table.slice(i, j - i)
                if piece["b"][0].as_py() != share:
                    share, held, ready = piece["b"][0].as_py(), [], None
                if piece["kind"][0].as_py() == 0:
                    held.append(piece)
                elif held:
                    if ready is None:
                        own = pa.concat_tables(held)
                        b = matrix(own["x"])
                        ready = own["row_id"].to_numpy(), own["label"], b, (b * b).sum(1)
                    for at in range(0, piece.num_rows, 256):
                        yield best_of(piece.slice(at, 256), *ready)

    dealt = s.unionByName(t).repartition(shares, "b").sortWithinPartitions("b", "kind")
    found = dealt.mapInArrow(search, "row_id long, train_id long, distance double, label int")
    w = Window.partitionBy("row_id").orderBy("distance", "train_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def knn(train: DataFrame, test: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """(row_id, predicted, share): votes of the nearest rows, equal or by inverse distance."""
    v = F.lit(1.0) if not weighted else F.lit(1.0) / F.greatest("distance", F.lit(1e-12))
    votes = nearest_neighbours(train, test, k).groupBy("row_id", "label").agg(F.sum(v).alias("v"))
    best = votes.groupBy("row_id").agg(F.max(F.struct("v", (-F.col("label")).alias("l"))).alias("b"), F.sum("v").alias("s"))
    return best.select("row_id", (-F.col("b.l")).alias("predicted"), (F.col("b.v") / F.col("s")).alias("share"))


#: Decoders by name, as factories of Spark estimators over the vector column ``features``.
def registry() -> dict[str, Callable[..., object]]:
    from pyspark.ml import classification as C

    one = lambda make: lambda **k: C.OneVsRest(classifier=make(**k))
    return {
        "logistic": lambda **k: C.LogisticRegression(**{"maxIter": 50, "regParam": 1e-3, **k}),
        "lasso_logistic": lambda **k: C.LogisticRegression(**{"maxIter": 50, "regParam": 1e-2, "elasticNetParam": 1.0, **k}),
        "linear_svm": one(lambda **k: C.LinearSVC(**{"maxIter": 30, "regParam": 1e-3, **k})),
        "forest": lambda **k: C.RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": 1, **k}),
        "boosting": one(lambda **k: C.GBTClassifier(**{"maxIter": 10, "maxDepth": 3, "seed": 1, **k})),
        "naive_bayes": lambda **k: C.NaiveBayes(**{"modelType": "gaussian", **k}),
    }


def normalized_name(name: str) -> str:
    """Decoder names without case, spaces and hyphens, with their aliases."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    return {"lr": "logistic", "logreg": "logistic", "svm": "linear_svm", "svc": "linear_svm", "lasso": "lasso_logistic", "rf": "forest", "random_forest": "forest", "gbt": "boosting", "gradient_boosting": "boosting", "gnb": "naive_bayes"}.get(key, key)


def fit_named(name: str, train: DataFrame, test: DataFrame, weight: str | None = None, **parameters) -> DataFrame:
    """(row_id, label, predicted) of a registered decoder behind a standardizing step."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    vectors = lambda d: d.withColumn("raw", array_to_vector("x")).withColumn("label", F.col("label").cast("double"))
    known, wanted = registry(), normalized_name(name)
    if wanted not in known:
        raise ValueError(f"no decoder is called {name!r}; there are {', '.join(sorted(known))}")
    estimator = known[wanted](**parameters)
    if weight:
        estimator.setWeightCol(weight)
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator]).fit(vectors(train))
    return model.transform(vectors(test)).select("row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def _each(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` once for each value of ``key`` in ``rows``: a table of sums by that key."""
    values = rows.agg(F.collect_set(key).alias("_values"))
    return table.join(F.broadcast(values)).withColumn(key, F.explode("_values")).drop("_values")  # one row


def leave_one_domain_out(df: DataFrame, domain: str = "domain") -> DataFrame:
    """(row_id, domain, label, predicted): nearest class mean of all other domains. Each domain's model is
    the totals of all domains less its own, so no row is copied."""
    own = T.positions(df).groupBy(domain, "label", "pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    totals = own.groupBy("label", "pos").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    grid = _each(totals, own, domain)
    rest = grid.join(own, [domain, "label", "pos"], "left").select(domain, "label", "pos", (F.col("all_s") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    means = T.arrays(rest.withColumn("mean", F.col("s") / F.col("n")), ["mean"], [domain, "label"])
    both = df.join(_models(means, [domain]), domain)
    return decided(both.withColumn("p", P.softmax(F.transform("means", lambda m: -squared_distance(F.col("x"), m)))), [domain, "label"]).drop("p")


def windows_of(df: DataFrame, width: int) -> DataFrame:
    """A row's entries in windows of ``width``: one row for each window, in ``window``."""
    n = F.floor(F.size("x") / width).cast("int")
    return df.withColumn("window", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("x", F.slice("x", F.col("window") * width + 1, F.lit(width)))


def time_resolved(df: DataFrame, width: int, fold: str = "domain") -> DataFrame:
    """(window, fold, accuracy, n): for each window and fold the centroid model of the other folds, from the
    sums of all folds less its own, so that no row is copied."""
    rows = windows_of(df, width).select("row_id", "window", fold, "label", "x")
    sums = {"s": F.sum("v"), "q": F.sum(F.col("v") * F.col("v")), "n": F.count("*")}
    own = T.positions(rows).groupBy("window", fold, "label", "pos").agg(*[a.alias(c) for c, a in sums.items()])
    every = own.groupBy("window", "label", "pos").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    grid = _each(every, own, fold)
    keys = ["window", fold, "label", "pos"]
    rest = grid.join(own, keys, "left").select(*keys, *[(F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums]).where("n > 0")
    means = T.arrays(rest.withColumn("mean", F.col("s") / F.col("n")), ["mean"], ["window", fold, "label"])
    whole = rest.groupBy("window", fold, "pos").agg(*[F.sum(c).alias(c) for c in sums])
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)))
    scale = T.arrays(whole.withColumn("scale", F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(1e-12))), ["scale"], ["window", fold])
    got = _nearest(rows, _models(means, ["window", fold]).join(scale, ["window", fold]), ["window", fold], 1.0)
    return got.groupBy("window", fold).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def temporal_generalization(train: DataFrame, test: DataFrame, width: int) -> DataFrame:
    """(train_window, test_window, accuracy): each window's model on every window's rows; the models of all
    windows are one row."""
    models = _models(T.class_means(windows_of(train, width).select("window", "label", "x"), ["window", "label"]), ["window"]).withColumnRenamed("window", "train_window")
    packed = models.groupBy().agg(F.collect_list(F.struct("train_window", "labels", "means")).alias("_models"))
    both = windows_of(test, width).join(F.broadcast(packed)).withColumn("_m", F.explode("_models")).drop("_models").select("*", "_m.*")  # one row
    got = both.withColumn("p", P.softmax(F.transform("means", lambda m: -squared_distance(F.col("x"), m)))).withColumn("predicted", F.get("labels", P.predicted_index(F.col("p"))))
    return got.groupBy("train_window", F.col("window").alias("test_window")).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def permutation_curve(train: DataFrame, test: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(perm, accuracy): perm 0 is observed; others shuffle training labels by rank in another seeded
    order, as one more model key."""
    base = train.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n))))
    own, drawn = md5_unit(F.lit(seed), F.col("row_id")), md5_unit(F.lit(seed), F.col("perm"), F.col("row_id"))
    rows = placed(base.withColumn("_u", own), F.col("_u"), ["_u", "row_id"], ["perm"], "_i", "_m").drop("_u", "_m")
    mixed = base.select("row_id", "perm", F.col("label").alias("_l"), F.when(F.col("perm") > 0, drawn).otherwise(own).alias("_u"))
    labels = placed(mixed, F.col("_u"), ["_u", "row_id"], ["perm"], "_i", "_m").select("perm", "_i", "_l")
    shuffled = rows.drop("label").join(labels, ["perm", "_i"]).select("row_id", "perm", F.col("_l").alias("label"), "x")
    tests = test.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n))))
    got = centroid(shuffled, tests.select("row_id", "perm", "label", "x"), ["perm"])
    return got.groupBy("perm").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def permutation_p(curve: DataFrame) -> DataFrame:
    observed = F.max(F.when(F.col("perm") == 0, F.col("accuracy")))
    lists = curve.agg(observed.alias("accuracy"), F.collect_list(F.when(F.col("perm") > 0, F.col("accuracy"))).alias("c"))
    return lists.select("accuracy", ((1 + F.size(F.filter("c", lambda x: x >= F.col("accuracy")))) / (F.size("c") + 1)).alias("p_value"))


def coral(df: DataFrame, regularization: float = 1e-3) -> DataFrame:
    """Source rows whitened and given the target's covariance and mean; target rows stay."""
    ms, cs, _ = T.mean_and_covariance(df.where("role = 'source'"))
    mt, ct, _ = T.mean_and_covariance(df.where("role = 'target'"))
    eye = regularization * np.eye(len(ms))
    w = T.power(cs + eye, -0.5) @ T.power(ct + eye, 0.5)
    moved = T.linear(df.where("role = 'source'"), w, ms)
    back = F.array(*[F.lit(float(v)) for v in mt])
    return moved.withColumn("x", F.zip_with("x", back, lambda a, b: a + b)).unionByName(df.where("role = 'target'"))


def _basis(df: DataFrame, k: int) -> np.ndarray:
    _, c, _ = T.mean_and_covariance(df)
    values, vectors = np.linalg.eigh(c)
    return T.signed_columns(vectors[:, np.argsort(values)[::-1][:k]])


def subspace_aligned(df: DataFrame, k: int) -> DataFrame:
    """Source rows on their own axes turned to the target's, target rows on the target's axes."""
    s, t = df.where("role = 'source'"), df.where("role = 'target'")
    bs, bt = _basis(s, k), _basis(t, k)
    return T.linear(s, bs @ (bs.T @ bt)).unionByName(T.linear(t, bt))


def geodesic_features(df: DataFrame, k: int, steps: int) -> DataFrame:
    """Rows on bases sampled along the geodesic from the source's to the target's subspace."""
    bs, bt = _basis(df.where("role = 'source'"), k), _basis(df.where("role = 'target'"), k)
    u, c, vt = np.linalg.svd(bs.T @ bt)
    angles = np.arccos(np.clip(c, -1, 1))
    residual = bt @ vt.T - bs @ u * np.clip(c, -1, 1)
    norms = np.linalg.norm(residual, axis=0)
    q = residual / np.where(norms > 1e-12, norms, 1.0)
    bases = [bs @ u * np.cos(angles * f) + q * np.sin(angles * f) for f in np.linspace(0, 1, steps)]
    return T.linear(df, np.concatenate(bases, axis=1))


def _orthogonal(sets: dict, rounds: int) -> tuple[dict, np.ndarray]:
    """Rotation of each domain's anchors to a template, the mean of the rotated anchors, turned in rounds."""
    template, turns = sets[min(sets)], {}
    for _ in range(rounds):
        for d, a in sets.items():
            u, _, vt = np.linalg.svd(a.T @ template)
            turns[d] = u @ vt
        template = np.mean([sets[d] @ turns[d] for d in sets], axis=0)
    return turns, template


def _multiset(sets: dict, components: int, regularization: float, tolerance: float = 1e-10) -> tuple[dict, np.ndarray]:
    """Multiset canonical correlation: each domain's anchors are whitened, the common axes are the leading ones
    of all whitened anchors side by side, and axes are scaled to unit deviation over all domains' anchors."""
    white, places, start = {}, {}, 0
    for d, a in sets.items():
        values, vectors = np.linalg.eigh(a.T @ a / max(1, len(a) - 1))
        keep = values > tolerance
        white[d] = vectors[:, keep] / np.sqrt(values[keep] + regularization)
        places[d] = slice(start, start := start + int(keep.sum()))
    _, strength, axes = np.linalg.svd(np.hstack([sets[d] @ white[d] for d in sets]), full_matrices=False)
    k = min(components, int((strength > tolerance * strength[0]).sum()))
    turns = {d: white[d] @ axes[:k, places[d]].T for d in sets}
    spread = np.vstack([sets[d] @ turns[d] for d in sets]).std(axis=0)
    turns = {d: w / np.where(spread > 0, spread, 1.0) for d, w in turns.items()}
    return turns, np.mean([sets[d] @ turns[d] for d in sets], axis=0)


def _ridge(sets: dict, regularization: float) -> tuple[dict, np.ndarray]:
    """Ridge regression of the mean of all domains' anchors on each domain's."""
    template = np.mean(list(sets.values()), axis=0)
    return {d: np.linalg.solve(a.T @ a + regularization * np.eye(a.shape[1]), a.T @ template) for d, a in sets.items()}, template


def anchor_alignment(df: DataFrame, domain: str = "domain", rounds: int = 3, mode: str = "orthogonal", components: int = 64, regularization: float = 1e-6) -> tuple[DataFrame, dict]:
    """Rows of each domain, less the mean of its anchors, in a common space. Anchors are the means of the classes
    that all domains have; ``mode`` is orthogonal, mcca or ridge. Matrices of anchors by features are made on the
    driver, and one matrix for each domain goes to its rows."""
    anchors = T.class_means(df.select(domain, "label", "x"), [domain, "label"]).collect()
    by: dict = {}
    for r in anchors:
        by.setdefault(r[domain], {})[r["label"]] = np.array(r["mean"])
    shared = sorted(set.intersection(*[set(v) for v in by.values()]))
    raw = {d: np.stack([by[d][a] for a in shared]) for d in sorted(by)}
    centers = {d: a.mean(axis=0) for d, a in raw.items()}
    sets = {d: a - centers[d] for d, a in raw.items()}
    if mode == "orthogonal":
        turns, template = _orthogonal(sets, rounds)
    elif mode == "mcca":
        turns, template = _multiset(sets, components, regularization)
    elif mode == "ridge":
        turns, template = _ridge(sets, regularization)
    else:
        raise ValueError(f"no such alignment: {mode}")
    types = dict(df.dtypes)
    rows = [(d, turns[d].ravel().tolist(), centers[d].tolist()) for d in turns]
    table = df.sparkSession.createDataFrame(rows, f"{domain} {types[domain]}, turn array<double>, center array<double>")
    n = template.shape[1]
    column = lambda moved, j: P.total(F.transform(moved, lambda v, i: v * F.get("turn", i * n + j)))
    moved = P.bound(F.zip_with("x", "center", lambda a, c: a - c), lambda m: F.array(*[column(m, j) for j in range(n)]))
    out = df.join(table, domain).withColumn("x", moved).drop("turn", "center")

    def likeness(placed: dict) -> float:
        pairs = [(placed[d], placed[e]) for i, d in enumerate(placed) for e in list(placed)[i + 1 :]]
        return float(np.mean([np.corrcoef(a.ravel(), b.ravel())[0, 1] for a, b in pairs])) if pairs else 1.0

    def to_template(placed: dict) -> float:
        return float(np.mean([np.corrcoef(a.ravel(), template.ravel())[0, 1] for a in placed.values()]))

    after = {d: sets[d] @ turns[d] for d in sets}
    facts = {"n_anchors": len(shared), "n_components": n, "likeness_before": likeness(sets), "likeness_after": likeness(after), "after": to_template(after)}
    return out, facts | {"before": to_template(sets) if n == sets[min(sets)].shape[1] else float("nan")}


def few_shot(df: DataFrame, per_class: int, repeats: int, seed: int = 0) -> DataFrame:
    """Target rows left for evaluation under centroids of the source rows and ``per_class`` seeded target rows
    of each class that count ``repeats`` times."""
    known, rest = few_known(df, per_class, seed)
    known = known.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).drop("_r")
    return centroid(df.where("role = 'source'").unionByName(known), rest)


def few_known(df: DataFrame, per_class: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Target rows: the ``per_class`` of each class that a draw puts first, and the others."""
    t = df.where("role = 'target'").withColumn("_u", md5_unit(F.lit(seed), F.col("row_id")))
    split = placed(t, F.col("_u"), ["_u", "row_id"], ["label"], "_n", "_all").drop("_u", "_all")
    return split.where(F.col("_n") <= per_class).drop("_n"), split.where(F.col("_n") > per_class).drop("_n")


def source_free(df: DataFrame, start: DataFrame, threshold: float = 0.3, rounds: int = 3, blend: float = 0.5) -> DataFrame:
    """Target rows relabelled by themselves: confident rows make class means, distances to these make
    probabilities, and these are blended with the start's. ``start`` has row_id and p."""
    from chronoprob.sources.observations import cut

    now = start.select("row_id", "p")
    x = df.select("row_id", "x")
    for _ in range(rounds):
        sure = now.where(P.confidence(F.col("p")) >= threshold).select("row_id", P.predicted_index(F.col("p")).alias("label"))
        means = T.class_means(x.join(sure, "row_id").select("label", "x"), ["label"])
        packed = means.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("_m"))
        both = x.join(now, "row_id").join(F.broadcast(packed))  # one row
        scores = F.transform("p", lambda v, i: F.coalesce(-squared_distance(F.col("x"), F.try_element_at("_m", i)), F.lit(-1e9)))
        again = P.softmax(scores)
        mixed = F.when(F.size("_m") > 0, F.zip_with("p", again, lambda a, b: (1 - blend) * a + blend * b)).otherwise(F.col("p"))
        now = cut(both.select("row_id", mixed.alias("p")), "source-free")
    return now


def reconstruction_error(df: DataFrame, k: int) -> DataFrame:
    """(row_id, error): squared distance of each row to its projection on the source's principal axes."""
    mean, _, _ = T.mean_and_covariance(df.where("role = 'source'"))
    w = _basis(df.where("role = 'source'"), k)
    out = T.linear(df, w @ w.T, mean, to="_r")
    shift = F.array(*[F.lit(float(v)) for v in mean])
    return out.select("row_id", squared_distance(F.zip_with("x", shift, lambda a, b: a - b), F.col("_r")).alias("error"))


def domain_risk(losses: DataFrame, domain: str, loss: Column) -> DataFrame:
    """mean, population variance and number of the domains' mean losses."""
    own = losses.groupBy(domain).agg(F.avg(loss).alias("l"))
    return own.agg(F.avg("l").alias("mean_loss"), F.var_pop("l").alias("variance"), F.count("*").alias("n_domains"))


def decision_windows(df: DataFrame, trial: Sequence[str], mode: str = "mean") -> DataFrame:
    """(trial, p): a trial's windows as one decision, by means of probabilities or of log scores."""
    from .adapt import _keyed_means

    if mode == "mean":
        return _keyed_means(df, trial, F.col("p"), "p")
    logs = F.transform("p", lambda x: F.log(F.greatest(x, F.lit(P.EPS))))
    return _keyed_means(df, trial, logs, "l").select(*trial, P.softmax(F.col("l")).alias("p"))
