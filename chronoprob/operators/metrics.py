"""Calibration and classification metrics of observation tables, as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P

from .ranks import placed_by_value


def scored(df: DataFrame, label: str = "true_label") -> DataFrame:
    """``df`` with the row-wise parts of the metrics: conf, pred, hit, brier, nll, rank."""
    p, y = F.col("p"), F.col(label)
    return df.withColumns({"conf": P.confidence(p), "pred": P.predicted_index(p)}).withColumns({"hit": (F.col("pred") == y).cast("double"), "brier": P.brier(p, y), "nll": P.log_loss(p, y), "rank": P.rank_of(p, y)})


def weighted_mean(x: Column, w: Column | None = None) -> Column:
    return F.avg(x) if w is None else F.sum(x * w) / F.sum(w)


def reliability(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, weight: str | None = None) -> DataFrame:
    """Top-label reliability: every bin of every group, empty ones with null accuracy and confidence."""
    s = scored(df) if "conf" not in df.columns else df
    w = F.col(weight) if weight else None
    stats = s.groupBy(*keys, P.calibration_bin(F.col("conf"), n_bins).alias("bin")).agg(F.count("*").alias("n_samples"), (F.sum(w) if w is not None else F.count("*").cast("double")).alias("weight"), weighted_mean(F.col("hit"), w).alias("accuracy"), weighted_mean(F.col("conf"), w).alias("confidence"))
    groups = stats.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    on = F.col("g.bin") == F.col("s.bin")
    for k in keys:
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}"))
    out = grid.alias("g").join(stats.alias("s"), on, "left")
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("g.bin").alias("bin"), F.coalesce("s.n_samples", F.lit(0)).alias("n_samples"), F.coalesce("s.weight", F.lit(0.0)).alias("weight"), F.col("s.accuracy").alias("accuracy"), F.col("s.confidence").alias("confidence"), (F.col("s.accuracy") - F.col("s.confidence")).alias("gap"))


def ece(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, weight: str | None = None) -> DataFrame:
    """Expected calibration error of each group: the weighted mean of the bins' absolute gaps."""
    s = scored(df) if "conf" not in df.columns else df
    w = F.col(weight) if weight else F.lit(1.0)
    bins = s.groupBy(*keys, P.calibration_bin(F.col("conf"), n_bins).alias("bin")).agg(F.sum(w).alias("w"), F.sum(w * (F.col("hit") - F.col("conf"))).alias("gap"))
    return bins.groupBy(*keys).agg((F.sum(F.abs("gap")) / F.sum("w")).alias("ece"))


def all_metrics(df: DataFrame, keys: Sequence[str], n_bins: int = 10, top_k: Sequence[int] = (1,), weight: str | None = None) -> DataFrame:
    """accuracy, brier, log_loss, ece, top-k accuracies and counts of each group in one pass: sums for each
    bin first, then for each group."""
    s = scored(df)
    w = F.col(weight) if weight else F.lit(1.0)
    sums = {"hit": F.col("hit"), "brier": F.col("brier"), "nll": F.col("nll"), **{f"top{k}": (F.col("rank") <= k).cast("double") for k in top_k}}
    bins = s.groupBy(*keys, P.calibration_bin(F.col("conf"), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * (F.col("hit") - F.col("conf"))).alias("gap"), *[F.sum(w * x).alias(k) for k, x in sums.items()])
    mean = lambda c: F.sum(c) / F.sum("w")
    return bins.groupBy(*keys).agg(F.sum("n").alias("n_test"), mean("hit").alias("accuracy"), mean("brier").alias("brier"), mean("nll").alias("log_loss"), (F.sum(F.abs("gap")) / F.sum("w")).alias("ece"), *[mean(f"top{k}").alias(f"top{k}_accuracy") for k in top_k])


def spread(x: Column, prefix: str) -> list[Column]:
    """mean, sample standard deviation, standard error, median and number."""
    return [F.avg(x).alias(f"{prefix}_mean"), F.stddev_samp(x).alias(f"{prefix}_std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"{prefix}_sem"), F.percentile(x, 0.5).alias(f"{prefix}_median"), F.count(x).alias(f"{prefix}_n")]


def fold_weighted(results: DataFrame, keys: Sequence[str], metrics: Sequence[str], weight: str = "n_test") -> DataFrame:
    """Means over folds weighted by their test rows; folds without a metric do not count for it."""
    w = F.col(weight)
    return results.groupBy(*keys).agg(*[(F.sum(F.col(m) * w) / F.sum(F.when(F.col(m).isNotNull(), w))).alias(m) for m in metrics], F.sum(w).alias(weight))


def over_subjects(subject_rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean and standard error of each metric over subjects."""
    return subject_rows.groupBy(*keys).agg(*[c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_sem"))], F.countDistinct("subject").alias("n_subjects"))


def best_rows(df: DataFrame, keys: Sequence[str], metric: str, smallest: bool = False, tie: Sequence[str] = ("time",)) -> DataFrame:
    """The row with the best metric of each group; null metrics never win, ties go to the first by ``tie``."""
    order = [F.col(metric).asc_nulls_last() if smallest else F.col(metric).desc_nulls_last(), *tie]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(F.col(metric).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def window_means(df: DataFrame, keys: Sequence[str], metric: str, windows: dict[str, tuple[float, float]], time: str = "time") -> DataFrame:
    """Number, mean, sample deviation and error of a metric in named inclusive windows, in one pass."""
    out = []
    for name, (a, b) in windows.items():
        x = F.when(F.col(time).between(a, b), F.col(metric))
        out += [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"), F.stddev_samp(x).alias(f"{name}_std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"{name}_sem")]
    return df.groupBy(*keys).agg(*out)


def confusion(df: DataFrame, keys: Sequence[str] = (), true: str = "true_label", predicted: str = "pred") -> DataFrame:
    return df.groupBy(*keys, true, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, keys: Sequence[str] = (), true: str = "true_label", predicted: str = "pred", participant: str = "subject") -> DataFrame:
    """Recall of each class, rows and participants; missing labels equal one another."""
    hit = F.col(true).eqNullSafe(F.col(predicted))
    return df.groupBy(*keys, true).agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n_trials"), F.countDistinct(participant).alias("n_participants"))


def confusion_pairs(df: DataFrame, keys: Sequence[str] = (), true: str = "true_label", predicted: str = "pred") -> DataFrame:
    """Unordered pairs of confused labels: counts both ways, asymmetry, the count that the margins of the
    error table lead one to expect, and the standardized residual."""
    e = df.where(~F.col(true).eqNullSafe(F.col(predicted))).groupBy(*keys, F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    row, column, whole = (F.sum("n").over(Window.partitionBy(*keys, *k)) for k in (["t"], ["p"], []))
    e = e.withColumn("expected", row * column / whole).withColumn("a", F.least("t", "p")).withColumn("b", F.greatest("t", "p"))
    out = e.groupBy(*keys, "a", "b").agg(F.sum(F.when(F.col("t") == F.col("a"), F.col("n")).otherwise(0)).alias("a_to_b"), F.sum(F.when(F.col("t") == F.col("b"), F.col("n")).otherwise(0)).alias("b_to_a"), F.sum("n").alias("total"), F.sum("expected").alias("expected"))
    return out.withColumn("asymmetry", (F.col("a_to_b") - F.col("b_to_a")) / F.col("total")).withColumn("residual", (F.col("total") - F.col("expected")) / F.sqrt("expected"))


def category_matrix(df: DataFrame, category: Column, predicted_category: Column, keys: Sequence[str] = ()) -> DataFrame:
    """True by predicted category: counts, share of the row, and residual against the margins."""
    c = df.groupBy(*keys, category.alias("true_category"), predicted_category.alias("predicted_category")).agg(F.count("*").alias("n"))
    row, column, whole = (F.sum("n").over(Window.partitionBy(*keys, *k)) for k in (["true_category"], ["predicted_category"], []))
    return c.withColumn("row_rate", F.col("n") / row).withColumn("residual", (F.col("n") - row * column / whole) / F.sqrt(row * column / whole))


def category_enrichment(df: DataFrame, category: Column, predicted_category: Column) -> DataFrame:
    """Share of errors within a category against the share that the margins of the errors lead one to expect."""
    c = df.groupBy(category.alias("t"), predicted_category.alias("p")).agg(F.count("*").alias("n"))
    row, column, whole = (F.sum("n").over(Window.partitionBy(*k)) for k in (["t"], ["p"], []))
    c = c.withColumn("e", row * column / whole)
    same = F.col("t") == F.col("p")
    return c.agg(F.sum("n").alias("n_errors"), (F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n")).alias("same_rate"), (F.sum(F.when(same, F.col("e")).otherwise(0.0)) / F.sum("e")).alias("expected_rate"))


def selective(df: DataFrame, conf: str, row: str, hit: str, coverages: Sequence[float]) -> DataFrame:
    """Accuracy of the ceil(n * coverage) most confident rows, and the confidence of the last of them."""
    ranked = placed_by_value(df.select(conf, row, hit), [F.col(conf).desc(), row], place="place", total="n")
    rows = ranked.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).where(F.col("place") <= F.ceil(F.col("n") * F.col("coverage")))
    return rows.groupBy("coverage").agg(F.count("*").alias("n_kept"), F.avg(hit).alias("accuracy"), F.min(conf).alias("threshold"))


def balance_weights(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights inverse to the size of each row's group, with mean one."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    whole = counts.agg((F.sum("_n") / F.count("*")).alias("_mean"))  # one row: rows a group
    weights = counts.join(F.broadcast(whole)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], (F.col("_mean") / F.col("_n")).alias("weight"))
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & df[k].eqNullSafe(weights[f"_k{i}"])
    return df.join(weights, on).drop(*[f"_k{i}" for i in range(len(by))])


def class_prior(df: DataFrame, label: str, smoothing: float = 0.0, uniform: bool = False) -> DataFrame:
    """(label, prior): shares of the labels with additive smoothing, or equal shares."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    raw = F.lit(1.0) if uniform else F.col("n") + F.lit(smoothing)
    return c.select(label, (raw / F.sum(raw).over(every)).alias("prior"))


def bootstrap_interval(subjects: DataFrame, value: str, n: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over subjects, from ``n`` seeded resamples: each draws as many
    subjects as there are, by a hash, and a resample is a group."""
    from chronoprob.functions.vectors import md5_unit

    ranked = subjects.select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy("subject")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("m"))
    draws = ranked.select("m", F.col("i").alias("slot")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("i", F.floor(md5_unit(F.col("rep"), F.col("slot")) * F.col("m")).cast("int"))
    means = draws.join(ranked.select("i", "v"), "i").groupBy("rep").agg(F.avg("v").alias("mean"))
    tail = (1 - level) / 2
    return means.agg(F.count("*").alias("n_bootstrap"), F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def association(df: DataFrame, metric: str, reaction: str, participant: str, at_least: int = 3) -> DataFrame:
    """Pearson r, slope and intercept of a metric on reaction time, for each participant and pooled after
    centering within participants; constant columns and few trials give nulls."""
    def stats(d: DataFrame, keys: Sequence[str]) -> DataFrame:
        few = (F.count("*") < at_least) | (F.stddev_pop(reaction) == 0) | (F.stddev_pop(metric) == 0)
        keep = lambda c: F.when(~few, c)
        # try_divide: no error where a column is constant
        r = F.try_divide(F.covar_pop(reaction, metric), F.stddev_pop(reaction) * F.stddev_pop(metric))
        slope = F.try_divide(F.covar_pop(reaction, metric), F.var_pop(reaction))
        return d.groupBy(*keys).agg(F.count("*").alias("n"), keep(r).alias("r"), keep(slope).alias("slope"), keep(F.avg(metric) - slope * F.avg(reaction)).alias("intercept"))

    w = Window.partitionBy(participant)
    centered = df.withColumns({metric: F.col(metric) - F.avg(metric).over(w), reaction: F.col(reaction) - F.avg(reaction).over(w)})
    return stats(df, [participant]).withColumn(participant, F.col(participant).cast("string")).unionByName(stats(centered.withColumn(participant, F.lit("pooled")), [participant]))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t as the regularized incomplete beta, by a continued fraction in a small
    Arrow function: for tables of statistics, one row for each test."""
    @F.pandas_udf("double")
    def tail(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([_student_two_sided(a, b) for a, b in zip(ts, dfs, strict=True)])

    return tail(t.cast("double"), df.cast("double"))


def _student_two_sided(t: float, df: float) -> float:
    import math

    if t is None or df is None or math.isnan(t) or not df > 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        # modified Lentz evaluation
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
