"""Filters, labels, samples, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.functions.vectors import md5_unit

from .ranks import placed


def in_window(df: DataFrame, window: tuple[float, float], time: str = "time") -> DataFrame:
    return df.where(F.col(time).between(*window))


def one_condition(df: DataFrame, **values: str) -> DataFrame:
    """Rows of a condition; the condition columns left open must hold one value each."""
    for c, v in values.items():
        df = df.where(F.col(c) == v)
    open_columns = [c for c in ("decoder", "emission_mode") if c in df.columns and c not in values]
    if open_columns:
        counts = df.agg(*[F.countDistinct(c).alias(c) for c in open_columns]).first()
        if mixed := [c for c in open_columns if counts[c] > 1]:
            raise ValueError(f"several values in {mixed}: choose one")
    return df


def binary_label(source: Column, positive: str, negative: str | None = None, yes: str = "positive", no: str = "negative", case_sensitive: bool = True) -> Column:
    """The positive pattern wins; else the negative pattern, or any other non-null text; else null."""
    flag = "" if case_sensitive else "(?i)"
    rest = source.rlike(flag + negative) if negative else source.isNotNull()
    return F.when(source.rlike(flag + positive), yes).when(rest, no)


def score(mode: str, p: Column, target: Column | int | None = None, column: Column | None = None) -> Column:
    """Confidence, a named column, a class's probability, or the confidence where that class is predicted."""
    if mode == "confidence":
        return P.confidence(p)
    if mode == "column":
        return column
    if mode == "class_probability":
        return F.get(p, F.lit(target) if isinstance(target, int) else target)
    if mode == "predicted_class_confidence":
        return F.when(P.predicted_index(p) == target, P.confidence(p)).otherwise(0.0)
    raise ValueError(f"no such score: {mode}")


def by_class(df: DataFrame, targets: Sequence[int] | None = None) -> DataFrame:
    """One row for each class: stimulus_label, stimulus_class and score."""
    rows = df.select("*", F.posexplode(F.arrays_zip("p", "classes")).alias("stimulus_label", "c"))
    rows = rows.select("*", F.col("c.classes").alias("stimulus_class"), F.col("c.p").alias("score")).drop("c")
    return rows.where(F.col("stimulus_label").isin(*targets)) if targets is not None else rows


def ranked_classes(df: DataFrame, top: int, label: str = "true_label") -> DataFrame:
    """true_label_rank, the first ``top`` classes and scores, and whether they hold the true class."""
    r = P.ranking(F.col("p"))
    out = df.withColumn("_r", r).withColumn("true_label_rank", P.rank_of(F.col("p"), F.col(label)))
    for i in range(top):
        out = out.withColumn(f"rank{i + 1}_label", F.col("_r")[i]["class"]).withColumn(f"rank{i + 1}_score", F.col("_r")[i]["score"])
    return out.withColumn("top_hit", F.col("true_label_rank") <= top).drop("_r")


def at_most_per_class(df: DataFrame, label: str, k: int, row: str, seed: int | None = None) -> DataFrame:
    """The first ``k`` rows of each class, or ``k`` drawn by a seed."""
    order = [F.col(row)] if seed is None else [md5_unit(F.lit(seed), F.col(row)), F.col(row)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def selected_domains(df: DataFrame, domain: str, holdout: float, seed: int, at_least: int = 1) -> DataFrame:
    """``df`` with ``selected``: false for a seeded share of the domains."""
    domains = df.select(domain).distinct()
    order = Window.orderBy(md5_unit(F.lit(seed), F.col(domain)), domain)
    n = F.count("*").over(Window.partitionBy())
    held = F.least(F.floor(n * F.lit(holdout)), n - at_least)
    marked = domains.withColumn("selected", F.row_number().over(order) > held)
    return df.join(marked, domain)


def domain_subsets(df: DataFrame, domain: str, size: int) -> DataFrame:
    """All subsets of ``size`` domains, as sorted arrays, grown one domain at a time from the distinct ones."""
    d = df.select(F.col(domain).alias("d")).distinct()
    out = d.select(F.array("d").alias("subset"))
    for _ in range(size - 1):
        out = out.join(d, F.col("d") > F.element_at("subset", -1)).select(F.concat("subset", F.array("d")).alias("subset"))
    return out


def relabeled(label: Column, overlap: Column, at_least: float, null_label: int = 0) -> Column:
    return F.when(overlap >= at_least, label).otherwise(null_label)


def with_null_class(stimulus: DataFrame, null_rows: DataFrame, label: str, null_label: int) -> DataFrame:
    return stimulus.unionByName(null_rows.withColumn(label, F.lit(null_label).cast(dict(stimulus.dtypes)[label])))


def null_replaced(predicted: Column, null_label: int, fallback: Column | int) -> Column:
    return F.when(predicted == null_label, fallback).otherwise(predicted)


def calibration_split(trials: DataFrame, counts: Sequence[int], seeds: Sequence[int], by: Sequence[str], trial: str, evaluation_at_least: int = 1) -> DataFrame:
    """Role of each trial for every number k of calibration trials and seed: one seeded rank per trial
    within its class makes smaller splits part of larger ones. Splits that leave a class too few
    evaluation trials are left out."""
    seeded = trials.select(*by, trial).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    seeded = seeded.withColumn("_u", md5_unit(F.col("seed"), F.col(trial)))
    ranked = placed(seeded, F.col("_u"), ["_u", trial], ["seed", *by], "rank", "n").drop("_u")
    rows = ranked.withColumn("k", F.explode(F.array(*map(F.lit, counts)))).where(F.col("n") - F.col("k") >= evaluation_at_least)
    return rows.select(*by, trial, "seed", "k", F.when(F.col("rank") <= F.col("k"), "calibration").otherwise("evaluation").alias("role"))


def stratified_folds(df: DataFrame, label: str, row: str, k: int, seed: int) -> DataFrame:
    """Folds that deal each label's rows in turn, in seeded order."""
    drawn = placed(df.withColumn("_u", md5_unit(F.lit(seed), F.col(row))), F.col("_u"), ["_u", row], [label])
    return drawn.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_u", "_place", "_total")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups in folds: groups by falling size dealt there and back, so that folds are alike in size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), group)) - 1
    lap, at = F.floor(place / k), place % k
    folds = sizes.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")).select(group, "fold")
    return df.join(folds, group)


def contiguous_folds(df: DataFrame, order: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Folds of ceil(n / k) rows that follow one another."""
    w = Window.partitionBy(*by)
    n, place = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("fold", F.floor(place / F.ceil(n / k)).cast("int"))


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """Each group's number of test and training rows as the held-out fold: totals less its own, so rows are
    not repeated for each fold."""
    own = df.groupBy(group).agg(F.count("*").alias("n_test"))
    return own.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))


def sample_windows(trials: DataFrame, key: str, width: int, step: int) -> DataFrame:
    """Sample windows of each trial's ``times`` and ``samples`` arrays: place, mean time and samples."""
    starts = F.when(F.size("samples") >= width, F.sequence(F.lit(0), F.size("samples") - width, F.lit(step)))
    rows = trials.withColumn("start", F.explode(starts))
    t = F.slice("times", F.col("start") + 1, width)
    return rows.select(key, "start", (F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / width).alias("center"), F.slice("samples", F.col("start") + 1, width).alias("samples"))
