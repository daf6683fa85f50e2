"""Validation of observation tables: issues, summaries, duplicate keys, coverage, disjointness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P


def validation_issues(df: DataFrame, keys: Sequence[str], row: str = "event_id", tolerance: float = 1e-3, first: int = 20) -> DataFrame:
    """(code, severity, row, value): the first ``first`` offenders of each code.

    Row checks come in one pass; repeated times of a sequence need one grouping. The first offenders of a
    code are found by a top-k of each partition before rows of a code meet.
    """
    t, p = F.col("time").cast("double"), F.col("p")
    sum_off = F.abs(P.total(p) - 1)

    def issue(bad: Column, code: str, value: Column) -> Column:
        return F.when(bad, F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"), value.cast("double").alias("value")))

    outside = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    checks = F.array_compact(F.array(issue(t.isNull(), "time_missing", t), issue(t.isNotNull() & (F.isnan(t) | (F.abs(t) == float("inf"))), "time_not_finite", F.lit(None)), issue(outside, "probability_domain", F.lit(None)), issue(~outside & (sum_off > tolerance), "probability_sum", sum_off)))
    issues = df.select(F.col(row).alias("row"), F.explode(checks).alias("i")).select("row", "i.*")
    repeated = df.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "time"))).where("n > 1")
    issues = issues.unionByName(repeated.select(F.col(row).alias("row"), F.lit("duplicate_time").alias("code"), F.lit("error").alias("severity"), F.col("time").alias("value")))
    near = issues.withColumn("part", F.spark_partition_id()).withColumn("n", F.row_number().over(Window.partitionBy("code", "part").orderBy("row"))).where(F.col("n") <= first)
    return near.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("row"))).where(F.col("n") <= first).select("code", "severity", "row", "value")


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, classes, largest deviation of a row's sum, range and number of times, distinct keys."""
    return df.agg(
        F.count("*").alias("n_rows"), F.max(F.size("p")).alias("n_classes"), F.max(F.abs(P.total(F.col("p")) - 1)).alias("max_sum_deviation"),
        F.min("time").alias("time_min"), F.max("time").alias("time_max"), F.countDistinct("time").alias("n_times"),
        F.countDistinct("subject").alias("n_subjects"), F.countDistinct("stream_id").alias("n_streams"), F.countDistinct("decoder").alias("n_decoders"),
    )


def gated(df: DataFrame, tolerance: float = 1e-6, floor: float | None = None) -> DataFrame:
    """Rows whose ``p`` is no distribution get ``valid`` false; with ``floor`` all rows are renormalized."""
    out = df.withColumn("valid", P.is_distribution(F.col("p"), tolerance))
    return out.withColumn("p", P.normalized(F.col("p"), floor)) if floor is not None else out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with status missing, extra or duplicate; null keys are equal to one another."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    e, o = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).alias("e"), counts.alias("o")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    both = e.join(o, on, "full")
    status = F.when(F.col("o.n").isNull(), "missing").when(F.col("e._e").isNull(), "extra").when(F.col("o.n") > 1, "duplicate")
    return both.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], status.alias("status")).where("status is not null")


def overlap_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys in both tables, which leakage audits require to be none."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("n_common"))


def manifest_status(manifest: DataFrame, files: DataFrame, labels: DataFrame, n_splits: int) -> DataFrame:
    """Status of each manifest row: file there, two classes or more, groups enough for the folds."""
    facts = labels.groupBy("participant").agg(F.countDistinct("label").alias("n_classes"), F.countDistinct("group").alias("n_groups"))
    joined = manifest.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(facts, "participant", "left")
    status = F.when(F.col("there").isNull(), "missing_file").when(F.coalesce("n_classes", F.lit(0)) < 2, "too_few_classes").when(F.col("n_groups") < n_splits, "too_few_groups").otherwise("ok")
    return joined.select("participant", "split", "path", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), status.alias("status"))
