"""Sign-flip inference on subject effects. Signs are bits: of a counter where all flips are enumerated, else
of a hash, so every permutation is a key of one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions.vectors import md5_unit
from chronoprob.sources.observations import cut

from .ranks import grouped_quantile
from .runs import with_runs


def effects(df: DataFrame, metric: str, chance: float, larger_is_better: bool = True) -> DataFrame:
    """(subject, time, effect) with ``complete``: whether every subject has every time."""
    e = (F.col(metric) - F.lit(chance)) * (1.0 if larger_is_better else -1.0)
    grid = df.agg((F.countDistinct("subject") * F.countDistinct("time")).alias("_cells"), F.count("*").alias("_rows"))
    return df.join(F.broadcast(grid)).select("subject", "time", e.alias("effect"), (F.col("_cells") == F.col("_rows")).alias("complete"))  # one row


def _flipped(rows: DataFrame, n: int, seed: int, order: list | None = None) -> DataFrame:
    """``rows`` once for each permutation, with ``sign``; permutation 0 leaves all signs. The sign is a bit of a hash
    of seed, permutation and subject, or, with the subjects' ``order``, of the permutation's number, so that all
    2 to the number of subjects come up; no table of signs is made."""
    each = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n if order is None else 2 ** len(order) - 1))))
    if order is None:
        flip = (F.col("perm") > 0) & (md5_unit(F.lit(seed), F.col("perm"), F.col("subject")) < 0.5)
    else:
        place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("subject")) - 1
        flip = F.floor(F.col("perm") / F.pow(F.lit(2.0), place)).cast("long") % 2 == 1
    return each.withColumn("sign", F.when(flip, -1.0).otherwise(1.0))


def t_statistic(x: Column) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def max_cluster(e: DataFrame, n: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(time, t, threshold, p_value, cluster_p): one-sample t at each time against ``n`` sign flips, with the
    flips' 1 - alpha quantile at each time as threshold, and for runs of times above it the share of flips
    whose largest run weighs as much."""
    # times by permutations, read several times
    t = cut(_flipped(e, n, seed).groupBy("perm", "time").agg(t_statistic(F.col("effect") * F.col("sign")).alias("t")), "sign-flips")
    null = grouped_quantile(t.where("perm > 0"), "t", 1 - alpha, ["time"], "threshold")
    seen = t.where("perm = 0").select("time", F.col("t").alias("_o"))
    point = t.where("perm > 0").join(seen, "time").groupBy("time").agg(((1 + F.count_if(F.col("t") >= F.col("_o"))) / (F.count("*") + 1)).alias("p_value"))
    runs = with_runs(t.join(null, "time").withColumn("score", F.coalesce(F.col("t"), F.lit(float("-inf")))), ["perm"], F.col("threshold"))
    mass = runs.groupBy("perm", "run").agg(F.sum("t").alias("mass"))
    largest = t.select("perm").distinct().join(mass.groupBy("perm").agg(F.max("mass").alias("largest")), "perm", "left").where("perm > 0").select(F.coalesce("largest", F.lit(0.0)).alias("largest"))
    own = mass.where("perm = 0").join(F.broadcast(largest.agg(F.collect_list("largest").alias("_l"))))  # one row of n numbers
    tested = own.select("run", ((1 + F.size(F.filter("_l", lambda x: x >= F.col("mass")))) / (F.size("_l") + 1)).alias("cluster_p"))
    of = runs.where("perm = 0").select("time", "run").join(tested, "run").drop("run")
    return seen.withColumnRenamed("_o", "t").join(null, "time").join(point, "time").join(of, "time", "left")


def sign_flip_p(differences: DataFrame, keys: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, n_subjects, mean_difference, median_difference, p_value): two-sided sign flips of the paired
    differences (subject, d); all of them where 2 to the number of subjects is at most ``n``."""
    # whether so few subjects there are that all flips are taken shows in one more than their number
    few = max(n, 1).bit_length() - 1
    subjects = [r.subject for r in differences.select("subject").distinct().limit(few + 1).collect()]
    means = _flipped(differences, n, seed, sorted(subjects) if len(subjects) <= few else None).groupBy(*keys, "perm").agg(F.avg(F.col("d") * F.col("sign")).alias("mean"))
    seen = differences.groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.avg("d").alias("mean_difference"), F.percentile("d", 0.5).alias("median_difference"))
    both = means.join(seen, keys) if keys else means.join(F.broadcast(seen))  # one row
    as_large = F.count_if(F.abs("mean") >= F.abs("mean_difference") - 1e-12)
    p = as_large / F.count("*")  # permutation 0 is the observed one
    return both.groupBy(*keys, "n_subjects", "mean_difference", "median_difference").agg(p.alias("p_value"))


def paired(rows: DataFrame, name: str, metric: str) -> DataFrame:
    """(first, second, subject, d): differences of all pairs of ``name`` in the subjects that have both."""
    a = rows.select("subject", F.col(name).alias("first"), F.col(metric).alias("_a"))
    b = rows.select("subject", F.col(name).alias("second"), F.col(metric).alias("_b"))
    return a.join(b, "subject").where("first < second").select("first", "second", "subject", (F.col("_b") - F.col("_a")).alias("d"))
