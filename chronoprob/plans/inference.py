"""Queries on statistical inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.operators import inference as I
from chronoprob.operators import metrics as M

from .fixtures import both
from .metrics import DAY_SQL, FOLD_SQL, SCORED_SQL, days, fold_metrics, rounded
from .registry import query
from .runs import STAGE_SQL, _timecourse


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return days(spark, sf).where("decoder = 'a'").select("subject", F.col("day").alias("time"), "accuracy")


@query("n1_effects", f"WITH {DAY_SQL}, e AS (SELECT subject, day, accuracy FROM dr WHERE decoder = 'a') SELECT subject, day AS time, round(accuracy - 0.2, 9) AS effect, (SELECT count(DISTINCT subject) * count(DISTINCT day) = count(*) FROM e) AS complete FROM e")
def n1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.effects(_daily(spark, sf), "accuracy", 0.2))


CLUSTERS = f"""WITH {DAY_SQL}, e AS (SELECT subject, day AS time, accuracy - 0.2 AS effect FROM dr WHERE decoder = 'a'),
g AS (SELECT perm, subject, CASE WHEN perm > 0 AND CAST('0x' || left(md5('0:' || perm || ':' || subject), 8) AS BIGINT) / 4294967296.0 < 0.5 THEN -1.0 ELSE 1.0 END AS s FROM (SELECT DISTINCT subject FROM e), unnest(range(61)) u(perm)),
t AS (SELECT perm, time, avg(effect * s) / nullif(stddev_samp(effect * s) / sqrt(count(*)), 0) AS t FROM e JOIN g USING (subject) GROUP BY 1, 2),
th AS (SELECT time, quantile_cont(t, 0.95) AS threshold FROM t WHERE perm > 0 GROUP BY 1), o AS (SELECT time, t AS o FROM t WHERE perm = 0),
pv AS (SELECT time, (1 + count(*) FILTER (WHERE t >= o)) / (count(*) + 1.0) AS p_value FROM t JOIN o USING (time) WHERE perm > 0 GROUP BY 1),
n AS (SELECT perm, time, t, threshold, row_number() OVER (PARTITION BY perm ORDER BY time) AS i FROM t JOIN th USING (time)),
a AS (SELECT *, i - row_number() OVER (PARTITION BY perm ORDER BY time) AS run FROM n WHERE t >= threshold),
m AS (SELECT perm, run, sum(t) AS mass FROM a GROUP BY 1, 2), l AS (SELECT perm, coalesce(max(mass), 0) AS largest FROM (SELECT DISTINCT perm FROM t WHERE perm > 0) LEFT JOIN m USING (perm) GROUP BY 1),
c AS (SELECT run, (1 + count(*) FILTER (WHERE largest >= mass)) / (count(*) + 1.0) AS cluster_p FROM m, l WHERE m.perm = 0 GROUP BY 1, mass)
SELECT time, round(o, 6) AS t, round(threshold, 6) AS threshold, round(p_value, 6) AS p_value, round(cluster_p, 6) AS cluster_p FROM o JOIN th USING (time) JOIN pv USING (time) LEFT JOIN (SELECT time, run FROM a WHERE perm = 0) USING (time) LEFT JOIN c USING (run)"""


@query("n2_max_cluster", CLUSTERS)
def n2(spark: SparkSession, sf: str) -> DataFrame:
    """Sign flips by hash."""
    return rounded(I.max_cluster(I.effects(_daily(spark, sf), "accuracy", 0.2).select("subject", "time", "effect"), 60), 6)


SIGNS = "su AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS i FROM (SELECT DISTINCT subject FROM df)), sg AS (SELECT perm, subject, CASE WHEN (perm >> i) % 2 = 1 THEN -1.0 ELSE 1.0 END AS s FROM su, unnest(range(CAST(power(2, (SELECT count(*) FROM su)) AS BIGINT))) u(perm))"


@query("n3_paired_sign_flip", f"WITH {SCORED_SQL}, m AS (SELECT subject, decoder, avg(hit) AS accuracy FROM sc GROUP BY 1, 2), df AS (SELECT a.subject, b.accuracy - a.accuracy AS d FROM m a JOIN m b ON a.subject = b.subject AND a.decoder = 'a' AND b.decoder = 'b'), {SIGNS}, pm AS (SELECT perm, avg(d * s) AS mean FROM df JOIN sg USING (subject) GROUP BY 1), o AS (SELECT count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS med FROM df) SELECT 'a' AS first, 'b' AS second, o.n AS n_subjects, round(o.mean, 9) AS mean_difference, round(o.med, 9) AS median_difference, round(avg(CASE WHEN abs(pm.mean) >= abs(o.mean) - 1e-12 THEN 1.0 ELSE 0.0 END), 9) AS p_value FROM pm, o GROUP BY o.n, o.mean, o.med")
def n3(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.scored(both(spark, sf)).groupBy("subject", "decoder").agg(F.avg("hit").alias("accuracy"))
    return rounded(I.sign_flip_p(I.paired(rows, "decoder", "accuracy"), ["first", "second"], 1024))


@query("n4_common_cohort", f"WITH {FOLD_SQL}, m AS (SELECT subject, decoder, avg(accuracy) AS accuracy FROM fr GROUP BY 1, 2), d AS (SELECT a.subject, b.accuracy - a.accuracy AS d FROM m a JOIN m b ON a.subject = b.subject WHERE a.decoder = 'a' AND b.decoder = 'b') SELECT count(*) AS n_subjects, round(avg(d), 9) AS mean_difference, round(stddev_samp(d) / sqrt(count(*)), 9) AS sem FROM d")
def n4(spark: SparkSession, sf: str) -> DataFrame:
    rows = fold_metrics(both(spark, sf)).groupBy("subject", "decoder").agg(F.avg("accuracy").alias("accuracy"))
    return rounded(I.paired(rows, "decoder", "accuracy").agg(F.count("*").alias("n_subjects"), F.avg("d").alias("mean_difference"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("sem")))


@query("n4_paired_t")
def n4_t(spark: SparkSession, sf: str) -> DataFrame:
    """Paired t statistics with p from Student's distribution."""
    rows = fold_metrics(both(spark, sf)).groupBy("subject", "decoder").agg(F.avg("accuracy").alias("accuracy"))
    t = I.paired(rows, "decoder", "accuracy").groupBy("first", "second").agg(I.t_statistic(F.col("d")).alias("t"), F.count("*").alias("n"))
    return rounded(t.withColumn("p_value", M.student_p(F.col("t"), F.col("n") - 1)), 6)


@query("n5_state_summary", f"WITH {STAGE_SQL}, e AS (SELECT true_label AS state, avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM obs GROUP BY 1), t AS (SELECT state, count(*) AS n_times, max(posterior) AS peak FROM gm GROUP BY 1) SELECT state, n_times, round(peak, 9) AS peak, round(accuracy, 9) AS accuracy FROM t JOIN e USING (state)")
def n5(spark: SparkSession, sf: str) -> DataFrame:
    from .fixtures import obs

    t = _timecourse(spark, sf).groupBy("state").agg(F.count("*").alias("n_times"), F.max("posterior").alias("peak"))
    e = M.scored(obs(spark, sf)).groupBy(F.col("true_label").alias("state")).agg(F.avg("hit").alias("accuracy"))
    return rounded(t.join(e, "state"))


@query("d22_student_association", None)
def d22_association(spark: SparkSession, sf: str) -> DataFrame:
    """p of a correlation of confidence and time in each subject."""
    s = M.scored(both(spark, sf)).groupBy("subject").agg(F.corr("conf", "time").alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return rounded(s.withColumn("p_value", M.student_p(t, F.col("n") - 2)), 6)
