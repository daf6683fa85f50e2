"""Queries on calibration, classification metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.operators import metrics as M

from .fixtures import BASELINE, BOTH_SQL, EFFECT, FEAT_SQL, OBS_SQL, both, feat, obs, table
from .registry import query

HIT = "CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END"
BRIER = "(" + " + ".join(f"(p{k} - CASE WHEN true_label = {k} THEN 1 ELSE 0 END) * (p{k} - CASE WHEN true_label = {k} THEN 1 ELSE 0 END)" for k in range(5)) + ")"
NLL = "-ln(least(1.0, greatest(ptrue, 1e-15)))"
BIN = "(" + " + ".join(f"CASE WHEN conf >= {i * (1.0 / 10)!r} THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"
RANK = "(1 + " + " + ".join(f"CASE WHEN p{k} > ptrue OR (p{k} = ptrue AND {k} < true_label) THEN 1 ELSE 0 END" for k in range(5)) + ")"
#: Scored rows of both decoders, their fold metrics, and those of a subject and day.
SCORED_SQL = f"{BOTH_SQL}, sc AS (SELECT *, {HIT} AS hit, {BRIER} AS brier, {NLL} AS nll, {BIN} AS bin, {RANK} AS rk, floor(time / 86400) AS day FROM both_obs)"


def _metrics_sql(name: str, keys: str, source: str = "sc", weight: str = "1.0") -> str:
    return f"""{name}_b AS (SELECT {keys}, bin, count(*) AS n, sum({weight}) AS w, sum({weight} * (hit - conf)) AS gap, sum({weight} * hit) AS hit, sum({weight} * brier) AS brier, sum({weight} * nll) AS nll, sum({weight} * CASE WHEN rk <= 2 THEN 1.0 ELSE 0.0 END) AS top2 FROM {source} GROUP BY {keys}, bin),
{name} AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n_test, sum(hit) / sum(w) AS accuracy, sum(brier) / sum(w) AS brier, sum(nll) / sum(w) AS log_loss, sum(abs(gap)) / sum(w) AS ece, sum(top2) / sum(w) AS top2_accuracy FROM {name}_b GROUP BY {keys})"""


FOLD_SQL = f"{SCORED_SQL}, {_metrics_sql('fr', 'subject, decoder, fold')}"
DAY_SQL = f"{SCORED_SQL}, {_metrics_sql('dr', 'subject, decoder, day')}"
NAMES = ("accuracy", "brier", "log_loss", "ece")


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n.split(' AS ')[-1]}" for n in names)


def fold_metrics(df: DataFrame) -> DataFrame:
    return M.all_metrics(df, ["subject", "decoder", "fold"], top_k=(2,))


def days(spark: SparkSession, sf: str) -> DataFrame:
    return M.all_metrics(both(spark, sf).withColumn("day", F.floor(F.col("time") / 86400).cast("double")), ["subject", "decoder", "day"], top_k=(2,))


@query("d1_ece", f"WITH {SCORED_SQL}, {_metrics_sql('m', 'decoder')} SELECT decoder, round(ece, 9) AS ece FROM m")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.ece(both(spark, sf), ["decoder"]))


@query("d2_reliability", f"WITH {SCORED_SQL}, s AS (SELECT decoder, bin, count(*) AS n, avg(hit) AS accuracy, avg(conf) AS confidence FROM sc GROUP BY 1, 2), g AS (SELECT d.decoder, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT decoder FROM sc) d, unnest(range(10)) u(b)) SELECT g.decoder, g.bin, coalesce(n, 0) AS n_samples, CAST(coalesce(n, 0) AS DOUBLE) AS weight, round(accuracy, 9) AS accuracy, round(confidence, 9) AS confidence, round(accuracy - confidence, 9) AS gap FROM g LEFT JOIN s ON g.decoder = s.decoder AND g.bin = s.bin")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.reliability(both(spark, sf), ["decoder"]))


@query("d3_brier", f"WITH {SCORED_SQL} SELECT subject, decoder, round(avg(brier), 9) AS brier FROM sc GROUP BY 1, 2")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scored(both(spark, sf)).groupBy("subject", "decoder").agg(F.avg("brier").alias("brier")))


@query("d4_log_loss", f"WITH {SCORED_SQL} SELECT subject, decoder, round(avg(nll), 9) AS log_loss FROM sc GROUP BY 1, 2")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scored(both(spark, sf)).groupBy("subject", "decoder").agg(F.avg("nll").alias("log_loss")))


@query("d5_top_k_accuracy", f"WITH {SCORED_SQL} SELECT decoder, round(avg(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END), 9) AS top1_accuracy, round(avg(CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END), 9) AS top3_accuracy FROM sc GROUP BY 1")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.all_metrics(both(spark, sf), ["decoder"], top_k=(1, 3)).select("decoder", "top1_accuracy", "top3_accuracy"))


@query("d6_weighted_metrics", f"WITH {SCORED_SQL}, {_metrics_sql('m', 'decoder', weight='value')} SELECT decoder, {r9('accuracy', 'brier', 'log_loss', 'ece', 'top2_accuracy')} FROM m")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.all_metrics(both(spark, sf), ["decoder"], top_k=(2,), weight="value").drop("n_test"))


@query("d7_fold_metrics", f"WITH {FOLD_SQL} SELECT subject, decoder, fold, n_test, {r9('accuracy', 'brier', 'log_loss', 'ece', 'top2_accuracy')} FROM fr")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fold_metrics(both(spark, sf)))


@query("d8_balanced_accuracy", f"WITH {SCORED_SQL}, c AS (SELECT subject, true_label, avg(hit) AS recall FROM sc WHERE decoder = 'a' GROUP BY 1, 2) SELECT subject, round(avg(recall), 9) AS balanced_accuracy FROM c GROUP BY 1")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.per_class(M.scored(obs(spark, sf)), ["subject"]).groupBy("subject").agg(F.avg("accuracy").alias("balanced_accuracy")))


@query("d9_fold_weighted", f"WITH {FOLD_SQL} SELECT subject, decoder, {', '.join(f'round(sum({m} * n_test) / sum(n_test), 9) AS {m}' for m in NAMES)}, CAST(sum(n_test) AS BIGINT) AS n_test FROM fr GROUP BY 1, 2")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.fold_weighted(fold_metrics(both(spark, sf)), ["subject", "decoder"], NAMES))


@query("d10_over_subjects", f"WITH {DAY_SQL} SELECT decoder, day, {', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}) / sqrt(count({m})), 9) AS {m}_sem' for m in NAMES)}, count(DISTINCT subject) AS n_subjects FROM dr GROUP BY 1, 2")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.over_subjects(days(spark, sf), ["decoder", "day"], NAMES))


@query("d11_best_time", f"WITH {DAY_SQL}, a AS (SELECT decoder, day, avg(accuracy) AS accuracy FROM dr GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY decoder ORDER BY round(accuracy, 12) DESC, day) AS n FROM a), w AS (SELECT decoder, avg(CASE WHEN day < 10 THEN accuracy END) AS baseline, avg(CASE WHEN day >= 10 THEN accuracy END) AS effect FROM a GROUP BY 1) SELECT decoder, day AS best_day, {r9('accuracy', 'baseline', 'effect')} FROM b JOIN w USING (decoder) WHERE n = 1")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    a = days(spark, sf).groupBy("decoder", "day").agg(F.avg("accuracy").alias("accuracy"))
    best = M.best_rows(a.withColumn("m", F.round("accuracy", 12)), ["decoder"], "m", tie=("day",))
    means = a.groupBy("decoder").agg(F.avg(F.when(F.col("day") < 10, F.col("accuracy"))).alias("baseline"), F.avg(F.when(F.col("day") >= 10, F.col("accuracy"))).alias("effect"))
    return rounded(best.join(means, "decoder").select("decoder", F.col("day").alias("best_day"), "accuracy", "baseline", "effect"))


@query("d12_summary_table", f"WITH {DAY_SQL} SELECT decoder, round(avg(accuracy), 9) AS accuracy_mean, round(stddev_samp(accuracy), 9) AS accuracy_std, round(stddev_samp(accuracy) / sqrt(count(accuracy)), 9) AS accuracy_sem, round(quantile_cont(accuracy, 0.5), 9) AS accuracy_median, count(accuracy) AS accuracy_n, round(avg(accuracy) * 100, 7) AS accuracy_percent, CAST(count(*) FILTER (WHERE accuracy > 0.2) AS BIGINT) AS above_chance FROM dr GROUP BY 1")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("accuracy")
    return rounded(days(spark, sf).groupBy("decoder").agg(*M.spread(a, "accuracy"), F.round(F.avg(a) * 100, 7).alias("accuracy_percent"), F.count_if(a > 0.2).alias("above_chance")))


WIN_SQL = ", ".join(f"count(CASE WHEN {c} THEN hit END) AS {n}_n, round(avg(CASE WHEN {c} THEN hit END), 9) AS {n}_mean, round(stddev_samp(CASE WHEN {c} THEN hit END), 9) AS {n}_std, round(stddev_samp(CASE WHEN {c} THEN hit END) / sqrt(count(CASE WHEN {c} THEN hit END)), 9) AS {n}_sem" for n, c in (("pre", f"time BETWEEN {BASELINE[0]} AND {BASELINE[1]}"), ("post", f"time BETWEEN {EFFECT[0]} AND {EFFECT[1]}")))


@query("d13_pre_post", f"WITH {SCORED_SQL}, w AS (SELECT subject, decoder, {WIN_SQL} FROM sc GROUP BY 1, 2) SELECT *, round(post_mean - pre_mean, 8) AS difference FROM w")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    w = M.window_means(M.scored(both(spark, sf)), ["subject", "decoder"], "hit", {"pre": BASELINE, "post": EFFECT})
    w = rounded(w)
    return w.withColumn("difference", F.round(F.col("post_mean") - F.col("pre_mean"), 8))


@query("d14_calibration_windows", f"WITH {DAY_SQL} SELECT decoder, {', '.join(f'round(avg(CASE WHEN day < 10 THEN {m} END), 9) AS baseline_{m}, round(avg(CASE WHEN day >= 10 THEN {m} END), 9) AS effect_{m}' for m in ('brier', 'log_loss', 'ece'))} FROM dr GROUP BY 1")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    aggs = [F.avg(F.when(c, F.col(m))).alias(f"{n}_{m}") for m in ("brier", "log_loss", "ece") for n, c in (("baseline", F.col("day") < 10), ("effect", F.col("day") >= 10))]
    return rounded(days(spark, sf).groupBy("decoder").agg(*aggs))


@query("d15_report", f"WITH {DAY_SQL}, s AS (SELECT subject, decoder, max(accuracy) AS peak, avg(accuracy) AS mean, count(*) FILTER (WHERE accuracy > 0.2) AS above FROM dr GROUP BY 1, 2) SELECT subject, round(max(CASE WHEN decoder = 'a' THEN peak END), 9) AS peak_a, round(max(CASE WHEN decoder = 'b' THEN peak END), 9) AS peak_b, round(max(CASE WHEN decoder = 'a' THEN mean END) - max(CASE WHEN decoder = 'b' THEN mean END), 9) AS mean_difference, CAST(sum(above) AS BIGINT) AS days_above_chance FROM s GROUP BY 1")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    s = days(spark, sf).groupBy("subject", "decoder").agg(F.max("accuracy").alias("peak"), F.avg("accuracy").alias("mean"), F.count_if(F.col("accuracy") > 0.2).alias("above"))
    of = lambda d, c: F.max(F.when(F.col("decoder") == d, F.col(c)))
    return rounded(s.groupBy("subject").agg(of("a", "peak").alias("peak_a"), of("b", "peak").alias("peak_b"), (of("a", "mean") - of("b", "mean")).alias("mean_difference"), F.sum("above").alias("days_above_chance")))


@query("d16_confusion", f"WITH {SCORED_SQL} SELECT decoder, true_label, pred, count(*) AS n FROM sc GROUP BY ALL")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(M.scored(both(spark, sf)), ["decoder"])


@query("d17_per_class", f"WITH {SCORED_SQL} SELECT decoder, true_label, round(avg(hit), 9) AS accuracy, count(*) AS n_trials, count(DISTINCT subject) AS n_participants FROM sc GROUP BY 1, 2")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.per_class(M.scored(both(spark, sf)), ["decoder"]))


@query("d18_confusion_pairs", f"WITH {SCORED_SQL}, e AS (SELECT decoder, true_label AS t, pred AS p, count(*) AS n FROM sc WHERE pred <> true_label GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY decoder, t) * sum(n) OVER (PARTITION BY decoder, p) / CAST(sum(n) OVER (PARTITION BY decoder) AS DOUBLE) AS ex FROM e), g AS (SELECT decoder, least(t, p) AS a, greatest(t, p) AS b, CAST(sum(CASE WHEN t < p THEN n ELSE 0 END) AS BIGINT) AS a_to_b, CAST(sum(CASE WHEN t > p THEN n ELSE 0 END) AS BIGINT) AS b_to_a, CAST(sum(n) AS BIGINT) AS total, sum(ex) AS expected FROM x GROUP BY 1, 2, 3) SELECT decoder, a, b, a_to_b, b_to_a, total, round(expected, 6) AS expected, round((a_to_b - b_to_a) / CAST(total AS DOUBLE), 9) AS asymmetry, round((total - expected) / sqrt(expected), 6) AS residual FROM g")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.confusion_pairs(M.scored(both(spark, sf)), ["decoder"]), expected=6, residual=6)


CAT = "CASE WHEN {0} IN (2, 3) THEN 'convert' ELSE 'browse' END"


def _category(c: str):
    return F.when(F.col(c).isin(2, 3), "convert").otherwise("browse")


@query("d19_category_enrichment", f"WITH {OBS_SQL}, e AS (SELECT {CAT.format('true_label')} AS t, {CAT.format('pred')} AS p, count(*) AS n FROM obs WHERE pred <> true_label GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY t) * sum(n) OVER (PARTITION BY p) / CAST(sum(n) OVER () AS DOUBLE) AS ex FROM e) SELECT CAST(sum(n) AS BIGINT) AS n_errors, round(sum(CASE WHEN t = p THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS same_rate, round(sum(CASE WHEN t = p THEN ex ELSE 0 END) / sum(ex), 9) AS expected_rate FROM x")
def d19(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.category_enrichment(M.scored(obs(spark, sf)).where("pred <> true_label"), _category("true_label"), _category("pred")))


@query("d20_category_matrix", f"WITH {OBS_SQL}, c AS (SELECT {CAT.format('true_label')} AS true_category, {CAT.format('pred')} AS predicted_category, count(*) AS n FROM obs GROUP BY ALL), m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY true_category) AS DOUBLE) AS r, sum(n) OVER (PARTITION BY predicted_category) AS k, sum(n) OVER () AS w FROM c) SELECT true_category, predicted_category, n, round(n / r, 9) AS row_rate, round((n - r * k / w) / sqrt(r * k / w), 6) AS residual FROM m")
def d20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.category_matrix(M.scored(obs(spark, sf)), _category("true_label"), _category("pred")), residual=6)


@query("d21_subject_diagnostics", f"WITH {OBS_SQL}, n AS (SELECT subject, event_id, row_number() OVER (PARTITION BY subject ORDER BY abs(time - 1000000), event_id) AS rn FROM obs), g AS (SELECT subject, count(*) AS n_rows, count(DISTINCT true_label) AS n_classes, round(avg({HIT}), 9) AS accuracy FROM obs GROUP BY 1) SELECT g.*, n.event_id AS nearest_event FROM g JOIN n ON n.subject = g.subject AND rn = 1")
def d21(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scored(obs(spark, sf))
    nearest = F.min(F.struct(F.abs(F.col("time") - 1000000), F.col("event_id")))["event_id"]
    return rounded(s.groupBy("subject").agg(F.count("*").alias("n_rows"), F.countDistinct("true_label").alias("n_classes"), F.avg("hit").alias("accuracy"), nearest.alias("nearest_event")))


@query("d22_bootstrap", f"WITH {SCORED_SQL}, s AS (SELECT subject, avg(hit) - 0.2 AS v FROM sc WHERE decoder = 'a' GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS m FROM s), d AS (SELECT rep, CAST(floor(CAST('0x' || left(md5(rep || ':' || i), 8) AS BIGINT) / 4294967296.0 * m) AS BIGINT) AS j FROM r, unnest(range(1, 201)) u(rep)), b AS (SELECT rep, avg(v) AS mean FROM d JOIN r ON r.i = d.j GROUP BY 1) SELECT count(*) AS n_bootstrap, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM b")
def d22(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scored(obs(spark, sf)).groupBy("subject").agg((F.avg("hit") - 0.2).alias("v"))
    return rounded(M.bootstrap_interval(s, "v", 200))


@query("d23_risk_coverage", f"WITH {SCORED_SQL}, r AS (SELECT conf, hit, row_number() OVER (ORDER BY conf DESC, event_id) AS place, count(*) OVER () AS n FROM sc WHERE decoder = 'a') SELECT coverage, count(*) AS n_kept, round(avg(hit), 9) AS accuracy, round(min(conf), 9) AS threshold FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) c(coverage) WHERE place <= ceil(n * coverage) GROUP BY 1")
def d23(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.selective(M.scored(obs(spark, sf)), "conf", "event_id", "hit", [0.1, 0.5, 0.9]))


@query("d24_balance_weights", f"WITH {FEAT_SQL}, i AS (SELECT row_id, label, domain, 1.0 / count(*) OVER (PARTITION BY label, domain) AS i FROM feat) SELECT row_id, round(i / avg(i) OVER (), 9) AS weight FROM i")
def d24(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.balance_weights(feat(spark, sf), ["label", "domain"]).select("row_id", "weight"))


@query("d25_source_prior", f"WITH {FEAT_SQL}, c AS (SELECT label, count(*) AS n FROM feat WHERE role = 'source' GROUP BY 1) SELECT label, round((n + 1.0) / sum(n + 1.0) OVER (), 9) AS prior FROM c")
def d25(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.class_prior(feat(spark, sf).where("role = 'source'"), "label", 1.0))


@query("d26_window_scores", f"WITH {SCORED_SQL}, t AS (SELECT subject, fold, stream_id, avg(hit) AS trial, sum(hit) AS hits, count(*) AS n FROM sc WHERE decoder = 'a' GROUP BY 1, 2, 3), s AS (SELECT subject, fold, avg(trial) AS trial_macro, sum(hits) / sum(n) AS overall FROM t GROUP BY 1, 2), m AS (SELECT subject, avg(trial_macro) AS trial_macro, avg(overall) AS overall FROM s GROUP BY 1) SELECT count(*) AS n_subjects, round(avg(trial_macro), 9) AS trial_macro_mean, round(stddev_samp(trial_macro) / sqrt(count(*)), 9) AS trial_macro_sem, round(avg(overall), 9) AS overall_mean FROM m")
def d26(spark: SparkSession, sf: str) -> DataFrame:
    t = M.scored(obs(spark, sf)).groupBy("subject", "fold", "stream_id").agg(F.avg("hit").alias("trial"), F.sum("hit").alias("hits"), F.count("*").alias("n"))
    s = t.groupBy("subject", "fold").agg(F.avg("trial").alias("trial_macro"), (F.sum("hits") / F.sum("n")).alias("overall"))
    m = s.groupBy("subject").agg(F.avg("trial_macro").alias("trial_macro"), F.avg("overall").alias("overall"))
    return rounded(m.agg(F.count("*").alias("n_subjects"), F.avg("trial_macro").alias("trial_macro_mean"), (F.stddev_samp("trial_macro") / F.sqrt(F.count("*"))).alias("trial_macro_sem"), F.avg("overall").alias("overall_mean")))


@query("d27_shards", f"WITH {FOLD_SQL} SELECT decoder, count(*) AS n_rows, 0 AS n_duplicates, round(avg(accuracy), 9) AS accuracy FROM fr GROUP BY 1")
def d27(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written apart by fold, read together, checked for repeated keys."""
    from chronoprob.operators.schema import duplicate_keys
    from chronoprob.sources.observations import shared_path, write_table

    path = write_table(fold_metrics(both(spark, sf)), shared_path(spark, "shards"), partition_by=("fold",))
    rows = spark.read.parquet(path)
    twice = duplicate_keys(rows, ["subject", "decoder", "fold"]).groupBy("decoder").agg(F.count("*").alias("n_duplicates"))
    out = rows.groupBy("decoder").agg(F.count("*").alias("n_rows"), F.avg("accuracy").alias("accuracy")).join(twice, "decoder", "left")
    return rounded(out.select("decoder", "n_rows", F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"), "accuracy"))


@query("d28_leaderboard", f"WITH {FOLD_SQL}, m AS (SELECT fold AS protocol, decoder AS method, round(avg(accuracy), 9) AS accuracy FROM fr GROUP BY 1, 2) SELECT protocol, method, accuracy, CAST(rank() OVER (PARTITION BY protocol ORDER BY accuracy DESC NULLS LAST) AS INTEGER) AS place FROM m")
def d28(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    m = rounded(fold_metrics(both(spark, sf)).groupBy(F.col("fold").alias("protocol"), F.col("decoder").alias("method")).agg(F.avg("accuracy").alias("accuracy")))
    return m.withColumn("place", F.rank().over(Window.partitionBy("protocol").orderBy(F.col("accuracy").desc_nulls_last())))


@query("d29_column_stats", f"WITH {FEAT_SQL} SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(min(v), 9) AS low, round(max(v), 9) AS high FROM longf WHERE role = 'source' GROUP BY 1")
def d29(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.features import positions

    return rounded(positions(feat(spark, sf).where("role = 'source'")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high")))


RT_SQL = "rt AS (SELECT CAST(o_custkey AS VARCHAR) AS participant, o_totalprice / 1000 AS y, CAST(o_orderkey % 97 AS DOUBLE) AS x FROM orders)"


@query("d30_reaction_association", f"WITH {RT_SQL}, c AS (SELECT 'pooled' AS participant, y - avg(y) OVER (PARTITION BY participant) AS y, x - avg(x) OVER (PARTITION BY participant) AS x FROM rt), u AS (SELECT * FROM rt UNION ALL SELECT * FROM c), s AS (SELECT participant, count(*) AS n, covar_pop(x, y) AS c, stddev_pop(x) AS sx, stddev_pop(y) AS sy, var_pop(x) AS vx, avg(x) AS mx, avg(y) AS my FROM u GROUP BY 1) SELECT participant, n, round(CASE WHEN n >= 3 AND sx > 0 AND sy > 0 THEN c / (sx * sy) END, 5) AS r, round(CASE WHEN n >= 3 AND sx > 0 AND sy > 0 THEN c / vx END, 4) AS slope, round(CASE WHEN n >= 3 AND sx > 0 AND sy > 0 THEN my - c / vx * mx END, 3) + 0.0 AS intercept FROM s")
def d30(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("participant"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") % 97).cast("double").alias("x"))
    a = rounded(M.association(o, "y", "x", "participant"), 5, slope=4, intercept=3)
    return a.withColumn("intercept", F.when(F.col("intercept") == 0, F.lit(0.0)).otherwise(F.col("intercept")))


@query("d31_generalization_summary", f"WITH {SCORED_SQL} SELECT fold AS train_time, floor(time / 604800) AS test_time, round(avg(hit), 9) AS mean, round(quantile_cont(hit, 0.5), 9) AS median, round(avg(hit) - 0.2, 9) AS above_chance, fold = floor(time / 604800) AS is_diagonal FROM sc WHERE decoder = 'a' GROUP BY 1, 2")
def d31(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scored(obs(spark, sf)).withColumn("test_time", F.floor(F.col("time") / 604800).cast("double"))
    g = s.groupBy(F.col("fold").alias("train_time"), "test_time").agg(F.avg("hit").alias("mean"), F.percentile("hit", 0.5).alias("median"), (F.avg("hit") - 0.2).alias("above_chance"))
    return rounded(g.withColumn("is_diagonal", F.col("train_time") == F.col("test_time")))


@query("d33_chance_level", f"WITH {OBS_SQL} SELECT subject, round(1.0 / count(DISTINCT true_label), 9) AS chance FROM obs GROUP BY 1")
def d33(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(obs(spark, sf).groupBy("subject").agg((1.0 / F.countDistinct("true_label")).alias("chance")))


