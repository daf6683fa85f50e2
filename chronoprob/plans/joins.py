"""Queries on alignment joins, interval joins, comparisons and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.operators import joins as J
from chronoprob.operators import labels as L
from chronoprob.operators import metrics as M
from chronoprob.operators import schema as S

from .fixtures import BOTH_SQL, OBS_SQL, annotations, both, obs, table
from .metrics import FOLD_SQL, NAMES, SCORED_SQL, fold_metrics, rounded
from .registry import query
from .tables import GRID_SQL, _grid


@query("c1_alignment_join", f"WITH {BOTH_SQL} SELECT a.event_id, round(a.conf, 9) AS conf_a, round(b.conf, 9) AS conf_b FROM obs a JOIN obs_b b USING (event_id)")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    cube = J.aligned_cube(both(spark, sf), ["event_id"]).where("n = 2 and n_names = 2")
    return cube.select("event_id", F.round(P.confidence(F.col("cube")[0]["p"]), 9).alias("conf_a"), F.round(P.confidence(F.col("cube")[1]["p"]), 9).alias("conf_b"))


@query("c1_alignment_errors", f"WITH {BOTH_SQL}, u AS (SELECT event_id, decoder FROM both_obs WHERE NOT (decoder = 'b' AND event_id % 10 = 0) UNION ALL SELECT event_id, decoder FROM obs WHERE event_id % 25 = 0) SELECT event_id, CASE WHEN count(*) > count(DISTINCT decoder) THEN 'duplicate' ELSE 'missing' END AS status FROM u GROUP BY 1 HAVING count(*) > count(DISTINCT decoder) OR count(DISTINCT decoder) < 2")
def c1_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = both(spark, sf).where("not (decoder = 'b' and event_id % 10 = 0)").unionByName(obs(spark, sf).where("event_id % 25 = 0"))
    return J.alignment_errors(J.aligned_cube(rows, ["event_id"]), 2).select("event_id", "status")


@query("c2_pooled_ece", f"WITH {FOLD_SQL}, b AS (SELECT subject, decoder, bin, sum(hit - conf) AS gap, count(*) AS n FROM sc GROUP BY 1, 2, 3), e AS (SELECT subject, decoder, sum(abs(gap)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2), f AS (SELECT subject, decoder, sum(accuracy * n_test) / sum(n_test) AS accuracy, CAST(sum(n_test) AS BIGINT) AS n_test FROM fr GROUP BY 1, 2) SELECT subject, decoder, round(accuracy, 9) AS accuracy, round(ece, 9) AS ece, n_test, n_test = n AS covered FROM f JOIN e USING (subject, decoder)")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    rows = both(spark, sf)
    keys = ["subject", "decoder"]
    folds = M.fold_weighted(fold_metrics(rows), keys, ["accuracy"])
    pooled = M.ece(rows, keys).join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    both_sides = folds.join(pooled, keys, "full")
    return rounded(both_sides.select(*keys, "accuracy", "ece", "n_test", F.coalesce(F.col("n_test") == F.col("n"), F.lit(False)).alias("covered")))


def _near_events(spark: SparkSession, sf: str) -> DataFrame:
    """Detections: rows that are predicted to be purchases."""
    return obs(spark, sf).where(P.predicted_index(F.col("p")) == 2).select("stream_id", "event_id", F.col("time").alias("onset_time"), F.lit("purchase").alias("stimulus_class"), "subject")


@query("c3_annotation_match")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    """Optimal assignment; SQL does not express it, tests compare with brute force."""
    return J.match_annotations(_near_events(spark, sf), annotations(spark, sf), ["stream_id", "stimulus_class"], 40000.0)


@query("c4_trigger_match")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    presses, triggers = o.where("true_label = 2").select("stream_id", "time"), o.where("true_label in (2, 3)").select("stream_id", (F.col("time") + 30.0).alias("time"))
    return J.match_triggers(presses, triggers, ["stream_id"], 30.0, 60.0)


PRESS_SQL = """press AS (SELECT l_orderkey AS trial_id, l_linenumber AS press, l_linenumber * 0.3 AS start, l_linenumber * 0.3 + 0.1 + l_discount AS stop FROM lineitem)"""


@query("c5_interval_join", f"WITH {GRID_SQL}, {PRESS_SQL} SELECT g.trial_id, window_index, press, round(least(window_stop, stop) - greatest(window_start, start), 9) AS overlap FROM g JOIN press p ON g.trial_id = p.trial_id AND p.start < g.window_stop AND g.window_start < p.stop WHERE least(window_stop, stop) - greatest(window_start, start) > 0")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    press = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trial_id"), n.alias("press"), (n * 0.3).alias("start"), (n * 0.3 + 0.1 + F.col("l_discount")).alias("stop"))
    out = J.interval_overlap(_grid(spark, sf), press, ["trial_id"], 1.0)
    return out.select("trial_id", "window_index", "press", F.round("overlap", 9).alias("overlap"))


@query("c6_reaction_join", "SELECT o.o_custkey AS participant, o.o_orderkey AS trial, round(o.o_totalprice / 1000, 6) AS reaction_time, n FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    rt = J.reaction_times(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 0.001)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial")).agg(F.count("*").alias("n"))
    return rt.join(rows, "trial").select("participant", "trial", F.round("reaction_time", 6).alias("reaction_time"), "n")


@query("c7_cue_duration", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - o_totalprice, 4) AS execution_l_extendedprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    cues = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("cue_duration"))
    out = J.execution_times(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), cues, ["l_orderkey"], ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.round("execution_l_extendedprice", 4).alias("execution_l_extendedprice"))


@query("c8_label_facts", f"WITH {OBS_SQL}, f AS (SELECT true_label AS label, count(*) AS n FROM obs GROUP BY 1) SELECT event_id, a.n AS a_n, b.n AS b_n FROM obs LEFT JOIN f a ON a.label = true_label LEFT JOIN f b ON b.label = pred")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scored(obs(spark, sf)).select("event_id", "true_label", "pred")
    facts = s.groupBy(F.col("true_label").alias("label")).agg(F.count("*").alias("n"))
    return J.with_label_facts(s, facts, "true_label", "pred").select("event_id", "a_n", "b_n")


@query("c9_artifact_diff", f"WITH {FOLD_SQL}, x AS (SELECT subject, fold, accuracy, ece FROM fr WHERE decoder = 'a' AND subject <> 'S1'), y AS (SELECT subject, fold, accuracy, ece FROM fr WHERE decoder = 'b' AND subject <> 'S2') SELECT coalesce(x.subject, y.subject) AS subject, coalesce(x.fold, y.fold) AS fold, CASE WHEN x.subject IS NULL THEN 'left' WHEN y.subject IS NULL THEN 'right' ELSE 'none' END AS missing_side, round(y.accuracy - x.accuracy, 9) AS accuracy_delta, round(y.ece - x.ece, 9) AS ece_delta FROM x FULL JOIN y ON x.subject = y.subject AND x.fold = y.fold")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    m = fold_metrics(both(spark, sf))
    x, y = m.where("decoder = 'a' and subject <> 'S1'"), m.where("decoder = 'b' and subject <> 'S2'")
    return rounded(J.full_difference(x, y, ["subject", "fold"], ["accuracy", "ece"]))


@query("c10_variant_decision", f"WITH {FOLD_SQL}, w AS (SELECT subject, fold, max(CASE WHEN decoder = 'a' THEN accuracy END) AS a, max(CASE WHEN decoder = 'b' THEN accuracy END) AS b FROM fr GROUP BY 1, 2) SELECT subject, fold, round(a, 9) AS a, round(b, 9) AS b, round(b - a, 9) AS delta, CASE WHEN b - a IS NULL THEN 'incomplete' WHEN b - a >= 0.02 THEN 'better' WHEN b - a <= -0.02 THEN 'worse' ELSE 'equal' END AS decision FROM w")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(J.compared(fold_metrics(both(spark, sf)), ["subject", "fold"], "decoder", "a", "b", "accuracy", 0.02))


@query("c11_condition_pivot", f"WITH {SCORED_SQL}, c AS (SELECT decoder, subject, avg(CASE WHEN time >= 864000 THEN hit END) AS observed, avg(CASE WHEN time < 864000 THEN hit END) AS baseline FROM sc GROUP BY 1, 2), g AS (SELECT subject, max(CASE WHEN decoder = 'a' THEN observed - baseline END) AS gain_a, max(CASE WHEN decoder = 'b' THEN observed - baseline END) AS gain_b FROM c GROUP BY 1) SELECT subject, round(gain_a, 9) AS gain_a, round(gain_b, 9) AS gain_b, round(gain_b - gain_a, 9) AS difference FROM g")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scored(both(spark, sf)).withColumn("condition", F.when(F.col("time") >= 864000, "observed").otherwise("baseline"))
    wide = s.groupBy("decoder", "subject").pivot("condition", ["observed", "baseline"]).agg(F.avg("hit"))
    gain = F.col("observed") - F.col("baseline")
    of = lambda d: F.max(F.when(F.col("decoder") == d, gain))
    return rounded(wide.groupBy("subject").agg(of("a").alias("gain_a"), of("b").alias("gain_b"), (of("b") - of("a")).alias("difference")))


@query("c12_delta_vs_source", f"WITH {FOLD_SQL} SELECT x.subject, x.fold AS k, round(x.accuracy - y.accuracy, 9) AS delta FROM fr x JOIN fr y ON x.subject = y.subject AND x.fold = y.fold WHERE x.decoder = 'b' AND y.decoder = 'a'")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    m = fold_metrics(both(spark, sf))
    base = m.where("decoder = 'a'").select("subject", "fold", F.col("accuracy").alias("source_only"))
    return rounded(m.where("decoder = 'b'").join(base, ["subject", "fold"]).select("subject", F.col("fold").alias("k"), (F.col("accuracy") - F.col("source_only")).alias("delta")))


@query("c13_registry_completeness", f"WITH {OBS_SQL}, o AS (SELECT subject, fold, true_label FROM obs WHERE NOT (subject = 'S3' AND true_label = 2)), s AS (SELECT DISTINCT subject FROM o), e AS (SELECT subject, true_label FROM s, (VALUES (0), (1), (2), (3), (9)) v(true_label)), c AS (SELECT subject, true_label, count(*) AS n FROM o GROUP BY 1, 2) SELECT coalesce(e.subject, c.subject) AS subject, coalesce(e.true_label, c.true_label) AS true_label, CASE WHEN c.n IS NULL THEN 'missing' WHEN e.subject IS NULL THEN 'extra' ELSE 'duplicate' END AS status FROM e FULL JOIN c ON e.subject = c.subject AND e.true_label = c.true_label WHERE c.n IS NULL OR e.subject IS NULL OR c.n > 1")
def c13(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).where("not (subject = 'S3' and true_label = 2)")
    expected = o.select("subject").distinct().withColumn("true_label", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 9)))))
    return S.missing_and_extra(expected, o, ["subject", "true_label"])


@query("c14_leakage_audit", "SELECT 0 AS n_common, count(DISTINCT event_id) AS n_trials FROM events")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    split = L.calibration_split(o, [5], [1], ["subject", "true_label"], "event_id", 0)
    audit = S.overlap_count(split.where("role = 'calibration'"), split.where("role = 'evaluation'"), ["event_id"])
    return audit.withColumn("n_common", F.col("n_common").cast("int")).join(F.broadcast(o.agg(F.countDistinct("event_id").alias("n_trials"))))  # one row
