"""Queries on sources, schema, projections, labels, splits, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.functions import vectors as V
from chronoprob.operators import labels as L
from chronoprob.operators import schema as S
from chronoprob.sources import observations as O

from .fixtures import BOTH_SQL, CLASSES, EV_SQL, FEAT_SQL, N_FEATURES, OBS_SQL, both, feat, obs, table
from .registry import query

PS = [f"p{k}" for k in range(5)]
ENTROPY = "-(" + " + ".join(f"p{k} * ln(greatest(p{k}, 1e-15))" for k in range(5)) + ")"


def flat(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(5)])


@query("a1_observation_reader", f"WITH {OBS_SQL} SELECT event_id, stream_id AS sequence_id, subject, 'decoder' AS decoder, 'calibrated' AS emission_mode, round(time, 6) AS time, {', '.join(f'round(p{k}, 9) AS p{k}' for k in range(5))} FROM obs")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    """Wide CSV files without decoder or mode, read with defaults and normalized."""
    rows = O.wide(obs(spark, sf).select("event_id", F.col("stream_id").alias("sample_index"), F.col("subject").alias("group"), "time", "p"), CLASSES)
    path = O.write_table(rows, O.shared_path(spark, "observations"), "csv")
    back = flat(O.read_observations(spark, path, normalize=True))
    return back.select("event_id", F.col("sequence_id").cast("long"), "subject", "decoder", "emission_mode", F.round("time", 6).alias("time"), *[F.round(p, 9).alias(p) for p in PS])


def _fold_results(spark: SparkSession, sf: str) -> DataFrame:
    from .metrics import fold_metrics

    return fold_metrics(both(spark, sf))


@query("a2_results_reader", f"WITH {BOTH_SQL} SELECT subject, decoder, fold, count(*) AS n_test, round(avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM both_obs GROUP BY ALL")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fold_results(spark, sf).withColumn("time", F.lit(0.0)).select("subject", "decoder", "fold", "time", "accuracy", "log_loss", "brier", "ece", "n_test")
    path = O.write_table(rows, O.shared_path(spark, "results"), "csv")
    return O.read_results(spark, path).select("subject", "decoder", "fold", "n_test", F.round("accuracy", 9).alias("accuracy"))


@query("a3_table_sinks", f"WITH {BOTH_SQL} SELECT subject, decoder, count(*) AS n, round(sum(conf), 6) AS sum_conf FROM both_obs GROUP BY ALL")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    path = O.write_table(both(spark, sf), O.shared_path(spark, "sink"), "parquet", ("subject", "decoder"))
    return spark.read.parquet(path).groupBy("subject", "decoder").agg(F.count("*").alias("n"), F.round(F.sum(P.confidence(F.col("p"))), 6).alias("sum_conf"))


@query("a4_standard_columns", f"WITH {EV_SQL} SELECT event_id, round(time, 6) AS time, round(time, 6) AS test_time, round(time, 6) AS train_time, CASE WHEN true_label = 0 THEN 'none' ELSE true_class END AS true_class, 'decoder' AS decoder FROM ev")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).select("event_id", F.col("time").alias("test_time"), F.when(F.col("true_label") == 0, "  ").otherwise(F.col("true_class")).alias("true_class"))
    out = O.standardized(rows, {"true_class": "none", "decoder": "decoder"})
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("time", "test_time", "train_time")], "true_class", "decoder")


@query("a5_decoded_rows", f"WITH {OBS_SQL} SELECT event_id, CAST(pred AS BIGINT) AS predicted_label, ['click','error','purchase','signup','view'][pred + 1] AS predicted_class, round(conf, 9) AS confidence, round(ptrue, 9) AS probability_true_class, pred = true_label AS is_correct FROM obs")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    out = O.from_decoded(obs(spark, sf))
    return out.select("event_id", F.col("predicted_label").cast("long"), "predicted_class", F.round("confidence", 9).alias("confidence"), F.round("probability_true_class", 9).alias("probability_true_class"), "is_correct")


@query("a6_concat", "WITH a AS (SELECT event_id, user_id, NULL AS value FROM events WHERE event_type = 'click'), b AS (SELECT event_id, NULL AS user_id, value FROM events WHERE event_type = 'view') SELECT event_id, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM a UNION ALL SELECT event_id, CAST(user_id AS BIGINT), CAST(value AS DOUBLE) FROM b")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return O.union_all([e.where("event_type = 'click'").select("event_id", "user_id"), e.where("event_type = 'view'").select("event_id", "value")]).select("event_id", "user_id", "value")


@query("a7_probability_columns", f"WITH {OBS_SQL} SELECT " + "unnest(['prob_class_0','prob_class_1','prob_class_2','prob_class_3','prob_class_4']) AS column_name, unnest([round(sum(p0), 6), round(sum(p1), 6), round(sum(p2), 6), round(sum(p3), 6), round(sum(p4), 6)]) AS total FROM obs")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.wide(obs(spark, sf).select("event_id", "p"), CLASSES)
    found = O.probability_columns(rows.columns[::-1])
    sums = rows.agg(*[F.sum(c).alias(c) for c in found])
    return sums.unpivot([], found, "column_name", "total").select("column_name", F.round("total", 6).alias("total"))


BROKEN_SQL = """, bad AS (SELECT event_id, stream_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE floor(time / 3600) END AS time, CASE WHEN event_id % 89 = 0 THEN -0.1 ELSE p0 END AS q0, CASE WHEN event_id % 83 = 0 THEN p1 * 0.5 ELSE p1 END AS q1, p2, p3, p4 FROM obs),
s AS (SELECT *, abs(q0 + q1 + p2 + p3 + p4 - 1) AS off, (q0 < 0) AS outside FROM bad),
issues AS (SELECT 'time_missing' AS code, event_id AS row, CAST(NULL AS DOUBLE) AS value FROM s WHERE time IS NULL
 UNION ALL SELECT 'probability_domain', event_id, NULL FROM s WHERE outside
 UNION ALL SELECT 'probability_sum', event_id, off FROM s WHERE NOT outside AND off > 1e-3
 UNION ALL SELECT 'duplicate_time', event_id, time FROM (SELECT *, count(*) OVER (PARTITION BY stream_id, time) AS n FROM s) WHERE n > 1)"""


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    p = F.transform("p", lambda x, i: F.when((i == 0) & (F.col("event_id") % 89 == 0), -0.1).when((i == 1) & (F.col("event_id") % 83 == 0), x * 0.5).otherwise(x))
    return o.withColumn("p", p).withColumn("time", F.when(F.col("event_id") % 97 != 0, F.floor(F.col("time") / 3600).cast("double")))


@query("a8_validation", f"WITH {OBS_SQL}{BROKEN_SQL} SELECT code, 'error' AS severity, row, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row) AS n FROM issues) WHERE n <= 20")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return S.validation_issues(_broken(spark, sf), ["stream_id"]).withColumn("value", F.round("value", 6))


@query("a9_summary", f"WITH {BOTH_SQL} SELECT count(*) AS n_rows, 5 AS n_classes, round(max(abs(p0+p1+p2+p3+p4 - 1)), 6) AS max_sum_deviation, round(min(time), 6) AS time_min, round(max(time), 6) AS time_max, count(DISTINCT time) AS n_times, count(DISTINCT subject) AS n_subjects, count(DISTINCT stream_id) AS n_streams, count(DISTINCT decoder) AS n_decoders FROM both_obs")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    out = S.summary(both(spark, sf))
    return out.withColumns({"max_sum_deviation": F.round("max_sum_deviation", 6), "time_min": F.round("time_min", 6), "time_max": F.round("time_max", 6)})


@query("a10_probability_gate", f"WITH {OBS_SQL}{BROKEN_SQL}, f AS (SELECT event_id, outside, off, greatest(q0, 0.0) AS a0, q1, p2, p3, p4 FROM s) SELECT event_id, NOT outside AND off <= 1e-6 AS valid, round(a0 / (a0+q1+p2+p3+p4), 9) AS p0, round(q1 / (a0+q1+p2+p3+p4), 9) AS p1 FROM f")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    out = flat(S.gated(_broken(spark, sf), floor=1e-15))
    return out.select("event_id", "valid", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))


@query("a11_row_hash", """SELECT event_id, left(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 16) AS row_hash FROM events""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", O.row_hash("user_id", "event_id", "event_type").alias("row_hash"))


@query("a12_stream_stamp", "SELECT event_id, user_id AS stream_id, 'test' AS split_id, 7 AS slice_seed, 'abc' AS model_hash FROM events")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("stream_id"))
    return O.stamped(rows, split_id="test", slice_seed=7, model_hash="abc")


@query("a13_manifest", "WITH n AS (SELECT unnest(range(1, 6)) AS participant UNION ALL SELECT 8), m AS (SELECT participant, split, 'sub-' || lpad(CAST(participant AS VARCHAR), 2, '0') || '_' || split || '.parquet' AS path FROM n, (VALUES ('train'), ('test')) t(split)) SELECT CAST(m.participant AS INTEGER) AS participant, split, path, count(e.event_id) AS n_rows FROM m LEFT JOIN events e ON e.user_id = m.participant GROUP BY ALL")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest, with the number of rows that each participant has."""
    m = O.expanded_manifest(spark, "1-5,8", ["train", "test"], "sub-{participant}_{split}.parquet")
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n_rows"))
    return m.join(n, m.participant == n.user_id, "left").select("participant", "split", "path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("a14_manifest_status", """WITH n AS (SELECT unnest(range(0, 12)) AS participant), m AS (SELECT CAST(participant AS INTEGER) AS participant, split, 'sub-' || lpad(CAST(participant AS VARCHAR), 2, '0') || '_' || split || '.parquet' AS path FROM n, (VALUES ('train'), ('test')) t(split)),
f AS (SELECT user_id AS participant, count(DISTINCT event_type) AS n_classes, count(DISTINCT event_id % 3) AS n_groups FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT m.participant, split, path, coalesce(n_classes, 0) AS n_classes, coalesce(n_groups, 0) AS n_groups, CASE WHEN split = 'test' AND m.participant % 5 = 0 THEN 'missing_file' WHEN coalesce(n_classes, 0) < 2 THEN 'too_few_classes' WHEN n_groups < 3 THEN 'too_few_groups' ELSE 'ok' END AS status FROM m LEFT JOIN f USING (participant)""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    m = O.expanded_manifest(spark, "0-11", ["train", "test"], "sub-{participant}_{split}.parquet")
    files = m.where("not (split = 'test' and participant % 5 = 0)").select("path")
    labels = table(spark, sf, "events").where("user_id % 4 <> 0").select(F.col("user_id").alias("participant"), F.col("event_type").alias("label"), (F.col("event_id") % 3).alias("group"))
    return S.manifest_status(m, files, labels, 3)


@query("a15_reaction_times", "SELECT o_custkey AS participant, o_orderkey - 1 AS trial, round(o_totalprice * 0.001, 6) AS reaction_time FROM orders WHERE o_totalprice IS NOT NULL")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.joins import reaction_times

    return reaction_times(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice", scale=0.001, trial_base=1).withColumn("reaction_time", F.round("reaction_time", 6))


@query("a16_stream_reader", f"WITH {OBS_SQL} SELECT stream_id, count(*) AS n, round(sum(conf), 6) AS sum_conf FROM obs GROUP BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    path = O.write_table(O.wide(obs(spark, sf).select("stream_id", "time", "p"), CLASSES), O.shared_path(spark, "streams"), "parquet")
    rows = O.read_observations(spark, path, "parquet", stream=True)
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.sum(P.confidence(F.col("p"))), 6).alias("sum_conf"))


@query("a17_precomputed_features", f"WITH {FEAT_SQL}, ids AS (SELECT row_id * 2 AS row_id FROM feat) SELECT ids.row_id, feat.row_id IS NOT NULL AS found, round(x0, 6) AS x0 FROM ids LEFT JOIN feat ON feat.row_id = ids.row_id")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.joins import aligned_features

    f = feat(spark, sf)
    return aligned_features(f.select((F.col("row_id") * 2).alias("row_id")), f.select("row_id", "x"), "row_id").select("row_id", "found", F.round(F.get("x", F.lit(0)), 6).alias("x0"))


GRID_SQL = """t AS (SELECT o_orderkey AS trial_id, 0.0 AS t0, 2.0 + (o_orderkey % 7) * 0.25 AS t1 FROM orders),
g AS (SELECT trial_id, CAST(i AS INTEGER) AS window_index, i * 0.25 AS window_start, i * 0.25 + 0.5 AS window_stop FROM t, unnest(range(0, CAST(floor((t1 - t0 - 0.5) / 0.25 + 1e-9) AS BIGINT) + 1)) u(i))"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), F.lit(0.0).alias("t0"), (2.0 + (F.col("o_orderkey") % 7) * 0.25).alias("t1"))
    return O.window_grid(t, "t0", "t1", 0.5, 0.25)


@query("a18_window_manifest", f"WITH {GRID_SQL} SELECT trial_id, window_index, CAST(window_start AS DOUBLE) AS window_start, CAST(window_stop AS DOUBLE) AS window_stop FROM g")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("trial_id", "window_index", "window_start", "window_stop")


@query("b1_time_window", f"WITH {OBS_SQL} SELECT event_id FROM obs WHERE time BETWEEN 864000 AND 1728000")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return L.in_window(obs(spark, sf), (864000.0, 1728000.0)).select("event_id")


@query("b2_condition", f"WITH {BOTH_SQL} SELECT event_id, decoder FROM both_obs WHERE decoder = 'b'")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return L.one_condition(both(spark, sf), decoder="b", emission_mode="calibrated").select("event_id", "decoder")


@query("b3_regex_label", "SELECT event_id, CASE WHEN regexp_matches(event_type, '^(pur|SIGN)', 'i') THEN 'convert' WHEN regexp_matches(event_type, 'view') THEN 'browse' END AS label FROM events")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", L.binary_label(F.col("event_type"), "^(pur|SIGN)", "view", "convert", "browse", case_sensitive=False).alias("label"))


@query("b4_scores", f"WITH {OBS_SQL} SELECT event_id, round(conf, 9) AS confidence, round(p2, 9) AS class_probability, round(CASE WHEN pred = 2 THEN conf ELSE 0.0 END, 9) AS predicted_class_confidence FROM obs")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    return obs(spark, sf).select("event_id", *[F.round(L.score(m, p, 2), 9).alias(m) for m in ("confidence", "class_probability", "predicted_class_confidence")])


@query("b5_predictions", f"WITH {OBS_SQL} SELECT event_id, pred AS predicted_label, round(conf, 9) AS confidence FROM obs")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).select("event_id", P.predicted_index(F.col("p")).alias("predicted_label"), F.round(P.confidence(F.col("p")), 9).alias("confidence"))


@query("b6_class_rows", f"WITH {OBS_SQL} SELECT event_id, 2 AS stimulus_label, 'purchase' AS stimulus_class, round(p2, 9) AS score FROM obs UNION ALL SELECT event_id, 4, 'view', round(p4, 9) FROM obs")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    return L.by_class(obs(spark, sf), [2, 4]).select("event_id", "stimulus_label", "stimulus_class", F.round("score", 9).alias("score"))


LONG_P = " UNION ALL ".join(f"SELECT event_id, true_label, {k} AS k, p{k} AS v FROM obs" for k in range(5))


@query("b7_top_k", f"WITH {OBS_SQL}, l AS ({LONG_P}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, k) AS rk FROM l) SELECT event_id, CAST(max(CASE WHEN k = true_label THEN rk END) AS INTEGER) AS true_label_rank, max(CASE WHEN rk = 1 THEN k END) AS rank1_label, round(max(CASE WHEN rk = 1 THEN v END), 9) AS rank1_score, max(CASE WHEN rk = 2 THEN k END) AS rank2_label, round(max(CASE WHEN rk = 2 THEN v END), 9) AS rank2_score, max(CASE WHEN k = true_label THEN rk END) <= 2 AS top_hit FROM r GROUP BY event_id")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    out = L.ranked_classes(obs(spark, sf), 2)
    return out.select("event_id", "true_label_rank", "rank1_label", F.round("rank1_score", 9).alias("rank1_score"), "rank2_label", F.round("rank2_score", 9).alias("rank2_score"), "top_hit")


@query("b8_class_sample", "WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, row_number() OVER (PARTITION BY event_type ORDER BY left(md5('7:' || event_id), 8), event_id) AS m FROM events) SELECT 'first' AS kind, event_type, event_id FROM a WHERE n <= 25 UNION ALL SELECT 'seeded', event_type, event_id FROM a WHERE m <= 25")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type")
    pick = lambda kind, seed: L.at_most_per_class(e, "event_type", 25, "event_id", seed).select(F.lit(kind).alias("kind"), "event_type", "event_id")
    return pick("first", None).unionByName(pick("seeded", 7))


@query("b9_domain_mask", f"WITH {OBS_SQL}, d AS (SELECT DISTINCT subject FROM obs), m AS (SELECT subject, row_number() OVER (ORDER BY left(md5('3:' || subject), 8), subject) > least(floor(count(*) OVER () * 0.3), count(*) OVER () - 1) AS selected FROM d) SELECT event_id, subject, selected FROM obs JOIN m USING (subject)")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    return L.selected_domains(obs(spark, sf).select("event_id", "subject"), "subject", 0.3, 3).select("event_id", "subject", "selected")


@query("b9_domain_subsets", f"WITH {OBS_SQL}, d AS (SELECT DISTINCT subject AS s FROM obs) SELECT a.s || ',' || b.s || ',' || c.s AS subset FROM d a, d b, d c WHERE a.s < b.s AND b.s < c.s")
def b9_subsets(spark: SparkSession, sf: str) -> DataFrame:
    return L.domain_subsets(obs(spark, sf), "subject", 3).select(F.array_join("subset", ",").alias("subset"))


@query("b10_overlap_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN l_linenumber ELSE 0 END AS label FROM lineitem")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", L.relabeled(F.col("l_linenumber"), F.col("l_discount"), 0.05).alias("label"))


@query("b11_null_class", f"WITH {FEAT_SQL}, u AS (SELECT row_id, label FROM feat WHERE role = 'source' UNION ALL SELECT row_id, -1 FROM feat WHERE role = 'target') SELECT row_id, label, CASE WHEN label = -1 THEN 0 ELSE label END AS filled FROM u")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf).select("row_id", "label", "role")
    u = L.with_null_class(f.where("role = 'source'"), f.where("role = 'target'"), "label", -1)
    return u.select("row_id", "label", L.null_replaced(F.col("label"), -1, 0).alias("filled"))


@query("b12_calibration_split", f"WITH {OBS_SQL}, s AS (SELECT subject, true_label, event_id, seed FROM obs, (VALUES (1), (2)) v(seed)), r AS (SELECT *, row_number() OVER (PARTITION BY seed, subject, true_label ORDER BY left(md5(seed || ':' || event_id), 8), event_id) AS rk, count(*) OVER (PARTITION BY seed, subject, true_label) AS n FROM s) SELECT subject, true_label, event_id, seed, k, CASE WHEN rk <= k THEN 'calibration' ELSE 'evaluation' END AS role FROM r, (VALUES (5), (10)) w(k) WHERE n - k >= 1")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    return L.calibration_split(obs(spark, sf), [5, 10], [1, 2], ["subject", "true_label"], "event_id")


@query("b13_folds", f"WITH {OBS_SQL}, s AS (SELECT event_id, stream_id, true_label, CAST((row_number() OVER (PARTITION BY true_label ORDER BY left(md5('5:' || event_id), 8), event_id) - 1) % 4 AS INTEGER) AS stratified, CAST(floor((row_number() OVER (ORDER BY time, event_id) - 1) / ceil(count(*) OVER () / 4.0)) AS INTEGER) AS contiguous FROM obs), g AS (SELECT stream_id, row_number() OVER (ORDER BY count(*) DESC, stream_id) - 1 AS place FROM obs GROUP BY 1) SELECT event_id, stratified, contiguous, CAST(CASE WHEN (place // 4) % 2 = 0 THEN place % 4 ELSE 3 - place % 4 END AS INTEGER) AS grouped FROM s JOIN g USING (stream_id)")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).select("event_id", "stream_id", "true_label", "time")
    a = L.stratified_folds(o, "true_label", "event_id", 4, 5).select("event_id", F.col("fold").alias("stratified"))
    b = L.contiguous_folds(o.withColumn("order", F.struct("time", "event_id")), "order", 4).select("event_id", F.col("fold").alias("contiguous"))
    c = L.group_folds(o, "stream_id", 4).select("event_id", F.col("fold").alias("grouped"))
    return a.join(b, "event_id").join(c, "event_id")


@query("b14_leave_one_out", f"WITH {OBS_SQL} SELECT subject, count(*) AS n_test, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM obs GROUP BY subject")
def b14(spark: SparkSession, sf: str) -> DataFrame:
    return L.leave_one_out(obs(spark, sf), "subject")


TRIALS_SQL = "tr AS (SELECT l_orderkey AS trial_id, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS v, list(CAST(l_linenumber AS DOUBLE) / 10 ORDER BY l_linenumber, l_partkey, l_extendedprice) AS t FROM lineitem GROUP BY 1)"


@query("b15_sample_windows", f"WITH {TRIALS_SQL} SELECT trial_id, CAST(s AS INTEGER) AS start, round((t[s + 1] + t[s + 2]) / 2, 9) AS center, round(v[s + 1] + v[s + 2], 2) AS total FROM tr, unnest(range(0, len(v) - 1)) u(s) WHERE len(v) >= 2")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("r"))
    trials = rows.select(F.col("l_orderkey").alias("trial_id"), F.transform("r", lambda x: x["l_extendedprice"]).alias("samples"), F.transform("r", lambda x: x["l_linenumber"].cast("double") / 10).alias("times"))
    w = L.sample_windows(trials, "trial_id", 2, 1)
    return w.select("trial_id", "start", F.round("center", 9).alias("center"), F.round(P.total(F.col("samples")), 2).alias("total"))


@query("f1_ordered", f"WITH {OBS_SQL} SELECT event_id, subject, round(conf, 9) AS conf FROM obs WHERE true_label = 1 ORDER BY subject, conf DESC, event_id")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).where("true_label = 1").select("event_id", "subject", F.round(P.confidence(F.col("p")), 9).alias("conf")).orderBy("subject", F.desc("conf"), "event_id")


@query("f2_best_row", f"WITH {OBS_SQL} SELECT subject, event_id, round(conf, 9) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY conf DESC, event_id) AS n FROM obs) WHERE n = 1")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    best = obs(spark, sf).groupBy("subject").agg(F.max(F.struct(P.confidence(F.col("p")).alias("conf"), (-F.col("event_id")).alias("e"))).alias("b"))
    return best.select("subject", (-F.col("b.e")).alias("event_id"), F.round("b.conf", 9).alias("conf"))


@query("f3_top_features", f"WITH {FEAT_SQL} SELECT CAST(pos AS INTEGER) AS pos, round(var_pop(v), 9) AS score FROM longf WHERE role = 'source' GROUP BY pos ORDER BY var_pop(v) DESC, pos LIMIT 3")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.features import positions

    scores = positions(feat(spark, sf).where("role = 'source'")).groupBy("pos").agg(F.var_pop("v").alias("score"))
    return scores.orderBy(F.desc("score"), "pos").limit(3).select("pos", F.round("score", 9).alias("score"))


@query("f5_coverage_cut", f"WITH {OBS_SQL} SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY conf DESC, event_id) AS n, count(*) OVER () AS c FROM obs) WHERE n <= ceil(c * 0.2)")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.adapt import covered

    return covered(obs(spark, sf).withColumn("conf", P.confidence(F.col("p"))), "conf", "event_id", 0.2).select("event_id")


@query("g1_union", f"WITH {BOTH_SQL} SELECT decoder, count(*) AS n FROM both_obs GROUP BY 1")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return O.union_all([obs(spark, sf), obs(spark, sf, 5, "b")]).groupBy("decoder").agg(F.count("*").alias("n"))


@query("g2_set_checks", "WITH a AS (SELECT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id FROM events WHERE event_type = 'signup') SELECT 'common' AS part, user_id FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b) UNION ALL SELECT 'left', user_id FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b) UNION ALL SELECT 'right', user_id FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM a)")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a, b = e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'signup'").select("user_id")
    part = lambda name, df: df.select(F.lit(name).alias("part"), "user_id")
    return part("common", a.intersect(b)).unionByName(part("left", a.subtract(b))).unionByName(part("right", b.subtract(a)))


@query("g3_duplicates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return S.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


X = [f"x{i}" for i in range(N_FEATURES)]
ABS = ", ".join(f"abs({x})" for x in X)
SUMX = "(" + " + ".join(X) + ")"


@query("h1_row_norms", f"WITH {FEAT_SQL} SELECT row_id, round(x0 / greatest({' + '.join(f'abs({x})' for x in X)}, 1e-12), 9) AS l1, round(x0 / greatest(sqrt({' + '.join(f'{x} * {x}' for x in X)}), 1e-12), 9) AS l2, round(x0 / greatest(greatest({ABS}), 1e-12), 9) AS linf, round((x0 - {SUMX} / {N_FEATURES}) / greatest(sqrt({' + '.join(f'({x} - {SUMX} / {N_FEATURES}) * ({x} - {SUMX} / {N_FEATURES})' for x in X)}), 1e-12), 9) AS centered FROM feat")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    first = lambda a: F.round(F.get(a, F.lit(0)), 9)
    return feat(spark, sf).select("row_id", *[first(V.row_normalized(x, k)).alias(k) for k in ("l1", "l2", "linf")], first(V.row_normalized(x, "l2", center=True)).alias("centered"))


@query("h2_signed_maps", f"WITH {FEAT_SQL} SELECT row_id, round(sign(x1) * ln(1 + abs(x1) / 0.5), 9) AS signed_log, round(sign(x1) * sqrt(abs(x1)), 9) AS signed_sqrt, round(abs(x1), 9) AS absolute FROM feat")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    at = lambda a: F.round(F.get(a, F.lit(1)), 9)
    return feat(spark, sf).select("row_id", at(V.signed_log(x, 0.5)).alias("signed_log"), at(V.signed_power(x, 0.5)).alias("signed_sqrt"), at(F.transform(x, lambda v: F.abs(v))).alias("absolute"))


@query("h3_polynomial", f"WITH {FEAT_SQL} SELECT row_id, {5 + 2 * N_FEATURES} AS n, round(1 + {SUMX} + {' + '.join(f'{x} * {x}' for x in X)} + x0 * (x1 + x2 + x3 + x4), 9) AS total FROM feat")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    p = V.polynomial(F.col("x"), bias=True)
    return feat(spark, sf).select("row_id", F.size(p).alias("n"), F.round(P.total(p), 9).alias("total"))


TOP2 = f"list_sort([{', '.join(PS)}], 'DESC')"


@query("h4_entropy_margin", f"WITH {OBS_SQL} SELECT event_id, round({ENTROPY}, 9) AS entropy, round({ENTROPY} / ln(5), 9) AS relative_entropy, round({TOP2}[1] - {TOP2}[2], 9) AS margin, round(conf, 9) AS confidence FROM obs")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    return obs(spark, sf).select("event_id", F.round(P.entropy(p), 9).alias("entropy"), F.round(P.entropy(p, True), 9).alias("relative_entropy"), F.round(P.margin(p), 9).alias("margin"), F.round(P.confidence(p), 9).alias("confidence"))


@query("h5_softmax", f"WITH {FEAT_SQL} SELECT row_id, round(exp(x0) / ({' + '.join(f'exp({x})' for x in X)}), 9) AS softmax0, round(1 / (1 + exp(-greatest(-50.0, least(50.0, x0 * 100)))), 9) AS logistic FROM feat")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return feat(spark, sf).select("row_id", F.round(F.get(P.softmax(F.col("x")), F.lit(0)), 9).alias("softmax0"), F.round(F.get(P.binary_from_score(F.get("x", F.lit(0)) * 100), F.lit(1)), 9).alias("logistic"))


POW = [f"pow(greatest(p{k}, 1e-15), 0.5)" for k in range(5)]


@query("h6_temperature", f"WITH {OBS_SQL} SELECT event_id, round({POW[0]} / ({' + '.join(POW)}), 9) AS q0, round({POW[4]} / ({' + '.join(POW)}), 9) AS q4 FROM obs")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    q = P.tempered(F.col("p"), 2.0)
    return obs(spark, sf).select("event_id", F.round(F.get(q, F.lit(0)), 9).alias("q0"), F.round(F.get(q, F.lit(4)), 9).alias("q4"))


RATIO = [f"p{k} * {t}" for k, t in enumerate((2.0, 1.0, 0.5, 1.0, 0.5))]


@query("h7_prior_reweighting", f"WITH {OBS_SQL} SELECT event_id, round({RATIO[0]} / ({' + '.join(RATIO)}), 9) AS q0, round({RATIO[2]} / ({' + '.join(RATIO)}), 9) AS q2 FROM obs")
def h7(spark: SparkSession, sf: str) -> DataFrame:
    q = P.reweighted(F.col("p"), F.array(*map(F.lit, (0.4, 0.2, 0.1, 0.2, 0.1))), F.array(*[F.lit(0.2)] * 5))
    return obs(spark, sf).select("event_id", F.round(F.get(q, F.lit(0)), 9).alias("q0"), F.round(F.get(q, F.lit(2)), 9).alias("q2"))


@query("h8_roll_mask", f"WITH {FEAT_SQL} SELECT row_id, round(x{N_FEATURES - 2}, 9) AS wrapped0, round(x{N_FEATURES - 1}, 9) AS wrapped1, 0.0 AS filled1, round(x0, 9) AS filled2, round({' + '.join(X[::2])}, 9) AS masked FROM feat")
def h8(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    at = lambda a, i: F.round(F.get(a, F.lit(i)), 9)
    w, f = V.rolled(x, 2), V.rolled(x, 2, "fill")
    return feat(spark, sf).select("row_id", at(w, 0).alias("wrapped0"), at(w, 1).alias("wrapped1"), at(f, 1).alias("filled1"), at(f, 2).alias("filled2"), F.round(P.total(V.masked(x, lambda i: i % 2 == 0)), 9).alias("masked"))


@query("h9_circular_mean", f"WITH {OBS_SQL} SELECT subject, round(atan2(avg(sin(time / 86400 * 2 * pi())), avg(cos(time / 86400 * 2 * pi()))), 6) AS phase FROM obs GROUP BY 1")
def h9(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.col("time") / 86400 * 2 * F.pi()
    return obs(spark, sf).groupBy("subject").agg(F.round(V.circular_mean(phase), 6).alias("phase"))


@query("h10_hierarchical", f"WITH {OBS_SQL} SELECT event_id, round(1 - conf, 9) AS null_class, round(conf * p0, 9) AS first, round(conf * p4, 9) AS last FROM obs")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    h = P.hierarchical(P.confidence(F.col("p")), F.col("p"))
    return obs(spark, sf).select("event_id", *[F.round(F.get(h, F.lit(i)), 9).alias(n) for i, n in ((0, "null_class"), (1, "first"), (5, "last"))])


@query("h11_json_support", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS support FROM c GROUP BY 1""")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("support"))




@query("f4_top_domains", f"WITH {FEAT_SQL}, m AS (SELECT domain, {', '.join(f'avg(x{i}) AS m{i}' for i in range(N_FEATURES))} FROM feat GROUP BY 1), s AS (SELECT a.domain, -sqrt({' + '.join(f'power(a.m{i} - t.m{i}, 2)' for i in range(N_FEATURES))}) AS score FROM m a, m t WHERE t.domain = 0 AND a.domain <> 0) SELECT domain, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, domain) AS INTEGER) AS place FROM s ORDER BY score DESC, domain LIMIT 2")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.adapt import best_candidates
    from chronoprob.operators.augment import domain_similarity

    best = best_candidates(domain_similarity(feat(spark, sf)), "domain", "score", 2)
    return best.select("domain", F.round("score", 9).alias("score"), "place")
