"""Queries on thresholds, runs, events, stages and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.operators import joins as J
from chronoprob.operators import labels as L
from chronoprob.operators import runs as R
from chronoprob.operators import schema as S
from chronoprob.operators.ranks import grouped_quantile, quantiles
from chronoprob.sources.observations import cut, shared_path, write_table

from .fixtures import BASELINE, EFFECT, OBS_SQL, annotations, obs
from .metrics import rounded
from .registry import query
from .tables import LONG_P

IN_BASE, IN_EFFECT = f"time BETWEEN {BASELINE[0]} AND {BASELINE[1]}", f"time BETWEEN {EFFECT[0]} AND {EFFECT[1]}"
#: Rows by class, thresholds by subject and class, and runs of two rows or more in the effect window.
CLASS_SQL = f"{OBS_SQL}, cl AS (SELECT o.event_id, o.subject, o.stream_id, o.time, l.k AS stimulus_label, l.v AS score FROM obs o JOIN ({LONG_P}) l USING (event_id)), th AS (SELECT subject, stimulus_label, quantile_cont(score, 0.8) AS score_threshold FROM cl WHERE {IN_BASE} GROUP BY 1, 2)"


def _events_sql(merge_gap: float | None, idle: float | None = None) -> str:
    """Events of the batch; ``idle`` ends runs where no row of the stream comes for so long."""
    apart = "i - pi > 1" + (f" AND time - pt > {merge_gap}" if merge_gap is not None else "")
    silent = f"sum(CASE WHEN gap > {idle} THEN 1 ELSE 0 END) OVER w" if idle is not None else "0"
    return f"""{CLASS_SQL}, n AS (SELECT cl.*, score_threshold, row_number() OVER w AS i FROM cl JOIN th USING (subject, stimulus_label) WHERE {IN_EFFECT} WINDOW w AS (PARTITION BY stream_id, stimulus_label ORDER BY time)),
si AS (SELECT n.*, time - lag(time) OVER (PARTITION BY stream_id, stimulus_label ORDER BY time) AS gap FROM n), sn AS (SELECT *, {silent} AS silence FROM si WINDOW w AS (PARTITION BY stream_id, stimulus_label ORDER BY time)),
ab AS (SELECT *, lag(i) OVER w AS pi, lag(time) OVER w AS pt, lag(silence) OVER w AS ps FROM sn WHERE score >= score_threshold WINDOW w AS (PARTITION BY stream_id, stimulus_label ORDER BY time)),
rn AS (SELECT *, sum(CASE WHEN pi IS NULL OR ps <> silence OR ({apart}) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, stimulus_label ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM ab),
ev2 AS (SELECT subject, stream_id, stimulus_label, run, min(time) AS onset_time, max(time) AS offset_time, count(*) AS run_length, max(score) AS peak_score, list(time ORDER BY time)[2] AS detection_confirmed_time FROM rn GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
pk AS (SELECT e.*, (SELECT min(time) FROM rn r WHERE r.stream_id = e.stream_id AND r.stimulus_label = e.stimulus_label AND r.run = e.run AND r.score = e.peak_score) AS peak_time FROM ev2 e)"""


NAMED = "['click','error','purchase','signup','view'][stimulus_label + 1]"
EVENT_COLUMNS = ("subject", "stream_id", "stimulus_label", "onset_time", "offset_time", "peak_time", "detection_confirmed_time", "run_length", "peak_score")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.by_class(obs(spark, sf))


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return R.point_thresholds(_rows(spark, sf), ["subject", "stimulus_label"], BASELINE, 0.8)


def _events(spark: SparkSession, sf: str, **how) -> DataFrame:
    return R.events(_rows(spark, sf), _thresholds(spark, sf), ["subject"], ["stream_id"], min_consecutive=2, window=EFFECT, **how)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select(*EVENT_COLUMNS, *more), 6)


EVENT_SELECT = "SELECT subject, stream_id, stimulus_label, round(onset_time, 6) AS onset_time, round(offset_time, 6) AS offset_time, round(peak_time, 6) AS peak_time, round(detection_confirmed_time, 6) AS detection_confirmed_time, run_length, round(peak_score, 6) AS peak_score"


@query("e1_point_threshold", f"WITH {CLASS_SQL} SELECT subject, stimulus_label, round(score_threshold, 9) AS score_threshold FROM th")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_thresholds(spark, sf))


@query("e2_max_run_threshold", f"WITH {CLASS_SQL}, s AS (SELECT subject, stimulus_label, stream_id, CASE WHEN count(*) OVER w = 2 THEN min(score) OVER w END AS m FROM cl WHERE {IN_BASE} WINDOW w AS (PARTITION BY stimulus_label, stream_id ORDER BY time ROWS 1 PRECEDING)), b AS (SELECT subject, stimulus_label, stream_id, max(m) AS m FROM s GROUP BY 1, 2, 3 HAVING max(m) IS NOT NULL) SELECT subject, stimulus_label, round(quantile_cont(m, 0.8), 9) AS score_threshold FROM b GROUP BY 1, 2")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.max_run_thresholds(_rows(spark, sf), ["subject", "stimulus_label"], ["stream_id"], BASELINE, 0.8, 2))


LASTING = f"""WITH {CLASS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY stimulus_label, stream_id ORDER BY time) AS i FROM cl WHERE {IN_BASE}),
r AS (SELECT x.subject, x.stimulus_label, x.stream_id, x.i, y.i AS j, min(m.score) AS low FROM b x JOIN b y ON y.stimulus_label = x.stimulus_label AND y.stream_id = x.stream_id AND y.i > x.i AND y.time - x.time >= 21600
  JOIN b m ON m.stimulus_label = x.stimulus_label AND m.stream_id = x.stream_id AND m.i BETWEEN x.i AND y.i GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT subject, stimulus_label, stream_id, max(low) AS best FROM r GROUP BY 1, 2, 3) SELECT subject, stimulus_label, round(quantile_cont(best, 0.8), 9) AS score_threshold FROM l GROUP BY 1, 2"""


@query("e2_max_run_duration", LASTING)
def e2_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two rows that last six hours."""
    return rounded(R.max_run_thresholds_with_duration(_rows(spark, sf), ["subject", "stimulus_label"], ["stream_id"], BASELINE, 0.8, 2, 21600.0))


ONSET_SQL = f"""{OBS_SQL}, t AS (SELECT subject, quantile_cont(conf, 0.5) AS th FROM obs WHERE {IN_BASE} GROUP BY 1),
n AS (SELECT subject, stream_id, time, conf, pred, th, row_number() OVER (PARTITION BY stream_id ORDER BY time) AS i FROM obs JOIN t USING (subject) WHERE {IN_EFFECT}),
ab AS (SELECT *, lag(i) OVER w AS pi, lag(pred) OVER w AS pp FROM n WHERE conf >= th WINDOW w AS (PARTITION BY stream_id ORDER BY time)),
rn AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi > 1 OR pp <> pred THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM ab),
rr AS (SELECT subject, stream_id, run, min(time) AS onset_time, count(*) AS run_length FROM rn GROUP BY 1, 2, 3 HAVING count(*) >= 2),
fo AS (SELECT stream_id, min(onset_time) AS onset_time, arg_min(run_length, onset_time) AS run_length FROM rr GROUP BY 1),
on1 AS (SELECT DISTINCT n.subject, n.stream_id, fo.stream_id IS NOT NULL AS detected, onset_time, run_length FROM n LEFT JOIN fo ON fo.stream_id = n.stream_id)"""


def _onsets(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).withColumns({"score": P.confidence(F.col("p")), "pred": P.predicted_index(F.col("p"))})
    t = R.point_thresholds(o, ["subject"], BASELINE, 0.5)
    rows = o.where(F.col("time").between(*EFFECT)).join(t, "subject")
    return R.first_onsets(rows, ["subject", "stream_id"], F.col("score_threshold"), 2, stable="pred")


@query("e3_first_onset", f"WITH {ONSET_SQL} SELECT subject, stream_id, detected, round(onset_time, 6) AS onset_time, run_length FROM on1")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_onsets(spark, sf).select("subject", "stream_id", "detected", "onset_time", "run_length"), 6)


@query("e4_merge_gap", f"WITH {_events_sql(50000.0)} {EVENT_SELECT} FROM pk")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_events(spark, sf, merge_gap=50000.0))


@query("e5_refractory", f"WITH RECURSIVE {_events_sql(None)}, o AS (SELECT stream_id, stimulus_label, onset_time, row_number() OVER (PARTITION BY stream_id, stimulus_label ORDER BY onset_time) AS n FROM pk), f AS (SELECT stream_id, stimulus_label, onset_time, n, onset_time AS last, TRUE AS kept FROM o WHERE n = 1 UNION ALL SELECT o.stream_id, o.stimulus_label, o.onset_time, o.n, CASE WHEN o.onset_time - f.last < 200000 THEN f.last ELSE o.onset_time END, o.onset_time - f.last >= 200000 FROM f JOIN o ON o.stream_id = f.stream_id AND o.stimulus_label = f.stimulus_label AND o.n = f.n + 1) SELECT stream_id, stimulus_label, round(onset_time, 6) AS onset_time FROM f WHERE kept")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_events(spark, sf, refractory=200000.0).select("stream_id", "stimulus_label", "onset_time"), 6)


@query("e6_stimulus_events", f"WITH {_events_sql(None)} {EVENT_SELECT}, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY onset_time, {NAMED}) - 1 AS INTEGER) AS event_index FROM pk")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_events(spark, sf), "event_index")


@query("e7_winner_take_all", f"WITH {_events_sql(None)}, q AS (SELECT *, {NAMED} AS cls, max(offset_time) OVER (PARTITION BY stream_id ORDER BY onset_time, offset_time, {NAMED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pk), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR onset_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY onset_time, offset_time, cls ROWS UNBOUNDED PRECEDING) AS cluster FROM q), z AS (SELECT *, row_number() OVER (PARTITION BY stream_id, cluster ORDER BY peak_score DESC, onset_time, cls) AS rk FROM g) {EVENT_SELECT} FROM z WHERE rk = 1")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_events(spark, sf, conflicts="winner_take_all"))


@query("e7_highest_peak", f"WITH {_events_sql(None)}, z AS (SELECT *, row_number() OVER (PARTITION BY stream_id, peak_time ORDER BY peak_score DESC, onset_time, {NAMED}) AS rk FROM pk) {EVENT_SELECT} FROM z WHERE rk = 1")
def e7_highest(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_events(spark, sf, conflicts="highest_peak_per_window"))


SUPPRESSED = f"""WITH RECURSIVE {_events_sql(None)}, o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY peak_score DESC, onset_time, {NAMED}) AS n FROM pk),
f AS (SELECT stream_id, n, [onset_time] AS a, [offset_time] AS b, TRUE AS free FROM o WHERE n = 1
  UNION ALL SELECT stream_id, n, CASE WHEN free THEN list_append(a, onset_time) ELSE a END, CASE WHEN free THEN list_append(b, offset_time) ELSE b END, free FROM (
    SELECT o.stream_id, o.n, f.a, f.b, o.onset_time, o.offset_time, len([i for i in range(1, len(f.a) + 1) if o.offset_time >= f.a[i] AND f.b[i] >= o.onset_time]) = 0 AS free FROM f JOIN o ON o.stream_id = f.stream_id AND o.n = f.n + 1)),
z AS (SELECT o.* FROM o JOIN f USING (stream_id, n) WHERE free) {EVENT_SELECT} FROM z"""


@query("e7_non_max_suppression", SUPPRESSED)
def e7_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy by peak in each stream: order-dependent, tested by brute force."""
    return _shown(_events(spark, sf, conflicts="non_max_suppression"))


@query("e8_crossing_summary", f"WITH {CLASS_SQL}, s AS (SELECT subject, stimulus_label, stream_id, count(*) FILTER (WHERE {IN_BASE}) AS br, count(*) FILTER (WHERE {IN_BASE} AND score >= score_threshold) AS ba, count(*) FILTER (WHERE {IN_EFFECT}) AS dr, count(*) FILTER (WHERE {IN_EFFECT} AND score >= score_threshold) AS da FROM cl JOIN th USING (subject, stimulus_label) GROUP BY 1, 2, 3) SELECT subject, stimulus_label, count(*) AS n_sequences, round(sum(ba) / sum(br), 9) AS baseline_row_rate, round(avg(CASE WHEN br > 0 THEN CASE WHEN ba > 0 THEN 1.0 ELSE 0.0 END END), 9) AS baseline_sequence_rate, round(sum(da) / sum(dr), 9) AS detection_row_rate, round(avg(CASE WHEN dr > 0 THEN CASE WHEN da > 0 THEN 1.0 ELSE 0.0 END END), 9) AS detection_sequence_rate FROM s GROUP BY 1, 2")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).join(_thresholds(spark, sf), ["subject", "stimulus_label"])
    return rounded(R.crossing_summary(rows, ["subject", "stimulus_label"], ["stream_id"], F.col("score") >= F.col("score_threshold"), BASELINE, EFFECT))


@query("e9_sensitivity", f"WITH {CLASS_SQL}, q AS (SELECT subject, quantile, min_consecutive, CASE WHEN quantile = 0.7 THEN quantile_cont(score, 0.7) ELSE quantile_cont(score, 0.9) END AS th2 FROM (SELECT subject, score FROM cl WHERE stimulus_label = 2 AND {IN_BASE}), (VALUES (0.7::DOUBLE), (0.9::DOUBLE)) a(quantile), (VALUES (1), (2)) b(min_consecutive) GROUP BY 1, 2, 3), n AS (SELECT subject, stream_id, quantile, min_consecutive, time, score, th2, row_number() OVER (PARTITION BY quantile, min_consecutive, stream_id ORDER BY time) AS i FROM cl JOIN q USING (subject) WHERE stimulus_label = 2 AND {IN_EFFECT}), ab AS (SELECT *, lag(i) OVER (PARTITION BY quantile, min_consecutive, stream_id ORDER BY time) AS pi FROM n WHERE score >= th2), rn AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY quantile, min_consecutive, stream_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM ab), r AS (SELECT quantile, min_consecutive, stream_id, run FROM rn GROUP BY 1, 2, 3, 4 HAVING count(*) >= min_consecutive) SELECT quantile, min_consecutive, count(*) AS n_events, count(DISTINCT stream_id) AS n_streams FROM r GROUP BY 1, 2")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    """All settings in one job, as keys: the rows of a class are repeated for each setting."""
    rows = _rows(spark, sf).where("stimulus_label = 2").select("subject", "stream_id", "time", "score")
    base = rows.where(F.col("time").between(*BASELINE))
    rows = rows.withColumn("min_consecutive", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("quantile", F.explode(F.array(F.lit(0.7), F.lit(0.9))))
    t = quantiles(base.withColumn("v", F.col("score")), [0.7, 0.9], by=["subject"])
    t = t.select("subject", F.explode(F.map_from_arrays(F.array(F.lit(0.7), F.lit(0.9)), "q")).alias("quantile", "score_threshold"))
    keys = ["quantile", "min_consecutive", "stream_id"]
    found = R.with_runs(rows.where(F.col("time").between(*EFFECT)).join(t, ["subject", "quantile"]), keys, F.col("score_threshold"))
    valid = found.groupBy(*keys, "run").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("min_consecutive"))
    return valid.groupBy("quantile", "min_consecutive").agg(F.count("*").alias("n_events"), F.countDistinct("stream_id").alias("n_streams"))


@query("e10_chunks", f"WITH {OBS_SQL}, c AS (SELECT * FROM (VALUES ('early', 0.0, 900000.0), ('late', 900000.0, 3000000.0)) c(chunk, a, b)) SELECT chunk, subject, count(*) AS n, round(avg(CASE WHEN conf >= 0.3 THEN 1.0 ELSE 0.0 END), 9) AS crossing_rate FROM obs JOIN c ON time >= a AND time < b GROUP BY 1, 2")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    chunk = F.when((F.col("time") >= 0) & (F.col("time") < 900000), "early").when((F.col("time") >= 900000) & (F.col("time") < 3000000), "late")
    o = obs(spark, sf).withColumn("chunk", chunk).where("chunk is not null")
    return rounded(o.groupBy("chunk", "subject").agg(F.count("*").alias("n"), F.avg((P.confidence(F.col("p")) >= 0.3).cast("double")).alias("crossing_rate")))


@query("e11_task_workflow", f"WITH {OBS_SQL} SELECT 'task' || fold AS task, count(DISTINCT stream_id) AS n_sequences, round(quantile_cont(conf, 0.95), 9) AS score_threshold FROM obs GROUP BY fold")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks in directories of their own, told apart by the path."""
    rows = obs(spark, sf).select(F.concat(F.lit("task"), F.col("fold")).alias("task"), "stream_id", P.confidence(F.col("p")).alias("conf"))
    path = write_table(rows, shared_path(spark, "tasks"), partition_by=("task",))
    back = spark.read.parquet(path)
    n = back.groupBy("task").agg(F.countDistinct("stream_id").alias("n_sequences"))
    return rounded(n.join(grouped_quantile(back, "conf", 0.95, ["task"], "score_threshold"), "task"))


GRID = f"{CLASS_SQL}, gr AS (SELECT stream_id AS stream, CAST(floor(time / 86400) AS BIGINT) AS bin, stimulus_label, avg(score) AS score FROM cl GROUP BY 1, 2, 3), an AS (SELECT DISTINCT stream_id AS stream, CAST(floor(time / 86400) AS BIGINT) AS bin, 2 AS stimulus_label FROM obs WHERE true_label = 2), te0 AS (SELECT g.stimulus_label, o AS off, avg(g.score) AS mean, count(*) AS n FROM an, unnest([-1, 0, 1]) u(o), gr g WHERE g.stream = an.stream AND g.bin = an.bin + o AND g.stimulus_label = an.stimulus_label GROUP BY 1, 2), te1 AS (SELECT t.stimulus_label, off, mean - (SELECT quantile_cont(score, 0.5) FROM gr g WHERE g.stimulus_label = t.stimulus_label) AS raw FROM te0 t WHERE n >= 3), te AS (SELECT stimulus_label, off, raw / sqrt(sum(raw * raw) OVER (PARTITION BY stimulus_label)) AS weight FROM te1)"


def _grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).groupBy(F.col("stream_id").alias("stream"), F.floor(F.col("time") / 86400).alias("bin"), "stimulus_label").agg(F.avg("score").alias("score"))


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    notes = annotations(spark, sf).select(F.col("stream_id").alias("stream"), F.floor(F.col("onset_time") / 86400).alias("bin"), F.lit(2).alias("stimulus_label")).distinct()
    return R.event_templates(_grid_rows(spark, sf), notes, [-1, 0, 1])


@query("e12_templates", f"WITH {GRID} SELECT stimulus_label, CAST(off AS INTEGER) AS \"offset\", round(weight, 6) AS weight FROM te")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_templates(spark, sf), 6)


@query("e13_template_peaks", f"WITH {GRID}, sc2 AS (SELECT stream, g.bin - off AS bin, g.stimulus_label, sum(weight * score) AS s, sum(abs(weight)) AS w FROM gr g JOIN te USING (stimulus_label) GROUP BY 1, 2, 3), sc3 AS (SELECT stream, bin, stimulus_label, s * h / w AS score FROM sc2 JOIN (SELECT stimulus_label, sum(abs(weight)) AS h FROM te GROUP BY 1) USING (stimulus_label) WHERE w >= 0.9 * h), th3 AS (SELECT quantile_cont(score, 0.8) AS t FROM sc3), p AS (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a FROM sc3 WINDOW w AS (PARTITION BY stream, stimulus_label ORDER BY bin)) SELECT stream, CAST(bin AS BIGINT) AS bin, round(score, 6) AS score FROM p, th3 WHERE score >= t AND (b IS NULL OR score > b) AND (a IS NULL OR score >= a)")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    scores = cut(R.template_scores(_grid_rows(spark, sf), _templates(spark, sf), 0.9), "template-scores")
    limit = grouped_quantile(scores, "score", 0.8, [], "t")
    rows = scores.join(F.broadcast(limit))  # one row
    return rounded(R.local_peaks(rows, ["stream", "stimulus_label"], "bin", F.col("t")).select("stream", "bin", "score"), 6)


STAGE_SQL = f"{CLASS_SQL}, sm AS (SELECT subject, stimulus_label AS state, floor(time / 86400) AS time, avg(score) AS posterior, avg(CASE WHEN score >= 0.2 THEN 1.0 ELSE 0.0 END) AS m FROM cl GROUP BY 1, 2, 3), gm AS (SELECT state, time, avg(posterior) AS posterior, avg(m) AS match_rate, stddev_samp(posterior) / sqrt(count(*)) AS sem FROM sm GROUP BY 1, 2)"


def _timecourse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("time", F.floor(F.col("time") / 86400).cast("double"))
    own = rows.groupBy("subject", F.col("stimulus_label").alias("state"), "time").agg(F.avg("score").alias("posterior"), F.avg((F.col("score") >= 0.2).cast("double")).alias("m"))
    return own.groupBy("state", "time").agg(F.avg("posterior").alias("posterior"), F.avg("m").alias("match_rate"), (F.stddev_samp("posterior") / F.sqrt(F.count("*"))).alias("sem"))


@query("e14_timecourse", f"WITH {STAGE_SQL} SELECT state, time, round(posterior, 9) AS posterior, round(match_rate, 9) AS match_rate, round(sem, 9) AS sem, row_number() OVER (PARTITION BY time ORDER BY posterior DESC, state) = 1 AS dominant FROM gm")
def e14(spark: SparkSession, sf: str) -> DataFrame:
    t = _timecourse(spark, sf)
    first = F.row_number().over(Window.partitionBy("time").orderBy(F.col("posterior").desc(), "state")) == 1
    return rounded(t.withColumn("dominant", first))


@query("e15_stable_stages", f"WITH {STAGE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY time) AS i FROM gm), ok AS (SELECT *, i - row_number() OVER (PARTITION BY state ORDER BY time) AS isl FROM n WHERE posterior >= 0.19 AND match_rate >= 0.4) SELECT state, min(time) AS start, max(time) AS stop, count(*) AS n_times, round(avg(posterior), 9) AS posterior FROM ok GROUP BY state, isl HAVING max(time) - min(time) >= 1")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.stable_stages(_timecourse(spark, sf), ["state"], 0.19, 0.4, 1.0))


LOGS = ", ".join(f"avg(CASE WHEN {IN_BASE} THEN ln(greatest(p{k}, 1e-15)) END) AS b{k}" for k in range(5))
DEB = [f"exp(ln(greatest(p{k}, 1e-15)) - b{k})" for k in range(5)]


@query("e16_debiasing", f"WITH {OBS_SQL}, b AS (SELECT subject, {LOGS} FROM obs GROUP BY 1) SELECT event_id, round({DEB[0]} / ({' + '.join(DEB)}), 9) AS q0, round({DEB[3]} / ({' + '.join(DEB)}), 9) AS q3 FROM obs JOIN b USING (subject)")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.operators.adapt import debiased

    q = debiased(obs(spark, sf), ["subject"], BASELINE)
    return rounded(q.select("event_id", F.get("p", F.lit(0)).alias("q0"), F.get("p", F.lit(3)).alias("q3")))


@query("e20_unique_times", f"WITH {OBS_SQL} SELECT stream_id, floor(time / 3600) AS time, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    return S.duplicate_keys(obs(spark, sf).withColumn("time", F.floor(F.col("time") / 3600).cast("double")), ["stream_id", "time"])


@query("e23_trigger_onsets", f"WITH RECURSIVE {OBS_SQL}, m0 AS (SELECT stream_id, true_label, count(*) AS n FROM obs GROUP BY 1, 2), m AS (SELECT stream_id, true_label AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, true_label) AS k FROM m0) WHERE k = 1), a AS (SELECT stream_id, time, abs(true_label - baseline) > 1 AS act, lag(abs(true_label - baseline) > 1) OVER (PARTITION BY stream_id ORDER BY time) AS prev FROM obs JOIN m USING (stream_id)), o AS (SELECT stream_id, time, row_number() OVER (PARTITION BY stream_id ORDER BY time) AS n FROM a WHERE act AND NOT coalesce(prev, FALSE)), f AS (SELECT stream_id, time, n, time AS last, TRUE AS kept FROM o WHERE n = 1 UNION ALL SELECT o.stream_id, o.time, o.n, CASE WHEN o.time - f.last < 100000 THEN f.last ELSE o.time END, o.time - f.last >= 100000 FROM f JOIN o ON o.stream_id = f.stream_id AND o.n = f.n + 1) SELECT stream_id, round(time, 6) AS onset_time FROM f WHERE kept")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    signal = obs(spark, sf).select("stream_id", "time", F.col("true_label").cast("double").alias("value"))
    return rounded(R.trigger_onsets(signal, ["stream_id"], 1.0, 100000.0).select("stream_id", "onset_time"), 6)


@query("e24_durations", f"WITH {OBS_SQL}, n AS (SELECT stream_id, true_label, row_number() OVER (PARTITION BY stream_id ORDER BY time) - row_number() OVER (PARTITION BY stream_id, true_label ORDER BY time) AS isl FROM obs), d AS (SELECT stream_id, true_label, isl, count(*) AS duration FROM n GROUP BY 1, 2, 3), h AS (SELECT true_label, duration, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT true_label, (sum((duration - 1) * n) + 1.0) / (sum((duration - 1) * n) + sum(n) + 2.0) AS stay FROM h GROUP BY 1) SELECT h.true_label, duration, n, round(stay, 9) AS stay FROM h JOIN s USING (true_label)")
def e24(spark: SparkSession, sf: str) -> DataFrame:
    d = R.state_durations(obs(spark, sf), ["stream_id"], "true_label")
    return rounded(d.join(R.stay_probabilities(d, "true_label"), "true_label"))


@query("d32_event_summary")
def d32(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: events of each subject, matched to annotations, and how well they do."""
    found = cut(_events(spark, sf).where("stimulus_label = 2"), "events")
    named = found.withColumn("event_id", F.concat_ws(":", "stream_id", "event_index"))
    matched = J.match_annotations(named, annotations(spark, sf), ["stream_id", "stimulus_class", "subject"], 40000.0)
    notes = annotations(spark, sf).where(F.col("onset_time").between(*EFFECT))
    return rounded(R.event_summary(matched, notes, obs(spark, sf), ["subject"]), 6)


def onset_summary_sql() -> str:
    return f"WITH {ONSET_SQL} SELECT subject, count(*) AS n_sequences, round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 9) AS detection_rate, round(avg(onset_time), 4) AS onset_mean, round(quantile_cont(onset_time, 0.5), 4) AS onset_median FROM on1 GROUP BY 1"


@query("e8_onset_summary", onset_summary_sql())
def e8_onsets(spark: SparkSession, sf: str) -> DataFrame:
    o = _onsets(spark, sf)
    return rounded(o.groupBy("subject").agg(F.count("*").alias("n_sequences"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.avg("onset_time").alias("onset_mean"), F.percentile("onset_time", 0.5).alias("onset_median")), 9, onset_mean=4, onset_median=4)
