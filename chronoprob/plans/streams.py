"""Queries on streams: the detector over files that arrive one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.operators import labels as L
from chronoprob.sources.observations import shared_path
from chronoprob.streaming import detector as S

from .fixtures import EFFECT, OBS_SQL, obs, table
from .metrics import rounded
from .registry import query
from .runs import _events_sql, _thresholds


def _replay(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    """Observations as files in order of time, with an end marker for each stream, read as a stream. A stretch
    of time is dealt by stream to several files, so that each stream's rows come in order, whichever files make
    a batch."""
    dealt = 4
    o = obs(spark, sf).select("stream_id", "subject", "time", "p", "classes")
    path = shared_path(spark, "stream")
    limits = o.agg(F.percentile_approx("time", [i / files for i in range(1, files)])).first()[0]  # any cuts do
    part = F.lit(0)
    for x in limits:
        part = part + F.when(F.col("time") > x, 1).otherwise(0)
    marked = o.withColumn("part", part)
    ends = o.select("stream_id", "subject").distinct().select("stream_id", "subject", F.lit(None).cast("double").alias("time"), F.array(*[F.lit(None).cast("double")] * 5).alias("p"), F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))).alias("classes"), F.lit(files - 1).alias("part"))
    rows = marked.unionByName(ends)
    for i in range(files):
        rows.where(F.col("part") == i).drop("part").repartition(dealt, "stream_id").write.mode("append").parquet(path)
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", dealt).parquet(path)


#: Times at which the files of ``_out_of_order`` end.
CUTS = (600_000.0, 1_200_000.0, 1_800_000.0)
_PART = "CASE WHEN time > 1800000.0 THEN 3 WHEN event_id % 50 = 0 THEN 3 WHEN time > 1200000.0 THEN 2 WHEN time > 600000.0 THEN 1 ELSE 0 END"


def _out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as four files in order of time, but for each fiftieth event, which comes with the last file."""
    o = obs(spark, sf)
    part = F.when((F.col("time") > CUTS[2]) | (F.col("event_id") % 50 == 0), 3).when(F.col("time") > CUTS[1], 2).when(F.col("time") > CUTS[0], 1).otherwise(0)
    rows, path = o.select("stream_id", "subject", "time", "p", "classes", part.alias("part")), shared_path(spark, "stream")
    for i in range(4):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _silent(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    """Observations without any end markers; one row of no stream, far ahead, moves the watermark past all."""
    o = obs(spark, sf).select("stream_id", "subject", "time", "p", "classes")
    path, dealt = shared_path(spark, "stream"), 2
    limits = o.agg(F.percentile_approx("time", [i / files for i in range(1, files)])).first()[0]  # any cuts do
    part = F.lit(0)
    for x in limits:
        part = part + F.when(F.col("time") > x, 1).otherwise(0)
    rows = o.withColumn("part", part)
    for i in range(files):
        rows.where(F.col("part") == i).drop("part").repartition(dealt, "stream_id").write.mode("append").parquet(path)
    o.limit(1).withColumns({"stream_id": F.lit(-1).cast("long"), "time": F.lit(1e9)}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", dealt).parquet(path)


def _detected(spark: SparkSession, sf: str, rules: S.Rules) -> DataFrame:
    """Thresholds, one row for each subject and class, meet the stream by a stream-static join."""
    stream = L.by_class(_replay(spark, sf)).join(_thresholds(spark, sf), ["subject", "stimulus_label"])
    out = S.detect(stream.select("stream_id", "stimulus_label", "time", "score", "score_threshold"), rules)
    return S.run_to_table(out, shared_path(spark, "stream-events"), shared_path(spark, "stream-checkpoint"))


SHOWN = ("stream_id", "stimulus_label", "onset_time", "offset_time", "peak_time", "run_length", "peak_score")
SELECT = "SELECT stream_id, stimulus_label, round(onset_time, 6) AS onset_time, round(offset_time, 6) AS offset_time, round(peak_time, 6) AS peak_time, run_length, round(peak_score, 6) AS peak_score FROM pk"


@query("i1_online_detector", f"WITH {_events_sql(None)} {SELECT}")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    """Streaming events equal the batch's."""
    got = _detected(spark, sf, S.Rules(min_consecutive=2, window=EFFECT)).where("kind = 'event'")
    return rounded(got.select(*SHOWN).withColumn("run_length", F.col("run_length").cast("long")), 6)


@query("i2_flush", f"WITH {_events_sql(50000.0)} {SELECT}")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """With a merge gap; runs still open at the end come out with the end markers."""
    got = _detected(spark, sf, S.Rules(min_consecutive=2, merge_gap=50000.0, window=EFFECT)).where("kind = 'event'")
    return rounded(got.select(*SHOWN).withColumn("run_length", F.col("run_length").cast("long")), 6)


@query("i2_timers", f"WITH {_events_sql(50000.0, 200000.0)} {SELECT}")
def i2_timers(spark: SparkSession, sf: str) -> DataFrame:
    """Streams without an end: event-time timers close the runs of streams that are silent for 200,000 seconds, and drop
    their state."""
    stream = L.by_class(_silent(spark, sf)).join(_thresholds(spark, sf), ["subject", "stimulus_label"])
    out = S.detect(stream.select("stream_id", "stimulus_label", "time", "score", "score_threshold"), S.Rules(min_consecutive=2, merge_gap=50000.0, window=EFFECT, idle=200000.0))
    got = S.run_to_table(out, shared_path(spark, "stream-events"), shared_path(spark, "stream-checkpoint")).where("kind = 'event' and stream_id >= 0")
    return rounded(got.select(*SHOWN).withColumn("run_length", F.col("run_length").cast("long")), 6)


@query("i3_marked_rows", f"WITH {OBS_SQL}, o AS (SELECT *, {_PART} AS part FROM obs), m AS (SELECT stream_id, max(time) AS seen FROM o WHERE part < 3 GROUP BY 1) SELECT stream_id, round(time, 6) AS late_time FROM o JOIN m USING (stream_id) WHERE part = 3 AND time < seen")
def i3_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that come after later ones of their stream are passed on, marked as late."""
    stream = L.by_class(_out_of_order(spark, sf)).where("stimulus_label = 2").withColumn("score_threshold", F.lit(0.3))
    out = S.detect(stream.select("stream_id", "stimulus_label", "time", "score", "score_threshold"), S.Rules())
    got = S.run_to_table(out, shared_path(spark, "stream-events"), shared_path(spark, "stream-checkpoint")).where("kind = 'late'")
    return got.select("stream_id", F.round("onset_time", 6).alias("late_time"))


@query("i3_dropped_rows", f"WITH {OBS_SQL}, o AS (SELECT *, {_PART} AS part, floor(time / 86400) AS day FROM obs), m AS (SELECT max(time) - 604800 AS mark FROM o WHERE part < 2) SELECT CAST(day AS BIGINT) AS day, count(*) AS n FROM o, m WHERE part < 3 OR (day + 1) * 86400 > mark GROUP BY 1")
def i3_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day under a watermark of a week: of the rows that come late, those of days are dropped that the watermark
    had passed by the batch before (Spark measures lateness against that one)."""
    stream = _out_of_order(spark, sf).withColumn("ts", F.timestamp_micros((F.col("time") * 1e6).cast("long")))
    counts = stream.withWatermark("ts", "7 days").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    path, check = shared_path(spark, "stream-counts"), shared_path(spark, "stream-checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/*").groupBy("w").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "n")


@query("i3_late_rows", f"WITH {OBS_SQL} SELECT stream_id, CAST(floor(time / 604800) AS BIGINT) AS week, count(*) AS n FROM obs GROUP BY 1, 2")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by event-time window under a watermark, as a stream over the replayed files."""
    stream = _replay(spark, sf).where("time is not null").withColumn("ts", F.timestamp_micros((F.col("time") * 1e6).cast("long")))
    counts = stream.withWatermark("ts", "60 days").groupBy("stream_id", F.window("ts", "7 days", startTime="0 days").alias("w")).agg(F.count("*").alias("n"))
    path, check = shared_path(spark, "stream-counts"), shared_path(spark, "stream-checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/*")
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("stream_id", "w").orderBy(F.col("batch").desc()))).where("_n = 1")
    return last.select("stream_id", F.floor(F.unix_seconds("w.start") / 604800).alias("week"), "n")


@query("i4_detection_window", f"WITH {_events_sql(None)}, w AS (SELECT * FROM pk) SELECT stimulus_label, count(*) AS n_events, round(min(onset_time), 6) AS first_onset FROM w GROUP BY 1")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    """Rows before the window are ignored; the first row after it ends a run."""
    got = _detected(spark, sf, S.Rules(min_consecutive=2, window=EFFECT)).where("kind = 'event'")
    return rounded(got.groupBy("stimulus_label").agg(F.count("*").alias("n_events"), F.min("onset_time").alias("first_onset")), 6)


@query("i5_sliding_windows", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_seconds("w.start").alias("start"), "n")


@query("i6_scan_segments", f"WITH {OBS_SQL}, s AS (SELECT CAST(k AS INTEGER) AS segment, 100000.0 + k * 500000.0 AS a, 100000.0 + k * 500000.0 + 200000.0 AS b FROM unnest(range(5)) u(k)) SELECT segment, count(*) AS n, count(*) FILTER (WHERE true_label = 2) AS n_targets, round(avg(p2), 9) AS mean_score FROM s JOIN obs ON time >= a AND time < b GROUP BY 1")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    """Regular slices of the stream, each scored: the slice is an arithmetic function of the time."""
    place = F.floor((F.col("time") - 100000.0) / 500000.0).cast("int")
    inside = (F.col("time") - 100000.0 - place * 500000.0 < 200000.0) & place.between(0, 4)
    o = obs(spark, sf).where(inside).withColumn("segment", place)
    return rounded(o.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("true_label") == 2).alias("n_targets"), F.avg(F.get("p", F.lit(2))).alias("mean_score")))


@query("o4_caller_breaks", f"WITH {OBS_SQL}, n AS (SELECT stream_id, time, conf, floor(time / 86400) AS day, row_number() OVER (PARTITION BY stream_id ORDER BY time) AS i FROM obs), ab AS (SELECT *, lag(i) OVER w AS pi, lag(day) OVER w AS pd FROM n WHERE conf >= 0.25 WINDOW w AS (PARTITION BY stream_id ORDER BY time)), rn AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi > 1 OR pd <> day THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM ab), l AS (SELECT stream_id, run, count(*) AS n FROM rn GROUP BY 1, 2) SELECT stream_id, count(*) AS n_runs, max(n) AS longest FROM l GROUP BY 1")
def o4(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that a caller's rule, here a new day, ends as well."""
    from chronoprob.operators.runs import with_runs

    day = F.floor(F.col("time") / 86400)
    w = Window.partitionBy("stream_id").orderBy("time")
    rows = with_runs(obs(spark, sf).withColumn("score", P.confidence(F.col("p"))), ["stream_id"], F.lit(0.25), breaks=day != F.lag(day).over(w))
    return rows.groupBy("stream_id", "run").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


