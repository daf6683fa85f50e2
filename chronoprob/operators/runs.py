"""Thresholds, runs above them, events and their conflicts: gaps and islands with window functions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.sources.observations import cut

from .ranks import grouped_quantile
from .sequences import map_tables


def point_thresholds(df: DataFrame, keys: Sequence[str], window: tuple[float, float], quantile: float, score: str = "score") -> DataFrame:
    """Linear-interpolated quantile of the scores in the baseline window, for each key."""
    return grouped_quantile(df.where(F.col("time").between(*window)), score, quantile, keys, "score_threshold")


def max_run_thresholds(df: DataFrame, keys: Sequence[str], sequence: Sequence[str], window: tuple[float, float], quantile: float, min_consecutive: int, score: str = "score") -> DataFrame:
    """Quantile over sequences of the largest threshold at which a baseline run of ``min_consecutive`` rows
    would still count: the largest minimum of so many rows in a row."""
    base = df.where(F.col("time").between(*window))
    w = Window.partitionBy(*keys, *sequence).orderBy("time").rowsBetween(-(min_consecutive - 1), 0)
    slid = base.withColumn("_m", F.when(F.count("*").over(w) == min_consecutive, F.min(score).over(w)))
    best = slid.groupBy(*keys, *sequence).agg(F.max("_m").alias("_m")).where("_m is not null")
    return grouped_quantile(best, "_m", quantile, keys, "score_threshold")


def longest_threshold(scores: list[float], times: list[float], min_consecutive: int, min_duration: float) -> float | None:
    """The largest minimum over runs of enough rows and seconds, for one sequence: ends only grow while the
    run so far is too short, as longer runs have smaller minima."""
    best: float | None = None
    for i in range(len(scores)):
        low = float("inf")
        for j in range(i, len(scores)):
            low = min(low, scores[j])
            if best is not None and low <= best:
                break
            if j - i + 1 >= min_consecutive and times[j] - times[i] >= min_duration:
                best = low
                break
    return best


def max_run_thresholds_with_duration(df: DataFrame, keys: Sequence[str], sequence: Sequence[str], window: tuple[float, float], quantile: float, min_consecutive: int, min_duration: float, score: str = "score") -> DataFrame:
    """As ``max_run_thresholds`` where runs also have to last: Python over sequences, many at a time."""
    base = df.where(F.col("time").between(*window)).select(*keys, *sequence, "time", F.col(score).alias("_s"))
    types = dict(base.dtypes)

    def largest(table: pa.Table, starts: np.ndarray) -> pa.Table:
        scores, times = table["_s"].to_numpy(), table["time"].to_numpy()
        best = [longest_threshold(scores[a:b].tolist(), times[a:b].tolist(), min_consecutive, min_duration) for a, b in zip(starts, [*starts[1:], len(times)])]
        return table.select(list(keys)).take(pa.array(starts)).append_column("best", pa.array(best, pa.float64()))

    rows = map_tables(base, [*keys, *sequence], ["time"], largest, ", ".join(f"{k} {types[k]}" for k in keys) + ", best double")
    return grouped_quantile(cut(rows, "longest-runs"), "best", quantile, keys, "score_threshold")


def with_runs(df: DataFrame, sequence: Sequence[str], threshold: Column, score: str = "score", merge_gap: float | None = None, stable: str | None = None, breaks: Column | None = None) -> DataFrame:
    """Rows at or above the threshold with ``run``, the number of their run in the sequence.

    A run goes on to the next row above if no row below stands between, or if the gap in time is at most
    ``merge_gap``. A change in column ``stable``, or the caller's ``breaks``, ends a run as well.
    """
    w = Window.partitionBy(*sequence).orderBy("time")
    numbered = df.withColumn("_i", F.row_number().over(w)).where(F.col(score) >= threshold)
    apart = F.col("_i") - F.lag("_i").over(w) > 1
    if merge_gap is not None:
        apart = apart & (F.col("time") - F.lag("time").over(w) > merge_gap)
    if stable is not None:
        apart = apart | ~F.col(stable).eqNullSafe(F.lag(stable).over(w))
    if breaks is not None:
        apart = apart | breaks
    first = F.when(F.lag("_i").over(w).isNull() | apart, 1).otherwise(0)
    return numbered.withColumn("_new", first).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_new")


def run_table(rows: DataFrame, keys: Sequence[str], min_consecutive: int = 1, min_duration: float | None = None, score: str = "score") -> DataFrame:
    """Onset, offset, peak, length, duration and the time at which a run is confirmed, of the valid runs."""
    w = Window.partitionBy(*keys, "run").orderBy("time")
    place = F.row_number().over(w)
    enough = place >= min_consecutive
    if min_duration is not None:
        enough = enough & (F.col("time") - F.first("time").over(w) >= min_duration)
    r = rows.withColumn("_ok", F.when(enough, F.col("time")))
    out = r.groupBy(*keys, "run").agg(
        F.min("time").alias("onset_time"), F.max("time").alias("offset_time"), F.max(F.struct(F.col(score), (-F.col("time")).alias("t"))).alias("_peak"),
        F.count("*").alias("run_length"), F.min_by(score, "time").alias("score_at_onset"), F.min("_ok").alias("detection_confirmed_time"),
    )
    out = out.withColumns({"peak_score": F.col(f"_peak.{score}"), "peak_time": -F.col("_peak.t"), "run_duration": F.col("offset_time") - F.col("onset_time")}).drop("_peak")
    keep = F.col("run_length") >= min_consecutive
    if min_duration is not None:
        keep = keep & (F.col("run_duration") >= min_duration)
    return out.where(keep)


def after_refractory(runs: DataFrame, sequence: Sequence[str], refractory: float) -> DataFrame:
    """Runs without those that start less than ``refractory`` after the last kept run of the sequence: a
    fold over the sequence's onsets, as what is kept depends on what was kept."""
    onsets = runs.groupBy(*sequence).agg(F.array_sort(F.collect_list("onset_time")).alias("_o"))
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        skip = acc["last"].isNotNull() & (x - acc["last"] < refractory)
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last")))

    kept = onsets.select(*sequence, F.explode(F.aggregate("_o", start, step, lambda acc: acc["kept"])).alias("onset_time"))
    return runs.join(kept, [*sequence, "onset_time"], "left_semi")


def events(scored: DataFrame, thresholds: DataFrame, group: Sequence[str], stream: Sequence[str], min_consecutive: int = 1, min_duration: float | None = None, merge_gap: float | None = None, refractory: float | None = None, window: tuple[float, float] | None = None, conflicts: str = "none") -> DataFrame:
    """Stimulus events: rows by class (stimulus_label, stimulus_class, score) against the thresholds of
    (group, class), runs, validity, refractory time, conflicts between classes, numbering in the stream."""
    classes = ["stimulus_label", "stimulus_class"]
    rows = scored if window is None else scored.where(F.col("time").between(*window))
    rows = rows.join(thresholds.where(F.col("score_threshold").isNotNull()), [*group, "stimulus_label"])  # AQE broadcasts this side where it is small
    keys = [*dict.fromkeys([*group, *stream]), *classes]
    rows = with_runs(rows, keys, F.col("score_threshold"), merge_gap=merge_gap)
    found = run_table(rows, [*keys, "score_threshold"], min_consecutive, min_duration).drop("run")
    if refractory is not None:
        found = after_refractory(found, keys, refractory)
    return numbered(resolved(found, stream, conflicts), stream)


def numbered(found: DataFrame, stream: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*stream).orderBy("onset_time", "stimulus_class")
    return found.withColumn("event_index", F.row_number().over(w) - 1)


def resolved(found: DataFrame, stream: Sequence[str], mode: str) -> DataFrame:
    """Events of different classes that meet in a stream: all stay (none), the best of each cluster of
    overlaps (winner_take_all), the best of each peak time (highest_peak_per_window), or by falling peak
    those that overlap none kept before (non_max_suppression)."""
    best = [F.col("peak_score").desc(), "onset_time", "stimulus_class"]
    if mode == "none":
        return found
    if mode == "highest_peak_per_window":
        w = Window.partitionBy(*stream, "peak_time").orderBy(*best)
        return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if mode == "winner_take_all":
        line = Window.partitionBy(*stream).orderBy("onset_time", "offset_time", "stimulus_class")
        reach = F.max("offset_time").over(line.rowsBetween(Window.unboundedPreceding, -1))
        marked = found.withColumn("_new", F.when(reach.isNull() | (F.col("onset_time") > reach), 1).otherwise(0))
        marked = marked.withColumn("_cluster", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        w = Window.partitionBy(*stream, "_cluster").orderBy(*best)
        return marked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new", "_cluster")
    if mode == "non_max_suppression":
        def keep(table: pa.Table, starts: np.ndarray) -> pa.Table:
            onsets, offsets = table["onset_time"].to_pylist(), table["offset_time"].to_pylist()
            mask = [False] * len(onsets)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(onsets)]):
                begun: list[float] = []  # kept events overlap none, so the last that begins in time tells
                ended: list[float] = []
                for n in range(i, j):
                    at = bisect_right(begun, offsets[n])
                    if not at or ended[at - 1] < onsets[n]:
                        mask[n] = True
                        begun.insert(at, onsets[n])
                        ended.insert(at, offsets[n])
            return table.filter(pa.array(mask))

        return map_tables(found, stream, best, keep, found.schema)
    raise ValueError(f"no such conflict resolution: {mode}")


def first_onsets(df: DataFrame, sequence: Sequence[str], threshold: Column, min_consecutive: int = 1, min_duration: float | None = None, stable: str | None = None, score: str = "score") -> DataFrame:
    """One row for each sequence: its first valid run, or ``detected`` false without one."""
    runs = run_table(with_runs(df, sequence, threshold, score, stable=stable), sequence, min_consecutive, min_duration, score)
    first = runs.groupBy(*sequence).agg(F.min_by(F.struct("onset_time", "offset_time", "run_length", "detection_confirmed_time"), "onset_time").alias("r"))
    return df.select(*sequence).distinct().join(first, list(sequence), "left").select(*sequence, F.col("r").isNotNull().alias("detected"), "r.*")


def crossing_summary(df: DataFrame, group: Sequence[str], sequence: Sequence[str], above: Column, baseline: tuple[float, float], detection: tuple[float, float]) -> DataFrame:
    """Shares of rows and of sequences above threshold in the baseline and detection windows."""
    t = F.col("time")
    parts = {"baseline": t.between(*baseline), "detection": t.between(*detection)}
    per = df.groupBy(*group, *sequence).agg(*[c for n, inside in parts.items() for c in (F.count_if(inside).alias(f"{n}_rows"), F.count_if(inside & above).alias(f"{n}_above"))])
    out = []
    for n in parts:
        seen = F.col(f"{n}_rows") > 0
        out += [F.try_divide(F.sum(f"{n}_above"), F.sum(f"{n}_rows")).alias(f"{n}_row_rate"), F.avg(F.when(seen, (F.col(f"{n}_above") > 0).cast("double"))).alias(f"{n}_sequence_rate")]
    return per.groupBy(*group).agg(F.count("*").alias("n_sequences"), *out)


def event_summary(found: DataFrame, annotations: DataFrame, observations: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hits, misses, false alarms, precision, recall, F1, false alarms a minute and latencies of each group;
    groups without events stay. ``found`` has is_true_positive, is_duplicate_detection and latency."""
    g = list(group)
    grid = observations.groupBy(*g).agg((F.max("time") - F.min("time")).alias("_seconds"))
    hits = found.groupBy(*g).agg(F.count("*").alias("n_detections"), F.count_if("is_true_positive").alias("true_positives"), F.count_if("is_duplicate_detection").alias("duplicate_detections"), F.avg("latency").alias("latency_mean"), F.percentile("latency", 0.5).alias("latency_median"), F.stddev_samp("latency").alias("latency_sd"))
    notes = annotations.groupBy(*g).agg(F.count("*").alias("n_annotations"))
    out = grid.join(hits, g, "left").join(notes, g, "left").fillna(0, ["n_detections", "true_positives", "duplicate_detections", "n_annotations"])
    tp, n, a = F.col("true_positives"), F.col("n_detections"), F.col("n_annotations")
    out = out.withColumns({"false_positives": n - tp, "false_negatives": a - tp, "precision": F.try_divide(tp, n), "recall": F.try_divide(tp, a)})
    f1 = F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumns({"f1": f1, "false_alarms_per_minute": F.try_divide(F.col("false_positives") * 60.0, F.col("_seconds"))}).drop("_seconds")


def stable_stages(means: DataFrame, keys: Sequence[str], posterior_at_least: float, match_at_least: float, min_duration: float) -> DataFrame:
    """Stretches of times whose mean posterior and match rate both reach their limits."""
    ok = F.when((F.col("posterior") >= posterior_at_least) & (F.col("match_rate") >= match_at_least), 1.0).otherwise(0.0)
    rows = with_runs(means.withColumn("_ok", ok), keys, F.lit(1.0), "_ok")
    out = rows.groupBy(*keys, "run").agg(F.min("time").alias("start"), F.max("time").alias("stop"), F.count("*").alias("n_times"), F.avg("posterior").alias("posterior"))
    return out.where(F.col("stop") - F.col("start") >= min_duration).drop("run")


def trigger_onsets(signal: DataFrame, key: Sequence[str], threshold: float, min_separation: float) -> DataFrame:
    """Rising edges of a signal away from its most frequent value (the lowest of equals), without edges too
    soon after the last kept one. ``signal`` has time and value."""
    rounded = signal.withColumn("_v", F.round("value", 9))
    counts = rounded.groupBy(*key, "_v").agg(F.count("*").alias("n"))
    base = counts.groupBy(*key).agg(F.max(F.struct("n", (-F.col("_v")).alias("v"))).alias("m")).select(*key, (-F.col("m.v")).alias("baseline"))
    w = Window.partitionBy(*key).orderBy("time")
    active = F.abs(F.col("value") - F.col("baseline")) > threshold
    edges = rounded.join(base, list(key)).withColumn("_a", active).withColumn("_p", F.coalesce(F.lag("_a").over(w), F.lit(False))).where("_a and not _p")
    return after_refractory(edges.select(*key, F.col("time").alias("onset_time"), "baseline"), key, min_separation)


def state_durations(df: DataFrame, sequence: Sequence[str], state: str) -> DataFrame:
    """(state, duration, n): how many stretches of a state last how many rows."""
    w = Window.partitionBy(*sequence).orderBy("time")
    new = F.when(~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    rows = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*sequence, "_run", state).agg(F.count("*").alias("duration")).groupBy(state, "duration").agg(F.count("*").alias("n"))


def stay_probabilities(durations: DataFrame, state: str, smoothing: float = 1.0) -> DataFrame:
    """(state, stay): share of steps that stay, with additive smoothing of stays and leaves."""
    stays = F.sum((F.col("duration") - 1) * F.col("n"))
    return durations.groupBy(state).agg(((stays + smoothing) / (stays + F.sum("n") + 2 * smoothing)).alias("stay"))


def event_templates(grid: DataFrame, annotations: DataFrame, offsets: Sequence[int], min_events: int = 3) -> DataFrame:
    """(class, offset, weight): mean score around annotations less the class's median score on the grid, to
    length one. ``grid`` has stream, bin, stimulus_label, score; ``annotations`` stream, bin, stimulus_label."""
    at = annotations.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("_bin", F.col("bin") + F.col("offset")).drop("bin")
    hit = at.join(grid.select("stream", F.col("bin").alias("_bin"), "stimulus_label", "score"), ["stream", "_bin", "stimulus_label"])
    means = hit.groupBy("stimulus_label", "offset").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= min_events)
    base = grouped_quantile(grid, "score", 0.5, ["stimulus_label"], "base")
    raw = means.join(base, "stimulus_label").withColumn("raw", F.col("mean") - F.col("base"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("stimulus_label")))
    return raw.select("stimulus_label", "offset", F.try_divide(F.col("raw"), length).alias("weight"))


def template_scores(grid: DataFrame, templates: DataFrame, min_coverage: float) -> DataFrame:
    """(stream, bin, stimulus_label, score): dot product of template and trace at each bin of the grid,
    scaled up for offsets without a score, where those present have enough of the template's weight."""
    rows = grid.join(templates, "stimulus_label").withColumn("bin", F.col("bin") - F.col("offset"))
    total = templates.groupBy("stimulus_label").agg(F.sum(F.abs("weight")).alias("whole"))
    sums = rows.groupBy("stream", "bin", "stimulus_label").agg(F.sum(F.col("weight") * F.col("score")).alias("s"), F.sum(F.abs("weight")).alias("w")).join(total, "stimulus_label")
    return sums.where(F.col("w") >= min_coverage * F.col("whole")).select("stream", "bin", "stimulus_label", (F.col("s") * F.col("whole") / F.col("w")).alias("score"))


def local_peaks(scores: DataFrame, keys: Sequence[str], order: str, threshold: Column) -> DataFrame:
    """Rows at or above the threshold that are larger than the row before and no smaller than the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag("score").over(w), F.lead("score").over(w)
    return scores.withColumn("_p", (F.col("score") >= threshold) & (before.isNull() | (F.col("score") > before)) & (after.isNull() | (F.col("score") >= after))).where("_p").drop("_p")
