"""Alignment joins, interval joins and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoprob.sources.observations import cut

from .ranks import grouped_quantile
from .sequences import Rows, map_sequences


def reaction_times(df: DataFrame, participant: str, trial: str, reaction: str, scale: float = 1.0, trial_base: int = 0) -> DataFrame:
    """participant, trial (from 0) and scaled reaction time; values that are no finite numbers go."""
    x = F.col(reaction).cast("double") * F.lit(scale)
    return df.select(F.col(participant).alias("participant"), (F.col(trial) - trial_base).alias("trial"), x.alias("reaction_time")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def aligned_features(ids: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """The features of the wanted rows; ``found`` is false where there are none."""
    return ids.join(features.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def aligned_cube(df: DataFrame, keys: Sequence[str], name: str = "decoder", value: str = "p") -> DataFrame:
    """One row for each key with the values of all candidates by name: one shuffle instead of a join for
    each candidate. ``n`` and ``n_names`` tell incomplete and repeated keys apart."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, value))).alias("cube"))  # a distinct count would move rows once more
    names = F.array_compact(F.array_distinct(F.transform("cube", lambda c: c[name])))
    return packed.select(*keys, F.size("cube").cast("long").alias("n"), F.size(names).cast("long").alias("n_names"), "cube")


def alignment_errors(cube: DataFrame, n_candidates: int) -> DataFrame:
    status = F.when(F.col("n") > F.col("n_names"), "duplicate").when(F.col("n_names") < n_candidates, "missing")
    return cube.withColumn("status", status).where("status is not null")


def full_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows of two tables by key: metric differences (b less a), and the side that lacks the key."""
    x, y = a.select(*keys, *metrics).withColumn("_x", F.lit(1)).alias("x"), b.select(*keys, *metrics).withColumn("_y", F.lit(1)).alias("y")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    both = x.join(y, on, "full")
    side = F.when(F.col("_x").isNull(), "left").when(F.col("_y").isNull(), "right").otherwise("none")
    return both.select(*[F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys], side.alias("missing_side"), *[(F.col(f"y.{m}") - F.col(f"x.{m}")).alias(f"{m}_delta") for m in metrics])


def interval_overlap(windows: DataFrame, intervals: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Pairs of windows and intervals of the same keys that overlap, with the seconds they share.

    A range join as an equi-join: both sides are listed under the buckets of time that they touch, and a
    pair counts in the first bucket that both touch. ``windows`` has window_start and window_stop,
    ``intervals`` has start and stop; both have the keys. Both sides are shuffled: Spark's size check does not see
    how many rows a list makes, and would broadcast them through the driver.
    """
    b = F.lit(bucket)
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("window_start") / b), F.floor(F.col("window_stop") / b)))).alias("w")
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor(F.col("stop") / b)))).alias("i")
    on = F.col("w._b") == F.col("i._b")
    for k in keys:
        on = on & (F.col(f"w.{k}") == F.col(f"i.{k}"))
    first = F.floor(F.greatest("window_start", "start") / b) == F.col("w._b")
    seconds = F.least("window_stop", "stop") - F.greatest("window_start", "start")
    rest = [c for c in intervals.columns if c not in keys]
    return w.hint("merge").join(i.hint("merge"), on).where(first & (seconds > 0)).select(*[F.col(f"w.{c}") for c in windows.columns], *[F.col(f"i.{c}") for c in rest], seconds.alias("overlap"))


def assign(events: Sequence[float], notes: Sequence[float], tolerance: float) -> list[int]:
    """Place in ``notes`` for each event, or -1: as many pairs within the tolerance as can be, and of such
    assignments one of least total latency. Both lists are sorted, and some best assignment keeps the order of
    both: the best chain of pairs, found pair by pair. Only pairs within the tolerance are looked at."""
    m = len(notes)
    nothing = ((0, 0.0), -1)
    tree = [nothing] * (m + 1)  # a Fenwick tree of the best chain that ends at each note
    chain: list[tuple[int, int, int]] = []  # event, note, the pair before

    def best(n: int) -> tuple[tuple[int, float], int]:
        found = nothing
        while n:
            found = min(found, tree[n])
            n -= n & -n
        return found

    low = 0
    for i, t in enumerate(events):
        while low < m and t - notes[low] > tolerance:
            low += 1
        new, j = [], low
        while j < m and notes[j] - t <= tolerance:
            (count, cost), before = best(j)
            new.append(((count - 1, cost + abs(t - notes[j])), j, before))
            j += 1
        for value, j, before in new:
            chain.append((i, j, before))
            at, entry = j + 1, (value, len(chain) - 1)
            while at <= m:
                tree[at] = min(tree[at], entry)
                at += at & -at
    out, last = [-1] * len(events), best(m)[1]
    while last >= 0:
        i, j, last = chain[last]
        out[i] = j
    return out


def islands(rows: DataFrame, by: Sequence[str], tolerance: float, buckets: float = 1024.0) -> DataFrame:
    """``rows`` (with the keys, t, kind and id) with ``_island``: rows no further apart than the tolerance, in
    order of time. Order is taken within buckets of time, and only a bucket's last time and its number of
    islands go on to the next, so that no task sorts a whole stream."""
    from pyspark.sql import Window

    width = F.lit(max(tolerance, 1e-9) * buckets)
    keys = [*by, "_bucket"]
    dealt = rows.withColumn("_bucket", F.floor(F.col("t") / width))
    up_to = Window.partitionBy(*by).orderBy("_bucket")
    edges = dealt.groupBy(*keys).agg(F.max("t").alias("_last")).withColumn("_before", F.lag("_last").over(up_to)).drop("_last")
    line = Window.partitionBy(*keys).orderBy("t", "kind", "id")
    started = dealt.join(edges, keys).withColumn("_gap", F.coalesce((F.col("t") - F.coalesce(F.lag("t").over(line), F.col("_before")) > tolerance).cast("long"), F.lit(1)))
    placed = started.withColumn("_inside", F.sum("_gap").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    counts = started.groupBy(*keys).agg(F.sum("_gap").alias("_n")).withColumn("_first", F.sum("_n").over(up_to) - F.col("_n")).drop("_n")
    return placed.join(counts, keys).withColumn("_island", F.col("_first") + F.col("_inside")).drop("_bucket", "_before", "_gap", "_inside", "_first")


def match_annotations(events: DataFrame, annotations: DataFrame, by: Sequence[str], tolerance: float, event: str = "event_id") -> DataFrame:
    """Events with matched_annotation_id and latency: most matches first, then least total latency.

    Only annotations within the tolerance matter, so what is near in time forms islands, which are solved by
    themselves, some at a time: a task holds a few islands, never a stream. Work in an island is in proportion
    to its pairs within the tolerance.
    """
    e = events.select(*by, F.col("onset_time").alias("t"), F.col(event).cast("string").alias("id"), F.lit(0).alias("kind"))
    a = annotations.select(*by, F.col("onset_time").alias("t"), F.col("annotation_id").cast("string").alias("id"), F.lit(1).alias("kind"))
    near = islands(e.unionByName(a), by, tolerance)
    types = dict(events.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", id string, candidates int, matched string, latency double"

    def solve(rows: Rows) -> dict[str, Sequence]:
        is_event = rows["kind"] == 0
        te, ta, names = rows["t"][is_event], rows["t"][~is_event], rows["id"][~is_event]
        got = assign(te.tolist(), ta.tolist(), tolerance)
        # a little wider than the tolerance by search, then exactly
        low, high = np.searchsorted(ta, te - tolerance * (1 + 1e-9) - 1e-9), np.searchsorted(ta, te + tolerance * (1 + 1e-9) + 1e-9, side="right")
        return {
            **{k: rows[k][is_event].tolist() for k in (*by, "id")}, "candidates": [int((np.abs(x - ta[i:j]) <= tolerance).sum()) for x, i, j in zip(te, low, high, strict=True)],
            "matched": [names[j] if j >= 0 else None for j in got], "latency": [float(x - ta[j]) if j >= 0 else None for x, j in zip(te, got, strict=True)],
        }

    dealt = near.withColumn("_islands", F.floor(F.col("_island") / 256))
    done = map_sequences(dealt.drop("_island"), [*by, "_islands"], ["t", "kind", "id"], solve, schema)
    return done.select(*by, F.col("id").alias(event), F.col("matched").alias("matched_annotation_id"), F.when(~F.isnan("latency"), F.col("latency")).alias("latency"), F.col("matched").isNotNull().alias("is_true_positive"), (F.col("matched").isNull() & (F.col("candidates") > 0)).alias("is_duplicate_detection"))


def _blocks(expected: np.ndarray, triggers: np.ndarray, tolerance: float):
    """Stretches of presses and triggers, as slices, between which no press reaches a trigger."""
    times = np.concatenate([expected, triggers])
    order = np.argsort(times, kind="stable")
    ends = np.flatnonzero(np.diff(times[order]) > tolerance * (1 + 1e-9)) + 1
    of_press = order < len(expected)
    for start, stop in zip([0, *ends], [*ends, len(order)]):
        a, c = int(of_press[:start].sum()), int((~of_press[:start]).sum())
        n = int(of_press[start:stop].sum())
        if n and n < stop - start:
            yield slice(a, a + n), slice(c, c + stop - start - n)


def align_triggers(presses: Sequence[float], triggers: Sequence[float], lag: float, tolerance: float) -> list[int]:
    """Place of the trigger of each press, or -1; both are sorted and keep their order. A pair within the
    tolerance costs its distance from the lag over the tolerance, a press without trigger costs 1, and leaving
    out a trigger is free. Of equal costs a pair comes before a missing press, and that before a trigger left out."""
    p, t = np.asarray(presses, dtype=float), np.asarray(triggers, dtype=float)
    out = np.full(len(p), -1)
    for mine, theirs in _blocks(p + lag, t, tolerance):
        x, y = p[mine], t[theirs]
        cost, choices = np.zeros(len(y) + 1), []
        for own in x:
            off = np.abs((y - own) - lag) / tolerance
            paired = np.where(off <= 1, cost[:-1] + off, np.inf)
            stay = cost + 1
            pair = np.concatenate([[False], paired <= stay[1:]])
            stay[1:] = np.minimum(stay[1:], paired)
            cost = np.minimum.accumulate(stay)  # triggers left out to the left of a place
            choices.append(np.where(cost < stay, 0, np.where(pair, 2, 1)).astype(np.int8))
        i, j = len(x), len(y)
        while i and j:
            kind = choices[i - 1][j]
            if kind == 2:
                out[mine.start + i - 1] = theirs.start + j - 1
            i, j = i - (kind > 0), j - (kind != 1)
    return out.tolist()


def match_triggers(presses: DataFrame, triggers: DataFrame, by: Sequence[str], lag: float, tolerance: float) -> DataFrame:
    """Presses with trigger time and recommended time: the trigger's, else the press plus the median lag of
    its group's matches (the expected lag without any). Rows without a time take no part.

    What a press can reach is within an island of times, so islands are solved by themselves, some at a time, and
    no task holds a group."""
    types = dict(presses.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", press_time double, trigger_time double"
    p = presses.where("time is not null").select(*by, (F.col("time") + lag).alias("t"), F.lit(0).alias("kind"), F.lit("").alias("id"), "time")
    t = triggers.where("time is not null").select(*by, F.col("time").alias("t"), F.lit(1).alias("kind"), F.lit("").alias("id"), "time")
    near = islands(p.unionByName(t), by, tolerance * (1 + 1e-9))

    def solve(rows: Rows) -> dict[str, Sequence]:
        press, trigger = np.sort(rows["time"][rows["kind"] == 0]), np.sort(rows["time"][rows["kind"] == 1])
        got = align_triggers(press, trigger, lag, tolerance)
        keys = {k: [rows[k][0]] * len(press) for k in by}
        return {**keys, "press_time": press.tolist(), "trigger_time": [float(trigger[j]) if j >= 0 else None for j in got]}

    dealt = near.withColumn("_islands", F.floor(F.col("_island") / 256))
    done = map_sequences(dealt.drop("_island", "id"), [*by, "_islands"], ["t", "kind"], solve, schema)
    done = cut(done.withColumn("trigger_time", F.when(~F.isnan("trigger_time"), F.col("trigger_time"))), "triggers")
    lags = done.where("trigger_time is not null").withColumn("_lag", F.col("trigger_time") - F.col("press_time"))
    usual = grouped_quantile(lags, "_lag", 0.5, by, "_usual")
    both = done.join(usual, list(by), "left")
    recommended = F.coalesce("trigger_time", F.col("press_time") + F.coalesce("_usual", F.lit(lag)))
    return both.select(*by, "press_time", "trigger_time", recommended.alias("recommended_time"))


def execution_times(timing: DataFrame, cues: DataFrame, keys: Sequence[str], times: Sequence[str], duration: str = "cue_duration") -> DataFrame:
    """Recording times less the cue's duration; a key with several durations is an error."""
    one = cues.groupBy(*keys).agg(F.min(duration).alias(duration), F.count("*").alias("_n"))
    checked = one.withColumn(duration, F.when(F.col("_n") == 1, F.col(duration)).otherwise(F.raise_error(F.lit("several cue durations for one key")))).drop("_n")
    out = timing.join(checked, list(keys), "left")
    return out.withColumns({f"execution_{t}": F.col(t) - F.col(duration) for t in times})


def with_label_facts(df: DataFrame, facts: DataFrame, true: str, predicted: str) -> DataFrame:
    """Facts of the true and of the predicted label, prefixed a_ and b_."""
    out = df
    for prefix, column in (("a_", true), ("b_", predicted)):
        side = facts.select(*[F.col(c).alias(f"{prefix}{c}") for c in facts.columns])
        out = out.join(side, out[column] == side[f"{prefix}label"], "left").drop(f"{prefix}label")
    return out


def compared(df: DataFrame, keys: Sequence[str], variant: str, first: str, second: str, metric: str, min_delta: float = 0.0) -> DataFrame:
    """Two variants side by side: the difference of a metric, and whether it reaches ``min_delta``."""
    of = lambda v: F.max(F.when(F.col(variant) == v, F.col(metric)))
    wide = df.where(F.col(variant).isin(first, second)).groupBy(*keys).agg(of(first).alias(first), of(second).alias(second))
    delta = F.col(second) - F.col(first)
    return wide.withColumn("delta", delta).withColumn("decision", F.when(delta.isNull(), "incomplete").when(delta >= min_delta, "better").when(delta <= -min_delta, "worse").otherwise("equal"))


def nearest(value: Column, targets: Sequence[float]) -> Column:
    """The target next to a value; the first of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(value - t).alias("d"), F.lit(float(t)).alias("t")) for t in targets]))["t"]
