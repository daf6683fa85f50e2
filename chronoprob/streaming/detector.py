"""The stimulus detector on streams: runs above a threshold, confirmed when they are causally final.

One machine, written in plain Python, holds a stream's open run; the same rules as in batch decide what an
event is. In Structured Streaming a stream's classes are stepped together and their states kept as one. Rows of a micro-batch are
stepped in order of time; rows older than what their stream has seen are passed on marked as late, not
used. A row without a score closes the stream (an end marker), as a flush does. With ``idle``, event-time timers
do so as well: when the watermark shows that a stream has been silent for so long, its open run comes out and its
state goes, so that streams without an end cost nothing for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class RunState:
    start: float | None = None
    last: float | None = None
    length: int = 0
    peak: float | None = None
    peak_time: float | None = None
    first: float | None = None
    seen: float | None = None
    below: bool = False
    kept_onset: float | None = None
    events: int = 0


@dataclass(frozen=True)
class Rules:
    min_consecutive: int = 1
    min_duration: float | None = None
    merge_gap: float | None = None
    refractory: float | None = None
    window: tuple[float, float] | None = None
    #: Seconds without a row after which a stream begins anew.
    idle: float | None = None


Event = tuple[int, float, float, float, int, float, float, float]


class Machine:
    """Steps rows of one stream and class; gives the events that become final."""

    def __init__(self, rules: Rules, state: RunState | None = None):
        self.rules, self.s = rules, state or RunState()

    def late(self, time: float) -> bool:
        return self.s.seen is not None and time < self.s.seen

    def step(self, time: float, score: float, threshold: float) -> list[Event]:
        s, r = self.s, self.rules
        if r.window is not None and time < r.window[0]:
            return []
        out: list[Event] = []
        if r.idle is not None and s.seen is not None and time - s.seen > r.idle:
            out += self.expire()
            s = self.s
        s.seen = time
        above = score >= threshold and (r.window is None or time <= r.window[1])
        if s.start is not None and s.below and (r.merge_gap is None or time - s.last > r.merge_gap):
            out += self._close(time)
        if above:
            if s.start is None:
                s.start, s.first, s.length, s.peak = time, score, 0, None
            s.last, s.below = time, False
            s.length += 1
            if s.peak is None or score > s.peak:
                s.peak, s.peak_time = score, time
        elif s.start is not None:
            s.below = True
            if r.merge_gap is None:
                out += self._close(time)
        return out

    def expire(self) -> list[Event]:
        """The open run's event as of the end of the silence; nothing of the stream is kept."""
        out = self._close(self.s.seen + self.rules.idle) if self.s.start is not None else []
        self.s = RunState()
        return out

    def flush(self) -> list[Event]:
        return self._close(self.s.seen) if self.s.start is not None else []

    def _close(self, now: float) -> list[Event]:
        s, r = self.s, self.rules
        start, out = s.start, []
        valid = s.length >= r.min_consecutive and (r.min_duration is None or s.last - start >= r.min_duration)
        soon = r.refractory is not None and s.kept_onset is not None and start - s.kept_onset < r.refractory
        if valid and not soon:
            out.append((s.events, start, s.last, s.peak_time, s.length, s.first, s.peak, now))
            s.kept_onset, s.events = start, s.events + 1
        s.start, s.below = None, False
        return out


STATE = "label array<int>, start array<double>, last array<double>, length array<int>, peak array<double>, peak_time array<double>, first array<double>, seen array<double>, below array<boolean>, kept_onset array<double>, events array<int>"
OUTPUT = "stream_id long, stimulus_label int, kind string, event_index int, onset_time double, offset_time double, peak_time double, run_length int, score_at_onset double, peak_score double, detection_confirmed_time double"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def detect(rows: DataFrame, rules: Rules, delay: str = "1 hour") -> DataFrame:
    """Events (kind event) and late rows (kind late) of a stream of (stream_id, stimulus_label, time, score,
    score_threshold). A row without time is a stream's end: its open run comes out and its state goes. With
    ``rules.idle`` the time in seconds is the event time under a watermark of ``delay``; rows behind it are dropped."""
    timed = rules.idle is not None

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machines = {label: Machine(rules, RunState(*kept)) for label, *kept in zip(*state.get)} if state.exists else {}
        found: list[tuple] = []
        ended: set[int] = set()
        # a stream's rows of one micro-batch have to be put in order: the trigger's size bounds them
        parts = [] if state.hasTimedOut else list(batches)
        if parts:
            labels, times, scores, thresholds = (np.concatenate([pdf[c].to_numpy() for pdf in parts]) for c in ("stimulus_label", "time", "score", "score_threshold"))
            order = np.argsort(times, kind="stable")
            for label, time, score, threshold in zip(*(v[order].tolist() for v in (labels, times, scores, thresholds))):
                machine = machines.get(label) or machines.setdefault(label, Machine(rules))
                if time != time or score != score:
                    found += [(*key, label, "event", *e) for e in machine.flush()]
                    if time != time:
                        ended.add(label)
                elif machine.late(time):
                    found.append((*key, label, "late", -1, time, time, time, 0, score, score, time))
                else:
                    found += [(*key, label, "event", *e) for e in machine.step(time, score, threshold)]
        timers: list[int] = []
        for label, machine in machines.items():
            if timed and machine.s.seen is not None:
                silent_at = int((machine.s.seen + rules.idle) * 1000) + 1
                if silent_at <= state.getCurrentWatermarkMs():
                    found += [(*key, label, "event", *e) for e in machine.expire()]
                    ended.add(label)
                elif label not in ended:
                    timers.append(silent_at)
        kept = [(label, *vars(machine.s).values()) for label, machine in machines.items() if label not in ended]
        if kept:
            state.update(tuple(map(list, zip(*kept))))
            if timers:
                state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=COLUMNS)

    assert len(fields(RunState)) + 1 == len(STATE.split(", "))
    if timed:
        rows = rows.withColumn("ts", F.timestamp_micros((F.col("time") * 1e6).cast("long"))).withWatermark("ts", delay)
    timer = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(update, OUTPUT, STATE, "append", timer)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a finite stream to its end into Parquet files, and read them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
