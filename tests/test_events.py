"""Runs, events, matching and the streaming machine against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoprob.operators import joins as J
from chronoprob.operators import runs as R
from chronoprob.streaming.detector import Machine, Rules


def best_assignment(events, notes, tolerance):
    """Brute force: most pairs, then least total latency."""
    best = (0, 0.0)
    for k in range(min(len(events), len(notes)) + 1):
        for es in itertools.combinations(range(len(events)), k):
            for ns in itertools.permutations(range(len(notes)), k):
                gaps = [abs(events[e] - notes[n]) for e, n in zip(es, ns)]
                if all(g <= tolerance for g in gaps):
                    best = min(best, (-k, sum(gaps)))
    return best


def test_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        events, notes = (sorted(rng.uniform(0, 3) for _ in range(rng.randint(0, 4))) for _ in range(2))
        got = J.assign(events, notes, 0.8)
        used = [j for j in got if j >= 0]
        assert len(set(used)) == len(used)
        gaps = [abs(events[i] - notes[j]) for i, j in enumerate(got) if j >= 0]
        assert (-len(used), pytest.approx(sum(gaps))) == best_assignment(events, notes, 0.8)


def test_matching_prefers_more_pairs(spark):
    events = spark.createDataFrame([(1, "e1", 1.0), (1, "e2", 1.4)], "stream_id long, event_id string, onset_time double")
    notes = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.5)], "stream_id long, annotation_id long, onset_time double")
    got = {r["event_id"]: r["matched_annotation_id"] for r in J.match_annotations(events, notes, ["stream_id"], 1.0).collect()}
    assert got == {"e1": "1", "e2": "2"}


def plain_events(rows, threshold, rules):
    """Batch rules over one sorted sequence, written out."""
    runs, current, gap_open = [], [], False
    for t, s in rows:
        if s >= threshold:
            if current and gap_open and (rules.merge_gap is None or t - current[-1][0] > rules.merge_gap):
                runs.append(current)
                current = []
            current.append((t, s))
            gap_open = False
        elif current:
            gap_open = True
    if current:
        runs.append(current)
    kept, last = [], None
    for run in runs:
        if len(run) >= rules.min_consecutive and (last is None or rules.refractory is None or run[0][0] - last >= rules.refractory):
            kept.append((run[0][0], run[-1][0], len(run)))
            last = run[0][0]
    return kept


@pytest.mark.parametrize("rules", [Rules(), Rules(2), Rules(1, merge_gap=2.0), Rules(2, merge_gap=1.5, refractory=6.0)])
def test_machine_and_batch_agree(spark, rules):
    rng = random.Random(5)
    data = [(k, float(t) + rng.random() / 2, rng.random()) for k in range(4) for t in range(40)]
    expected = []
    for k in range(4):
        seq = sorted((t, s) for key, t, s in data if key == k)
        machine, got = Machine(rules), []
        for t, s in seq:
            got += machine.step(t, s, 0.5)
        got += machine.flush()
        assert [(e[1], e[2], e[4]) for e in got] == plain_events(seq, 0.5, rules)
        expected += [(k, *e) for e in plain_events(seq, 0.5, rules)]
    df = spark.createDataFrame(data, "stream_id int, time double, score double")
    found = R.run_table(R.with_runs(df, ["stream_id"], F.lit(0.5), merge_gap=rules.merge_gap), ["stream_id"], rules.min_consecutive)
    if rules.refractory is not None:
        found = R.after_refractory(found, ["stream_id"], rules.refractory)
    assert sorted((r["stream_id"], r["onset_time"], r["offset_time"], r["run_length"]) for r in found.collect()) == sorted(expected)


def test_silence_begins_a_stream_anew():
    machine = Machine(Rules(2, refractory=50.0, idle=10.0))
    got = [e for t in (0.0, 1.0, 2.0, 20.0, 21.0, 40.0) for e in machine.step(t, 0.9, 0.5)]
    # index, onset, offset and length, and the end of the silence as the time of confirmation; no refractory time is kept
    assert [(e[0], e[1], e[2], e[4], e[7]) for e in got] == [(0, 0.0, 2.0, 3, 12.0), (0, 20.0, 21.0, 2, 31.0)]
    assert machine.expire() == [] and machine.s.seen is None  # one row is no run of two


def test_late_rows_are_known():
    machine = Machine(Rules())
    machine.step(2.0, 0.1, 0.5)
    assert machine.late(1.0) and not machine.late(2.0)


def test_longest_threshold_is_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(1, 8)
        scores, times = [rng.random() for _ in range(n)], sorted(rng.uniform(0, 5) for _ in range(n))
        options = [min(scores[i : j + 1]) for i in range(n) for j in range(i, n) if j - i + 1 >= 2 and times[j] - times[i] >= 1.0]
        assert R.longest_threshold(scores, times, 2, 1.0) == (max(options) if options else None)


def test_non_max_suppression(spark):
    data = [(1, "a", 0.0, 2.0, 0.9), (1, "b", 1.0, 3.0, 0.8), (1, "c", 2.5, 4.0, 0.7)]
    df = spark.createDataFrame(data, "stream_id int, stimulus_class string, onset_time double, offset_time double, peak_score double")
    got = [r["stimulus_class"] for r in R.resolved(df, ["stream_id"], "non_max_suppression").orderBy("onset_time").collect()]
    assert got == ["a", "c"]


def test_triggers():
    assert J.align_triggers([0.0, 1.0, 5.0], [0.1, 1.1, 3.0, 5.1], 0.1, 0.5) == [0, 1, 3]
    assert J.align_triggers([], [1.0], 0.1, 0.5) == []
    assert J.align_triggers([0.0, 0.9], [0.9, 1.8], 0.0, 1.0) == [-1, 0]  # triggers left out are free
    assert J.align_triggers([1.0, 2.0, 3.0, 4.0, 5.0], [0.4, 1.03, 2.03, 3.03, 5.03, 5.8], 0.03, 0.08) == [1, 2, 3, -1, 4]


def test_triggers_cost_least():
    rng = random.Random(11)

    def plain(presses, triggers, start=0):
        if not presses:
            return 0.0
        rest = [1 + plain(presses[1:], triggers, start)]
        for j in range(start, len(triggers)):
            off = abs(triggers[j] - presses[0] - 0.5) / 1.5
            if off <= 1:
                rest.append(off + plain(presses[1:], triggers, j + 1))
        return min(rest)

    for _ in range(200):
        presses, triggers = sorted(rng.uniform(0, 12) for _ in range(rng.randint(0, 6))), sorted(rng.uniform(0, 12) for _ in range(rng.randint(0, 7)))
        got = J.align_triggers(presses, triggers, 0.5, 1.5)
        used = [j for j in got if j >= 0]
        assert used == sorted(set(used))
        cost = sum(1 if j < 0 else abs(triggers[j] - x - 0.5) / 1.5 for x, j in zip(presses, got))
        assert cost == pytest.approx(plain(presses, triggers))


def test_matched_triggers_of_groups(spark):
    rng = random.Random(17)
    press = {g: sorted(rng.uniform(0, 400) for _ in range(40)) for g in "abc"}
    trigger = {g: sorted(x + 0.5 + rng.gauss(0, 0.4) for x in press[g] if rng.random() < 0.7) for g in "ab"}
    frame = lambda d: spark.createDataFrame([(g, t) for g, ts in d.items() for t in ts] + [("a", None)], "g string, time double")
    got = {(r["g"], r["press_time"]): (r["trigger_time"], r["recommended_time"]) for r in J.match_triggers(frame(press), frame(trigger), ["g"], 0.5, 1.5).collect()}
    assert len(got) == 120
    for g, times in press.items():
        mine = trigger.get(g, [])
        places = J.align_triggers(times, mine, 0.5, 1.5)
        lags = sorted(mine[j] - x for x, j in zip(times, places) if j >= 0)
        n = len(lags)
        usual = (lags[(n - 1) // 2] + lags[n // 2]) / 2 if n else 0.5
        for x, j in zip(times, places):
            assert got[g, x] == (mine[j] if j >= 0 else None, pytest.approx(mine[j] if j >= 0 else x + usual))


def test_islands_go_on_across_buckets_of_time(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([rng.uniform(0, 40), rng.uniform(0, 400)]), f"r{i}", i % 2) for k in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "stream_id int, t double, id string, kind int")
    for buckets in (1.0, 7.0, 1e6):
        got = {r["id"] + str(r["stream_id"]): r["_island"] for r in J.islands(df, ["stream_id"], 2.0, buckets).collect()}
        for k in range(3):
            line = sorted((t, kind, name) for s, t, name, kind in rows if s == k)
            island, last = 0, None
            for t, _, name in line:
                island += last is None or t - last > 2.0
                last = t
                assert got[name + str(k)] == island


def test_interval_join_equals_the_plain_one(spark):
    rng = random.Random(2)
    w = [(i, 1, a, a + rng.uniform(0.1, 3)) for i in range(20) for a in [rng.uniform(0, 10)]]
    p = [(i, 1, a, a + rng.uniform(0.1, 3)) for i in range(20) for a in [rng.uniform(0, 10)]]
    windows = spark.createDataFrame(w, "wid int, k int, window_start double, window_stop double")
    presses = spark.createDataFrame(p, "pid int, k int, start double, stop double")
    got = {(r["wid"], r["pid"]): r["overlap"] for r in J.interval_overlap(windows, presses, ["k"], 1.0).collect()}
    plain = {(a[0], b[0]): min(a[3], b[3]) - max(a[2], b[2]) for a in w for b in p if min(a[3], b[3]) - max(a[2], b[2]) > 0}
    assert got == pytest.approx(plain)


def test_sequences_go_on_across_batches(spark):
    from chronoprob.operators.sequences import map_sequences, runs

    rng = random.Random(19)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, j int, t int")
    solve = lambda r: {"k": r["k"].tolist()[:1], "n": [len(r["t"])], "first": [int(r["t"][0])], "sorted": [bool((r["t"][1:] > r["t"][:-1]).all())]}
    got = map_sequences(df, ["k", "j"], ["t"], solve, "k string, n int, first int, sorted boolean").collect()
    expected = {}
    for k, j, t in rows:
        expected.setdefault((k, j), []).append(t)
    assert sorted((str(r["k"]), r["n"], r["first"]) for r in got) == sorted((str(k), len(v), v[0]) for (k, _), v in expected.items())
    assert all(r["sorted"] for r in got)
    import pandas as pd

    split = [pd.DataFrame({"k": ["a", "a"]}), pd.DataFrame({"k": []}), pd.DataFrame({"k": ["a", "b"]}), pd.DataFrame({"k": ["c"]})]
    assert [r["k"].tolist() for r in runs(iter(split), ["k"])] == [["a"] * 3, ["b"], ["c"]]
