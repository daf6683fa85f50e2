"""What has to hold on large tables: results next to the SQL's rounding, and steps that grow with the input alone."""

from __future__ import annotations

import os
from collections import Counter

import __spark_entry__ as entry
import duckdb
import numpy as np
import pandas as pd

from chronoprob.operators import joins as J
from chronoprob.operators.ranks import quantiles


def test_interval_lists_are_not_broadcast(spark):
    windows = spark.range(50).selectExpr("id as trial_id", "explode(sequence(0, 3)) as window_index").selectExpr("*", "window_index * 0.5D as window_start", "window_index * 0.5D + 1 as window_stop")
    out = J.interval_overlap(windows, spark.createDataFrame([(1, 0.2, 0.7)], "trial_id long, start double, stop double"), ["trial_id"], 1.0)
    assert [(r.window_index, round(r.overlap, 9)) for r in out.orderBy("window_index").collect()] == [(0, 0.5), (1, 0.2)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, folder, name):
    """Rows that only the query, and rows that only its SQL gives, on the tables of ``folder``."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    got = Counter(tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(folder)).collect())
    return got - want, want - got


def test_paths_of_equal_scores(spark, tmp_path):
    """Streams of sf0.1 whose best paths differ only by rounding."""
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.1/events.parquet' where user_id in (516, 345, 321, 1349)) to '{tmp_path}/events.parquet'")
    assert against_sql(spark, tmp_path, "e25_structured_decode") == (Counter(), Counter())


def test_shared_values_next_to_a_quantile(spark):
    """The SQL's quantile of equal neighbours may be an ulp off."""
    rng = np.random.default_rng(1)
    rows = [(g, x) for g, x in enumerate(rng.normal(size=60).tolist()) for _ in range(6)] + [(60 + g, x) for g in range(60) for x in rng.normal(size=6).tolist()]
    qs = [0.25, 0.5, 0.75, 0.3, 0.9]
    got = {r.pos: list(r.q) for r in quantiles(spark.createDataFrame(rows, "pos long, v double"), qs).collect()}
    held = pd.DataFrame(rows, columns=["pos", "v"])  # noqa: F841
    want = dict(duckdb.sql(f"select pos, quantile_cont(v, {qs}) from held group by pos").fetchall())
    assert got == want


def in_another_order(df):
    """``df``, whose rows come in another order at each reading, as parts do in a cluster."""
    def mixed(batches):
        yield pd.concat(list(batches)).sample(frac=1.0, random_state=int.from_bytes(os.urandom(4)))

    return df.mapInPandas(mixed, df.schema)


def test_quantiles_of_rows_in_another_order_at_each_reading(spark):
    """Two readings of a sketch differ, so no two steps may read it."""
    from chronoprob.operators import features as T

    n = 80_000
    df = in_another_order(spark.range(0, n, 1, 1).selectExpr("id as row_id", "'source' as role", f"array(cast((id * 7919L) % {n}L as double)) as x"))
    got = quantiles(T.positions(df), [0.25, 0.5, 0.9]).first().q
    assert got == np.quantile(np.arange(float(n)), [0.25, 0.5, 0.9]).tolist()
    assert T.binarized(df).where("x[0] = 1").count() == n // 2


def test_distances_are_read_once(spark):
    """Rows at the median distance of their class are within a limit that is this median, also where another reading has other last bits."""
    from chronoprob.operators import augment as A

    def blurred(batches):
        by = 1 + 1e-12 * np.random.default_rng(int.from_bytes(os.urandom(4))).random(8)
        for pdf in batches:
            yield pdf.assign(x=[np.asarray(x) * by[k] for k, x in zip(pdf["label"], pdf["x"])])

    rng = np.random.default_rng(4)
    rows = [(i, i % 8, (np.full(5, 3.1 + i % 8) if i % 5 < 3 else rng.normal(size=5)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, label int, x array<double>").repartition(1)
    weights = {r.row_id: r.weight for r in A.outlier_weights(df.mapInPandas(blurred, df.schema), multiplier=0.0).collect()}
    assert {w for i, w in weights.items() if i % 5 < 3} == {1.0}


def test_sequences_share_their_steps(spark):
    """Sequences of many lengths at once, and across batches and chunks, as each by itself."""
    from chronoprob.operators import states as H
    from chronoprob.operators.sequences import map_tables

    rng = np.random.default_rng(3)
    lengths = [1, 7, 2, 30, 7, 1, 12]
    p = rng.dirichlet([1, 1, 1], size=sum(lengths))
    starts = np.cumsum([0, *lengths[:-1]])
    grid, stay = H.stay_grid(3, 4), rng.uniform(0.3, 0.9, size=len(lengths))
    ll, q, path = H.grid_log_likelihoods(p, starts, grid), H.posteriors(p, starts, stay), H.best_paths(np.log(p), starts, stay)
    for k, (a, n) in enumerate(zip(starts.tolist(), lengths)):
        own = p[a : a + n]
        moves = [np.where(np.eye(3, dtype=bool), s, (1 - s) / 2) for s in grid]
        for i, m in enumerate(moves):
            alpha = own[0] / 3
            for row in own[1:]:
                alpha = (alpha @ m) * row
            assert np.isclose(ll[k, i], np.log(alpha.sum()))
        assert np.allclose(q[a : a + n], H.forward_backward(np.log(own), stay[k]))
        assert path[a : a + n].tolist() == H.viterbi(np.log(own), stay[k]).tolist()
    rows = [(f"s{k}", float(t), p[a + t].tolist()) for k, (a, n) in enumerate(zip(starts.tolist(), lengths)) for t in range(n)]
    calls = map_tables(spark.createDataFrame(rows, "s string, time double, p array<double>"), ["s"], ["time"], lambda table, at: table.slice(0, 1).select(["time"]).set_column(0, "time", [[float(len(at))]]), "time double", rows=5)
    assert sum(r.time for r in calls.collect()) == len(lengths)
    assert calls.count() < len(lengths)


def test_nearest_rows_meet_no_packed_blocks(spark):
    """What goes to Python is rows, never pairs of blocks, so that a batch is as small as its rows."""
    from chronoprob.operators import decode as C

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=3).tolist()) for i in range(900)], "row_id long, label int, x array<double>")
    found = C.nearest_neighbours(rows.where("row_id % 3 > 0"), rows.where("row_id % 3 = 0"), 2, block=50)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    x = {r.row_id: np.array(r.x) for r in rows.collect()}
    got = {(r.row_id, r.place): r.train_id for r in found.collect()}
    for i in range(0, 900, 3):
        want = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in x if j % 3)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in want]


def test_covariances_of_many_trials_at_once(spark):
    from chronoprob.operators import features as T

    rng = np.random.default_rng(5)
    trials = {k: rng.normal(size=(2 + k % 2, 4 + k % 3)) for k in range(12)}
    rows = [(k, c, x[c].tolist()) for k, x in trials.items() for c in range(len(x))]
    got = {r.k: r.x for r in T.trial_covariances(spark.createDataFrame(rows, "k long, channel int, samples array<double>"), ["k"]).collect()}
    for k, x in trials.items():
        c = np.cov(x)
        c = 0.9 * c + 0.1 * np.trace(c) / len(c) * np.eye(len(c))
        values, vectors = np.linalg.eigh(c)
        m = (vectors * np.log(values)) @ vectors.T
        assert np.allclose(got[k], [m[i, j] * (1 if i == j else 2**0.5) for i in range(len(m)) for j in range(i, len(m))])
    stack = np.stack([np.cov(trials[k]) for k in (0, 2, 4)])
    assert np.allclose(T.logm(stack), [T.logm(m) for m in stack])
    assert T.vech(stack).shape == (3, 3)


def test_runs_of_many_sequences_at_once(spark):
    """Also for sequences that Arrow batches and tables cut in two; keys may be null. No grouped map is left."""
    from chronoprob.operators import runs as R

    rng = np.random.default_rng(6)
    rows = [(None if k == 3 else f"k{k % 2}", k, float(t), float(s)) for k in range(8) for t, s in enumerate(rng.random(5 + k))]
    df = spark.createDataFrame(rows, "g string, stream long, time double, score double")
    got = R.max_run_thresholds_with_duration(df, ["g"], ["stream"], (0.0, 100.0), 0.5, 2, 2.0)
    best = {}
    for k in range(8):
        own = [r for r in rows if r[1] == k]
        best.setdefault(own[0][0], []).append(R.longest_threshold([r[3] for r in own], [r[2] for r in own], 2, 2.0))
    assert {r.g: round(r.score_threshold, 9) for r in got.collect()} == {g: round(float(np.median(v)), 9) for g, v in best.items()}
    events = [(s, float(a), float(a + n), f"c{i}", float(rng.integers(0, 5))) for s in range(4) for i, (a, n) in enumerate(zip(rng.integers(0, 40, 25), rng.integers(0, 6, 25)))]
    found = spark.createDataFrame(events, "stream long, onset_time double, offset_time double, stimulus_class string, peak_score double")
    out = R.resolved(found, ["stream"], "non_max_suppression")
    want = []
    for e in sorted(events, key=lambda e: (e[0], -e[4], e[1], e[3])):
        if all(e[0] != k[0] or e[2] < k[1] or k[2] < e[1] for k in want):
            want.append(e)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_median_meet_in_shares_not_in_pairs_of_blocks(spark, monkeypatch):
    """More and smaller blocks do not multiply what is dealt out: each row goes to half of a fixed number of shares."""
    from chronoprob.operators import augment as A

    df = spark.createDataFrame([(i, [float(i % 97), float(i % 89)]) for i in range(600)], "row_id long, x array<double>")
    dealt, plain = [], type(df).repartition

    def seen(self, *a):
        dealt.append(self.count())
        return plain(self, *a)

    monkeypatch.setattr(type(df), "repartition", seen)
    x = np.array([r.x for r in df.collect()])
    d = ((x[:, None] - x) ** 2).sum(-1)[np.triu_indices(600, 1)]
    assert A.median_squared_distance(df, block=2) == np.median(d[d > 1e-12])
    assert dealt and max(dealt) <= 600 * (spark.sparkContext.defaultParallelism + 1)


def test_median_measures_few_pairs_exactly(spark, monkeypatch):
    """All pairs are gone through twice, after a guess inside the shares; products decide all but a few, beside far rows too."""
    from chronoprob.operators import augment as A

    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 8)) + 50
    x[:3] *= 1e5  # far rows
    x[3] = x[4]
    calls, plain, df = [], type(spark.range(1)).mapInArrow, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a: calls.append(1) or plain(self, *a))
    d = np.concatenate([((x[i + 1 :] - x[i]) ** 2).sum(axis=1) for i in range(len(x))])
    low, high = np.quantile(d, [0.49, 0.51]).tolist()
    assert A.median_squared_distance(df, block=500) == np.median(d[d > 1e-12])
    assert len(calls) <= 3
    u, v = (A._factors(part, x[3:].mean(axis=0), True) for part in (x[:1000], x[1000:]))
    assert u[2].dtype == np.float32
    for a, b, own in ((u, u, True), (u, v, False)):
        ours = [((v[0] - r) ** 2).sum(axis=1) if not own else ((a[0][i + 1 :] - r) ** 2).sum(axis=1) for i, r in enumerate(a[0])]
        ours, found = np.concatenate(ours), list(A._compared(a, b, own, low, high, 1e-12))
        doubt = np.concatenate([f[2] for f in found])
        assert len(doubt) < 0.03 * len(ours)
        assert sum(f[0] for f in found) + ((doubt > 1e-12) & (doubt < low)).sum() == ((ours > 1e-12) & (ours < low)).sum()
        assert sum(f[1] for f in found) + (doubt > high).sum() == (ours > high).sum()


def test_a_stream_keeps_one_state_for_all_its_classes(spark, tmp_path):
    """Two streams of three classes are two states, of which the classes that ended are gone."""
    from chronoprob.streaming import detector as S

    rows = [(k, c, float(t), 0.9 if (t + c) % 5 else 0.1, 0.5) for k in range(2) for c in range(3) for t in range(20)] + [(k, 2, None, None, 0.5) for k in range(2)]
    schema = "stream_id long, stimulus_label int, time double, score double, score_threshold double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = S.detect(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), S.Rules(2))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    want = []
    for k in range(2):
        for c in range(3):
            machine = S.Machine(S.Rules(2))
            mine = [r for r in rows if r[:2] == (k, c)]
            events = [e for r in mine if r[2] is not None for e in machine.step(*r[2:])] + (machine.flush() if c == 2 else [])
            want += [(k, c, e[1], e[2], e[4]) for e in events]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("stream_id", "stimulus_label", "onset_time", "offset_time", "run_length").collect()) == sorted(want)
