"""Queries on probability adaptation, ensembles and state models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.operators import adapt as D
from chronoprob.operators import ensembles as N
from chronoprob.operators import joins as J
from chronoprob.operators import states as H
from chronoprob.sources.observations import cut

from .fixtures import BOTH_SQL, FEAT_SQL, N_FEATURES, OBS_SQL, both, feat, obs
from .metrics import NLL, rounded
from .registry import query
from .tables import PS

EVEN = [0.2] * 5


def entries(df: DataFrame, *keep: str, places=(0, 4), digits: int = 9) -> DataFrame:
    return df.select(*keep, *[F.round(F.get("p", F.lit(i)), digits).alias(f"q{i}") for i in places])


def _em_sql(keys: str, source: str) -> str:
    """Two rounds of EM from even shares."""
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    j = f" JOIN r1 USING ({keys})" if keys else ", r1"
    first = ", ".join(f"avg({p}) AS t{i}" for i, p in enumerate(PS))
    tot = " + ".join(f"{p} * t{i}" for i, p in enumerate(PS))
    second = ", ".join(f"round(avg({p} * t{i} / ({tot})), 9) AS prior{i}" for i, p in enumerate(PS))
    return f"WITH {OBS_SQL}, r1 AS (SELECT {k}{first} FROM {source}{g}) SELECT {k}{second} FROM {source}{j}{g}"


def _priors(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.get("prior", F.lit(i)), 9).alias(f"prior{i}") for i in range(5)])


@query("l1_prior_shift", _em_sql("", "obs"))
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return _priors(D.prior_shift(obs(spark, sf), EVEN, iterations=2))


@query("l2_block_prior_shift", _em_sql("subject", "obs"))
def l2(spark: SparkSession, sf: str) -> DataFrame:
    return _priors(D.prior_shift(obs(spark, sf), EVEN, ["subject"], iterations=2), "subject")


def _rounds_sql(n: int) -> str:
    """Rows under the prior of their subject after ``n`` rounds of EM."""
    tot = " + ".join(f"p{i} * t{i}" for i in range(5))
    rounds = [f"r1 AS (SELECT subject, {', '.join(f'avg(p{i}) AS t{i}' for i in range(5))} FROM obs GROUP BY 1)"]
    rounds += [f"r{k} AS (SELECT subject, {', '.join(f'avg(p{i} * t{i} / ({tot})) AS t{i}' for i in range(5))} FROM obs JOIN r{k - 1} USING (subject) GROUP BY 1)" for k in range(2, n + 1)]
    return f"WITH {OBS_SQL}, {', '.join(rounds)} SELECT event_id, round(p0 * t0 / ({tot}), 9) AS q0, round(p4 * t4 / ({tot}), 9) AS q4 FROM obs JOIN r{n} USING (subject)"


@query("l2_adapted_rows", _rounds_sql(6))
def l2_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows under the prior of their block after six rounds."""
    o = obs(spark, sf)
    return entries(D.shifted(o, D.prior_shift(o, EVEN, ["subject"], iterations=6), EVEN, ["subject"]), "event_id")


@query("l3_black_box_shift")
def l3(spark: SparkSession, sf: str) -> DataFrame:
    """Rows moved to the prior that the confusion of the baseline rows explains best."""
    o = obs(spark, sf)
    prior = D.black_box_shift(o.where("time < 864000"), o.where("time >= 864000"), "true_label")
    return entries(o.where("time >= 864000").withColumn("p", P.reweighted(F.col("p"), F.array(*map(F.lit, prior)), F.array(*map(F.lit, EVEN)))), "event_id")


PROPORTION = (0.3, 0.1, 0.2, 0.1, 0.3)
WTOT = " + ".join(f"p{i} * {t} / m{i}" for i, t in enumerate(PROPORTION))


@query("l4_label_proportions", f"WITH {OBS_SQL}, m AS (SELECT {', '.join(f'avg(p{i}) AS m{i}' for i in range(5))} FROM obs) SELECT event_id, round(p0 * 0.3 / m0 / ({WTOT}), 9) AS q0, round(p4 * 0.3 / m4 / ({WTOT}), 9) AS q4 FROM obs, m")
def l4(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.to_proportions(obs(spark, sf), PROPORTION, iterations=1), "event_id")


def _tempered_nll(t: float) -> str:
    return f"-ln(greatest(pow(greatest(ptrue, 1e-15), {1 / t!r}) / ({' + '.join(f'pow(greatest({p}, 1e-15), {1 / t!r})' for p in PS)}), 1e-15))"


@query("l5_temperature", f"WITH {OBS_SQL}, g AS ({' UNION ALL '.join(f'SELECT subject, {t} AS temperature, avg({_tempered_nll(t)}) AS l FROM obs GROUP BY 1' for t in (0.5, 1.0, 2.0))}) SELECT subject, CAST(arg_min(temperature, l) AS DOUBLE) AS temperature, round(min(l), 9) AS log_loss FROM g GROUP BY 1")
def l5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.best_temperature(obs(spark, sf), "true_label", [0.5, 1.0, 2.0], ["subject"]))


@query("l6_source_calibrator", f"WITH {OBS_SQL}, b AS (SELECT {', '.join(f'greatest(avg(CASE WHEN true_label = {i} THEN 1.0 ELSE 0.0 END), 1e-6) / avg(p{i}) AS b{i}' for i in range(5))} FROM obs WHERE time < 864000) SELECT event_id, round(p0 * b0 / ({' + '.join(f'p{i} * b{i}' for i in range(5))}), 9) AS q0, round(p4 * b4 / ({' + '.join(f'p{i} * b{i}' for i in range(5))}), 9) AS q4 FROM obs, b")
def l6(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return entries(D.calibrated(o, o.where("time < 864000"), "true_label", "class_bias"), "event_id")


MARGIN = f"(list_sort([{', '.join(PS)}], 'DESC')[1] - list_sort([{', '.join(PS)}], 'DESC')[2])"


@query("l7_confidence_filter", f"WITH {OBS_SQL}, k AS (SELECT event_id, pred, conf, conf >= 0.3 AND {MARGIN} >= 0.05 AS ok FROM obs), r AS (SELECT *, row_number() OVER (PARTITION BY pred, ok ORDER BY conf DESC, event_id) AS n FROM k) SELECT event_id, ok AND n <= 50 AS keep FROM r")
def l7(spark: SparkSession, sf: str) -> DataFrame:
    return D.confident(obs(spark, sf), "event_id", 0.3, 0.05, per_class=50).select("event_id", "keep")


@query("l8_graph_smoothing", f"WITH {OBS_SQL}, ed AS (SELECT a.event_id AS src, b.event_id AS dst FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.event_id <> b.event_id AND abs(a.time - b.time) <= 20000), m AS (SELECT src, avg(p0) AS m0, avg(p4) AS m4 FROM ed JOIN obs ON obs.event_id = ed.dst GROUP BY 1) SELECT event_id, round(CASE WHEN m0 IS NULL THEN p0 ELSE 0.5 * p0 + 0.5 * m0 END, 9) AS q0, round(CASE WHEN m4 IS NULL THEN p4 ELSE 0.5 * p4 + 0.5 * m4 END, 9) AS q4 FROM obs LEFT JOIN m ON m.src = obs.event_id")
def l8(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours are a stream's rows within 20,000 seconds, found by the bucketed interval join."""
    o = obs(spark, sf)
    t = F.col("time")
    left = o.select("stream_id", F.col("event_id").alias("src"), (t - 20000).alias("window_start"), (t + 20000).alias("window_stop"))
    right = o.select("stream_id", F.col("event_id").alias("dst"), t.alias("start"), (t + 1e-6).alias("stop"))
    near = J.interval_overlap(left, right, ["stream_id"], 40000.0).where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))
    return entries(D.graph_smoothed(o.select("event_id", "p"), near, "event_id", 0.5, 1), "event_id")


def _affinity_sql(k: int, gamma: float) -> str:
    """One round over the graph of k nearest rows, from the centroid decoder's probabilities."""
    from .decoding import D8, MEANS, d2

    return f"""WITH {FEAT_SQL}, {MEANS}, sc AS (SELECT t.row_id, cm.label, -({d2('t', 'cm', 'sd')}) AS sc FROM feat t, cm, sd WHERE t.role = 'target'), ex AS (SELECT row_id, label, exp(sc - max(sc) OVER (PARTITION BY row_id)) AS e FROM sc),
p AS (SELECT row_id, label, e / sum(e) OVER (PARTITION BY row_id) AS p FROM ex), ts AS (SELECT {', '.join(f'avg(x{i}) AS m{i}, greatest(stddev_samp(x{i}), 1e-12) AS s{i}' for i in D8)} FROM feat WHERE role = 'target'),
z AS (SELECT row_id, {', '.join(f'(x{i} - m{i}) / s{i} AS x{i}' for i in D8)} FROM feat, ts WHERE role = 'target'), d AS (SELECT a.row_id AS src, b.row_id AS dst, {' + '.join(f'power(a.x{i} - b.x{i}, 2)' for i in D8)} AS d FROM z a JOIN z b ON a.row_id <> b.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS n FROM d), e AS (SELECT DISTINCT src, dst, exp(-{gamma} * d) AS w FROM (SELECT src, dst, d FROM k WHERE n <= {k} UNION ALL SELECT dst, src, d FROM k WHERE n <= {k})),
m AS (SELECT src, label, sum(w * p) / sum(w) AS m FROM e JOIN p ON p.row_id = e.dst GROUP BY 1, 2), q AS (SELECT p.row_id, p.label, 0.5 * p + 0.5 * m AS q FROM p JOIN m ON m.src = p.row_id AND m.label = p.label)
SELECT row_id, CAST(arg_max(label, q) AS INTEGER) AS predicted, round(max(q), 6) AS confidence FROM q GROUP BY 1"""


@query("l8_affinity_graph", _affinity_sql(5, 0.01))
def l8_affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Target rows' probabilities after a round over the graph of their nearest rows; tests run it to its stop."""
    from chronoprob.operators.decode import centroid

    f = feat(spark, sf)
    p = centroid(f.where("role = 'source'"), f.where("role = 'target'")).select("row_id", "p")
    rows = f.where("role = 'target'").select("row_id", "x").join(p, "row_id")
    out, _ = D.affinity_smoothed(rows, 5, 0.5, 1, gamma=0.01)
    return out.select("row_id", P.predicted_index(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"))


LOGS = [f"sqrt(greatest(a.p{i}, 1e-15) * greatest(b.p{i}, 1e-15))" for i in range(5)]


@query("l9_log_ensemble", f"WITH {BOTH_SQL} SELECT event_id, round({LOGS[0]} / ({' + '.join(LOGS)}), 9) AS q0, round({LOGS[4]} / ({' + '.join(LOGS)}), 9) AS q4 FROM obs a JOIN obs_b b USING (event_id)")
def l9(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.ensemble(J.aligned_cube(both(spark, sf), ["event_id"]), "log", [1.0, 1.0]), "event_id")


_SURE = "greatest(0, 1 + (" + " + ".join("greatest({0}.p%d, 1e-12) * ln(greatest({0}.p%d, 1e-12))" % (i, i) for i in range(5)) + ") / ln(5))"
CONF = [f"(a.p{i} * {_SURE.format('a')} + b.p{i} * {_SURE.format('b')})" for i in range(5)]


@query("l9_confidence_ensemble", f"WITH {BOTH_SQL} SELECT event_id, round({CONF[0]} / ({' + '.join(CONF)}), 9) AS q0, round({CONF[4]} / ({' + '.join(CONF)}), 9) AS q4 FROM obs a JOIN obs_b b USING (event_id)")
def l9_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.ensemble(J.aligned_cube(both(spark, sf), ["event_id"]), "confidence_probability", [1.0, 1.0]), "event_id")


AGREE = "power(1 - (" + " + ".join(f"abs(a.p{i} - b.p{i})" for i in range(5)) + ") / 4, 2)"


@query("l9_agreement_ensemble", f"WITH {BOTH_SQL}, w AS (SELECT a.event_id, {AGREE} * 2 AS wa, {AGREE} AS wb, a.p0 AS a0, a.p4 AS a4, b.p0 AS b0, b.p4 AS b4 FROM obs a JOIN obs_b b USING (event_id)) SELECT event_id, round((wa * a0 + wb * b0) / (wa + wb), 9) AS q0, round((wa * a4 + wb * b4) / (wa + wb), 9) AS q4 FROM w")
def l9_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.ensemble(J.aligned_cube(both(spark, sf), ["event_id"]), "agreement_probability", [2.0, 1.0]), "event_id")


_RANK = [" + ".join(f"CASE WHEN {{0}}.p{j} < {{0}}.p{i}{f' OR {{0}}.p{j} = {{0}}.p{i}' if j < i else ''} THEN 0.25 ELSE 0 END" for j in range(5) if j != i) for i in range(5)]
RANKS = [f"exp((({r.format('a')}) + ({r.format('b')})) / 2)" for r in _RANK]


@query("l9_rank_ensemble", f"WITH {BOTH_SQL} SELECT event_id, round({RANKS[0]} / ({' + '.join(RANKS)}), 9) AS q0, round({RANKS[4]} / ({' + '.join(RANKS)}), 9) AS q4 FROM obs a JOIN obs_b b USING (event_id)")
def l9_rank(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.ensemble(J.aligned_cube(both(spark, sf), ["event_id"]), "rank"), "event_id")


def _stacking_sql(steps: int, rate: float, log: bool) -> str:
    """A chain of gradient steps on the weights of two decoders, on the class-balanced loss."""
    true = lambda t: "CASE a.true_label " + " ".join(f"WHEN {i} THEN {t}.p{i}" for i in range(5)) + " END"
    first = f"q AS (SELECT a.event_id, 1.0 / count(*) OVER (PARTITION BY a.true_label) AS s, {true('a')} AS qa, {true('b')} AS qb, {', '.join(f'a.p{i} AS a{i}, b.p{i} AS b{i}' for i in range(5))} FROM obs a JOIN obs_b b USING (event_id)), w0 AS (SELECT 0.5 AS wa, 0.5 AS wb)"
    pool = [f"exp(wa * ln(a{i}) + wb * ln(b{i}))" for i in range(5)]
    expected = lambda t: "(" + " + ".join(f"{p} * ln({t}{i})" for i, p in enumerate(pool)) + f") / ({' + '.join(pool)})"
    gain = lambda t: f"ln(q{t}) - {expected(t)}" if log else f"q{t} / greatest(wa * qa + wb * qb, 1e-12)"
    part = [f"g{k + 1} AS (SELECT wa, wb, sum(s * ({gain('a')})) / sum(s) AS ga, sum(s * ({gain('b')})) / sum(s) AS gb FROM q, w{k} GROUP BY wa, wb), w{k + 1} AS (SELECT wa * exp({rate / (k + 1) ** 0.5!r} * ga) / (wa * exp({rate / (k + 1) ** 0.5!r} * ga) + wb * exp({rate / (k + 1) ** 0.5!r} * gb)) AS wa, wb * exp({rate / (k + 1) ** 0.5!r} * gb) / (wa * exp({rate / (k + 1) ** 0.5!r} * ga) + wb * exp({rate / (k + 1) ** 0.5!r} * gb)) AS wb FROM g{k + 1})" for k in range(steps)]
    shown = [f"{pool[i]} / ({' + '.join(pool)})" if log else f"wa * a{i} + wb * b{i}" for i in (0, 4)]
    return f"WITH {BOTH_SQL}, {first}, {', '.join(part)} SELECT event_id, round({shown[0]}, 9) AS q0, round({shown[1]}, 9) AS q4 FROM q, w{steps}"


def _stacked(spark: SparkSession, sf: str, steps: int, pooling: str) -> DataFrame:
    cube = cut(J.aligned_cube(both(spark, sf), ["event_id", "true_label"]), "stacked")  # read for sizes, weights and rows
    weights = D.stacking_weights(cube, "true_label", 2, steps, 0.5, pooling)
    return entries(D.ensemble(cube, "log" if pooling == "log" else "probability", weights), "event_id")


@query("l10_stacking", _stacking_sql(20, 0.5, False))
def l10(spark: SparkSession, sf: str) -> DataFrame:
    """A pool of probabilities under weights learnt by gradient steps."""
    return _stacked(spark, sf, 20, "linear")


@query("l10_log_stacking", _stacking_sql(8, 0.5, True))
def l10_log(spark: SparkSession, sf: str) -> DataFrame:
    """A pool of log probabilities under weights learnt by gradient steps."""
    return _stacked(spark, sf, 8, "log")


def _searched_sql(step: float = 0.25) -> str:
    points = ", ".join(f"({k}, {k * step!r}::DOUBLE, {1 - k * step!r}::DOUBLE)" for k in range(int(round(1 / step)) + 1))
    sums = [f"a * ln(least(1.0, greatest(x.p{i}, 1e-12))) + b * ln(least(1.0, greatest(y.p{i}, 1e-12)))" for i in range(5)]
    best = " ".join(f"WHEN z{i} = greatest(z0, z1, z2, z3, z4) THEN {i}" for i in range(5))
    return f"""WITH {OBS_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY stream_id, wanted ORDER BY abs(time - wanted), time) AS n FROM obs, (VALUES (500000.0), (1500000.0)) v(wanted)),
c AS (SELECT x.stream_id, x.subject, x.stream_id % 5 AS y, k, a, {', '.join(f'{s} AS z{i}' for i, s in enumerate(sums))} FROM w x JOIN w y ON x.stream_id = y.stream_id AND x.n = 1 AND y.n = 1 AND x.wanted < y.wanted, (VALUES {points}) g(k, a, b)),
h AS (SELECT *, CASE {best} END AS pred FROM c), o AS (SELECT subject, y, k, count(*) AS n, count(*) FILTER (WHERE pred = y) AS hits FROM h GROUP BY 1, 2, 3),
r AS (SELECT s.subject, o.y, k, sum(n) AS n, sum(hits) AS hits FROM (SELECT DISTINCT subject FROM h) s JOIN o ON o.subject <> s.subject GROUP BY 1, 2, 3), sc AS (SELECT subject, k, round(avg(hits / n), 12) AS score FROM r GROUP BY 1, 2),
b AS (SELECT subject, k FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, k) AS place FROM sc) WHERE place = 1)
SELECT stream_id, round(a, 6) AS first_weight, CAST(pred AS INTEGER) AS predicted, round(1 / ({' + '.join(f'exp(z{i} - greatest(z0, z1, z2, z3, z4))' for i in range(5))}), 9) AS confidence FROM h JOIN b USING (subject, k)"""


@query("l11_weight_search", _searched_sql())
def l11_search(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of two windows for each subject, by the balanced accuracy of all other subjects' streams."""
    rows = obs(spark, sf).withColumn("y", (F.col("stream_id") % 5).cast("int"))
    out = N.response_window_ensemble(rows, ["stream_id"], [500000.0, 1500000.0], "subject", "y", 0.25)
    shown = out.select("stream_id", F.round(F.get("weights", F.lit(0)), 6).alias("first_weight"), P.predicted_index(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 9).alias("confidence"))
    return shown


@query("l11_response_windows", f"WITH {OBS_SQL}, w AS (SELECT stream_id, wanted, p0, p4, row_number() OVER (PARTITION BY stream_id, wanted ORDER BY abs(time - wanted), time) AS n FROM obs, (VALUES (500000.0), (1500000.0)) v(wanted)) SELECT stream_id, round(avg(p0), 9) AS q0, round(avg(p4), 9) AS q4 FROM w WHERE n = 1 GROUP BY 1")
def l11(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.response_windows(obs(spark, sf), ["stream_id"], [500000.0, 1500000.0]), "stream_id")


_DOMAIN_MODELS = f"""WITH {FEAT_SQL}, cm AS (SELECT domain, label, {', '.join(f'avg(x{i}) AS m{i}' for i in range(N_FEATURES))} FROM feat WHERE role = 'source' GROUP BY 1, 2),
s AS (SELECT t.row_id, cm.domain, cm.label, exp(-({' + '.join(f'(t.x{i} - m{i}) * (t.x{i} - m{i})' for i in range(N_FEATURES))})) AS e FROM feat t, cm WHERE t.role = 'target'), p AS (SELECT row_id, domain, label, e / sum(e) OVER (PARTITION BY row_id, domain) AS p FROM s)"""
_DOMAIN_SHOWN = "SELECT row_id, round(max(CASE WHEN label = 0 THEN p END), 9) AS q0, round(max(CASE WHEN label = 4 THEN p END), 9) AS q4 FROM a GROUP BY 1"


@query("l12_domain_ensemble", f"{_DOMAIN_MODELS}, a AS (SELECT row_id, label, avg(p) AS p FROM p GROUP BY 1, 2) {_DOMAIN_SHOWN}")
def l12(spark: SparkSession, sf: str) -> DataFrame:
    """One centroid model for each source domain, averaged over the domains."""
    return entries(N.domain_ensemble(feat(spark, sf))[0], "row_id")


@query("l12_confidence_weights", f"{_DOMAIN_MODELS}, c AS (SELECT domain, avg(m) AS c FROM (SELECT row_id, domain, max(p) AS m FROM p GROUP BY 1, 2) GROUP BY 1), w AS (SELECT domain, exp(c / 0.01) / sum(exp(c / 0.01)) OVER () AS w FROM c), a AS (SELECT row_id, label, sum(w * p) AS p FROM p JOIN w USING (domain) GROUP BY 1, 2) {_DOMAIN_SHOWN}")
def l12_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Domains weighted by how sure their models are on the target."""
    return entries(N.domain_ensemble(feat(spark, sf), "target_confidence", 0.01)[0], "row_id")


@query("l12_similarity_weights")
def l12_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Domains weighted by how near their mean and covariance are to the target's; tested against numpy."""
    return entries(N.domain_ensemble(feat(spark, sf), "target_feature_similarity", 0.1)[0], "row_id")


_H = "(" + " + ".join("{0}%d * ln(greatest({0}%d, 1e-15))" % (i, i) for i in range(5)) + ") / ln(5)"
CONSENSUS = f"""WITH {BOTH_SQL}, v AS (SELECT decoder, 1 + avg({_H.format("p")}) AS c, {', '.join(f'avg(p{i}) AS m{i}' for i in range(5))} FROM both_obs GROUP BY 1),
e AS (SELECT decoder, exp(c - {_H.format("m")}) AS e FROM v), w AS (SELECT decoder, e / sum(e) OVER () AS w FROM e)"""
LOG_POOL = f"{CONSENSUS}, l AS (SELECT event_id, {', '.join(f'exp(sum(w * ln(greatest(p{i}, 1e-15)))) AS l{i}' for i in range(5))} FROM both_obs JOIN w USING (decoder) GROUP BY 1) SELECT event_id, round(l0 / (l0 + l1 + l2 + l3 + l4), 9) AS q0, round(l4 / (l0 + l1 + l2 + l3 + l4), 9) AS q4 FROM l"


@query("l13_consensus", LOG_POOL)
def l13(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.consensus(both(spark, sf), "decoder", "event_id"), "event_id")


@query("l13_arithmetic_consensus", f"{CONSENSUS} SELECT event_id, round(sum(w * p0), 9) AS q0, round(sum(w * p4), 9) AS q4 FROM both_obs JOIN w USING (decoder) GROUP BY 1")
def l13_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.consensus(both(spark, sf), "decoder", "event_id", "arithmetic_mean"), "event_id")


CORR = [f"p{i} / sqrt(0.9 * m{i} + 0.02)" for i in range(5)]


@query("l14_prior_correction", f"WITH {OBS_SQL}, m AS (SELECT subject, {', '.join(f'avg(p{i}) AS m{i}' for i in range(5))} FROM obs GROUP BY 1) SELECT event_id, round({CORR[0]} / ({' + '.join(CORR)}), 9) AS q0, round({CORR[4]} / ({' + '.join(CORR)}), 9) AS q4 FROM obs JOIN m USING (subject)")
def l14(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.prior_corrected(obs(spark, sf), keys=["subject"]), "event_id")


@query("l15_bundle_mean", f"WITH {BOTH_SQL} SELECT event_id, round(avg(p0), 9) AS q0, round(avg(p4), 9) AS q4, count(*) = 2 AND count(DISTINCT decoder) = 2 AS complete FROM both_obs GROUP BY 1")
def l15(spark: SparkSession, sf: str) -> DataFrame:
    return entries(D.bundle_mean(both(spark, sf), ["event_id"], "decoder", 2), "event_id", "complete")


@query("l16_pairwise_rerank")
def l16_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of the first fold, whose three best classes are told apart by models of the other folds' rows."""
    o = obs(spark, sf)
    held, rest = o.where("fold = 0"), o.where("fold <> 0")
    out, alpha = N.pairwise_reranked(rest.select("p", "true_label"), held, "true_label", 5, 3)
    return out.select("event_id", P.predicted_index(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence")).withColumn("alpha", F.lit(alpha))


@query("l16_top_candidates", f"WITH {BOTH_SQL}, l AS (SELECT decoder, fold, round(avg({NLL}), 12) AS l FROM both_obs GROUP BY 1, 2), s AS (SELECT decoder || fold AS candidate, -l AS score FROM l) SELECT candidate, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, candidate) AS INTEGER) AS place FROM s ORDER BY score DESC, candidate LIMIT 3")
def l16(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.round(F.avg(P.log_loss(F.col("p"), F.col("true_label"))), 12)
    s = both(spark, sf).groupBy("decoder", "fold").agg((-loss).alias("score")).select(F.concat("decoder", F.col("fold").cast("string")).alias("candidate"), "score")
    return rounded(D.best_candidates(s, "candidate", "score", 3))


def _fit(spark: SparkSession, sf: str, **control) -> DataFrame:
    return H.fit(both(spark, sf), ["decoder"], ["stream_id"], 5, 20, **control)


_K = "[1, 2, 3, 4, 5]"
#: Forward recursions of both decoders at each of 20 stay probabilities, scaled to sum one at each row.
FIT_SQL = f"""{BOTH_SQL}, sq AS (SELECT decoder, stream_id, event_id, time, row_number() OVER (PARTITION BY decoder, stream_id ORDER BY time) AS n, [p0, p1, p2, p3, p4] AS e FROM both_obs),
gr AS (SELECT i, 0.2 + i * 0.795 / 19 AS s FROM unnest(range(20)) g(i)),
fw AS (SELECT decoder, stream_id, i, s, n, [x / list_sum(e) for x in e] AS a, ln(list_sum(e) / 5) AS ll FROM sq, gr WHERE n = 1
  UNION ALL SELECT decoder, stream_id, i, s, n, [x / list_sum(b) for x in b], ll + ln(list_sum(b)) FROM (
    SELECT sq.decoder, sq.stream_id, fw.i, fw.s, sq.n, fw.ll, [sq.e[k] * (fw.a[k] * fw.s + (1 - fw.a[k]) * (1 - fw.s) / 4) for k in {_K}] AS b FROM fw JOIN sq ON sq.decoder = fw.decoder AND sq.stream_id = fw.stream_id AND sq.n = fw.n + 1)),
en AS (SELECT decoder, stream_id, max(n) AS n FROM sq GROUP BY 1, 2),
ls AS (SELECT decoder, i, s, sum(ll) AS ll, CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_sequences FROM fw JOIN en USING (decoder, stream_id, n) GROUP BY 1, 2, 3),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decoder ORDER BY ll DESC, i) AS place FROM ls) WHERE place = 1)"""


@query("e17_sticky_fit", f"WITH RECURSIVE {FIT_SQL} SELECT decoder, CAST(0 AS INTEGER) AS rep, round(s, 6) AS stay_probability, round(ll, 6) AS log_likelihood, round(ll / n_observations + ln(5), 6) AS gain, n_observations, n_sequences FROM ft")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    """Stay probability of each decoder, from one recursion over each sequence."""
    return rounded(_fit(spark, sf), 6)


@query("e18_controls")
def e18(spark: SparkSession, sf: str) -> DataFrame:
    seen = _fit(spark, sf)
    return rounded(H.control_test(seen, _fit(spark, sf, control="shuffled_time", n_controls=4), ["decoder"]), 6)


@query("e19_state_traces")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    stay = _fit(spark, sf).select("decoder", "stay_probability")
    t = H.traces(both(spark, sf).withColumn("id", F.concat("decoder", F.col("event_id").cast("string"))), stay, ["decoder"], ["stream_id"], "id")
    return t.select("id", "state", F.round(F.get("posterior", F.lit(0)), 6).alias("posterior0"))


SMOOTH_SQL = f"""WITH RECURSIVE {FIT_SQL}, po AS (SELECT stream_id, event_id, e, row_number() OVER (PARTITION BY stream_id ORDER BY time) AS n FROM sq WHERE decoder = 'a' AND time >= 864000),
sm AS (SELECT stream_id, event_id, n, e AS a, s FROM po, (SELECT s FROM ft WHERE decoder = 'a') WHERE n = 1
  UNION ALL SELECT stream_id, event_id, n, [x / list_sum(b) for x in b], s FROM (
    SELECT po.stream_id, po.event_id, po.n, sm.s, [po.e[k] * (sm.a[k] * sm.s + (1 - sm.a[k]) * (1 - sm.s) / 4) for k in {_K}] AS b FROM sm JOIN po ON po.stream_id = sm.stream_id AND po.n = sm.n + 1))
SELECT event_id, round(a[1], 6) AS posterior0 FROM sm UNION ALL SELECT event_id, round(e[1], 6) FROM sq WHERE decoder = 'a' AND time < 864000"""


@query("e21_smoothing", SMOOTH_SQL)
def e21(spark: SparkSession, sf: str) -> DataFrame:
    stay = _fit(spark, sf).select("decoder", "stay_probability")
    t = H.traces(obs(spark, sf), stay, ["decoder"], ["stream_id"], "event_id", "poststimulus_forward_only", 864000.0)
    return t.select("event_id", F.round(F.get("posterior", F.lit(0)), 6).alias("posterior0"))


SEQUENCE_SQL = f"{OBS_SQL}, sq AS (SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY time) AS n, [{', '.join(f'ln(greatest(p{i}, 1e-12))' for i in range(5))}] AS e FROM obs)"
ONLINE_SQL = f"""WITH RECURSIVE {SEQUENCE_SQL},
r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([0, 0, 0, 0, 0] AS DOUBLE[]) AS b, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS m, CAST([] AS DOUBLE[]) AS q FROM obs
  UNION ALL SELECT stream_id, n, event_id, [x - list_avg(b3) for x in b3], m2, q FROM (
    SELECT *, [greatest(-0.2, least(0.2, x - list_avg(b1))) for x in b1] AS b3 FROM (
    SELECT *, [b[i] - 0.5 * (g[i] - list_avg(g)) for i in [1, 2, 3, 4, 5]] AS b1 FROM (
    SELECT *, [-2 * q[i] * (ln(q[i]) - h) + 0.3 * (m2[i] - 0.2) for i in [1, 2, 3, 4, 5]] AS g FROM (
    SELECT *, list_sum([x * ln(x) for x in q]) AS h, [0.9 * m[i] + 0.1 * q[i] for i in [1, 2, 3, 4, 5]] AS m2 FROM (
    SELECT *, [x / list_sum(z) for x in z] AS q FROM (
    SELECT sq.stream_id, sq.n, sq.event_id, r.b, r.m, [exp(sq.e[i] / 1.5 + r.b[i]) for i in [1, 2, 3, 4, 5]] AS z FROM r JOIN sq ON sq.stream_id = r.stream_id AND sq.n = r.n + 1))))))),
shown AS (SELECT event_id, q FROM r WHERE n > 0) SELECT event_id, round(q[1], 6) AS q0, round(q[5], 6) AS q4 FROM shown"""


@query("e22_online_adaptation", ONLINE_SQL)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    return entries(H.online_adapted(obs(spark, sf), ["stream_id"], "event_id", EVEN, rate=0.5, entropy_weight=2.0, marginal_weight=0.3, momentum=0.1, temperature=1.5, clip=0.2), "event_id", digits=6)


#: Orders of three presses; class 0 is rest.
TEMPLATES = [(1, 2, 3), (4, 2, 1), (3, 4, 2)]
_NONE = "CAST('-inf' AS DOUBLE)"
PRESSES_SQL = f"""WITH RECURSIVE {SEQUENCE_SQL}, tm(k, o) AS (VALUES {', '.join(f'({k}, {list(o)})' for k, o in enumerate(TEMPLATES))}),
em AS (SELECT stream_id, event_id, n, k, o, [e[CASE WHEN s % 2 = 0 THEN o[s // 2] + 1 ELSE 1 END] for s in [1, 2, 3, 4, 5, 6, 7]] AS e FROM sq, tm),
v AS (SELECT stream_id, k, n, [e[1], e[2] + ln(0.12), {', '.join([_NONE] * 5)}] AS sc, ['0', '1', '', '', '', '', ''] AS path FROM em WHERE n = 1
  UNION ALL SELECT stream_id, k, n, [greatest(st[s], mv[s]) + e[s] for s in [1, 2, 3, 4, 5, 6, 7]], [CASE WHEN mv[s] > st[s] THEN path[s - 1] ELSE path[s] END || CAST(s - 1 AS VARCHAR) for s in [1, 2, 3, 4, 5, 6, 7]] FROM (
    SELECT em.stream_id, em.k, em.n, em.e, v.path, [x + ln(0.88) for x in v.sc] AS st, [CASE WHEN s = 1 THEN {_NONE} ELSE v.sc[s - 1] + ln(0.12) END for s in [1, 2, 3, 4, 5, 6, 7]] AS mv FROM v JOIN em ON em.stream_id = v.stream_id AND em.k = v.k AND em.n = v.n + 1)),
f AS (SELECT stream_id, k, greatest(sc[6], sc[7]) AS total, CASE WHEN sc[7] > sc[6] THEN path[7] ELSE path[6] END AS path FROM v JOIN (SELECT stream_id, max(n) AS n FROM sq GROUP BY 1) USING (stream_id, n)),
b AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY total DESC, k) AS place FROM f),
g AS (SELECT sq.event_id, CASE WHEN total > {_NONE} THEN k ELSE -1 END AS k, CASE WHEN total > {_NONE} THEN CAST(substr(path, CAST(sq.n AS INTEGER), 1) AS INTEGER) ELSE 0 END AS state FROM sq JOIN b USING (stream_id) WHERE place = 1)
SELECT event_id, CAST(g.k AS INTEGER) AS template, state, CAST(CASE WHEN state % 2 = 1 THEN o[(state + 1) // 2] ELSE 0 END AS INTEGER) AS label FROM g LEFT JOIN tm ON tm.k = g.k"""


@query("e25_structured_decode", PRESSES_SQL)
def e25(spark: SparkSession, sf: str) -> DataFrame:
    """Three presses in one of three orders over each stream's days, with rests between them."""
    return H.structured(obs(spark, sf), ["stream_id"], "event_id", TEMPLATES)


