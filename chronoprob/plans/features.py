"""Queries on feature transforms, augmentation and row weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.operators import augment as A
from chronoprob.operators import ensembles as N
from chronoprob.operators import features as T

from .fixtures import FEAT_SQL, N_FEATURES, OBS_SQL, feat, obs, table
from .metrics import rounded
from .registry import query

SRC = "longf WHERE role = 'source'"


def first(df: DataFrame, *places: int, digits: int = 9) -> DataFrame:
    """row_id and some entries of x."""
    return df.select("row_id", *[F.round(F.get("x", F.lit(i)), digits).alias(f"x{i}") for i in places])


def two(expr: str, stats: str, name: str = "s") -> str:
    """SQL: entries 0 and 5 of ``expr`` over v and the statistics by position."""
    return f"WITH {FEAT_SQL}, {name} AS (SELECT pos, {stats} FROM {SRC} GROUP BY pos), z AS (SELECT row_id, longf.pos, {expr} AS z FROM longf JOIN {name} USING (pos)) SELECT row_id, round(max(CASE WHEN pos = 0 THEN z END), 9) AS x0, round(max(CASE WHEN pos = 5 THEN z END), 9) AS x5 FROM z GROUP BY 1"


@query("j1_standardize", two("greatest(-2.0, least(2.0, (v - m) / greatest(s0, 1e-12)))", "avg(v) AS m, stddev_pop(v) AS s0"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.standardized(feat(spark, sf), clip=2.0), 0, 5)


@query("j1_adaptive_standardize", f"WITH {FEAT_SQL}, s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s0 FROM longf WHERE role = 'target' GROUP BY pos), z AS (SELECT row_id, longf.pos, (v - m) / greatest(s0, 1e-12) AS z FROM longf JOIN s USING (pos)) SELECT row_id, round(max(CASE WHEN pos = 0 THEN z END), 9) AS x0 FROM z GROUP BY 1")
def j1_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf)
    return first(T.standardized(f, fit=f.where("role = 'target'")), 0)


@query("j2_center", two("v - m", "quantile_cont(v, 0.5) AS m"))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.centered(feat(spark, sf), "median"), 0, 5)


@query("j3_minmax", two("(v - lo) / (hi - lo) * 2 - 1", "min(v) AS lo, max(v) AS hi"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.minmax(feat(spark, sf), -1.0, 1.0), 0, 5)


@query("j4_robust_scale", two("(v - m) / greatest(q, 1e-12)", "quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS q"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.standardized(feat(spark, sf), "median", "iqr"), 0, 5)


@query("j4_mad_scale", f"WITH {FEAT_SQL}, m AS (SELECT pos, quantile_cont(v, 0.5) AS m FROM {SRC} GROUP BY pos), d AS (SELECT pos, m, greatest(1.4826 * quantile_cont(abs(v - m), 0.5), 1e-12) AS mad FROM longf JOIN m USING (pos) WHERE role = 'source' GROUP BY pos, m) SELECT row_id, round((v - m) / mad, 9) AS x0 FROM longf JOIN d USING (pos) WHERE pos = 0")
def j4_mad(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.standardized(feat(spark, sf), "median", "mad"), 0)


@query("j5_clip", two("greatest(lo, least(hi, v))", "quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.clipped(feat(spark, sf)), 0, 5)


@query("j5_sample_clip", two("greatest(lo, least(hi, v))", "list_sort(list(v))[CAST(floor(0.05 * (count(*) - 1)) AS BIGINT) + 1] AS lo, list_sort(list(v))[CAST(ceil(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS hi"))
def j5_samples(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.clipped(feat(spark, sf), interpolate=False), 0, 5)


@query("j6_asinh_squash", two("asinh(v / greatest(s0, 1e-12)) + v / greatest(s0, 1e-12) / (1 + abs(v / greatest(s0, 1e-12)))", "stddev_pop(v) AS s0"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    a = T.squashed(feat(spark, sf)).select("row_id", F.col("x").alias("a"))
    both = T.squashed(feat(spark, sf), "squash").join(a, "row_id")
    return first(both.withColumn("x", F.zip_with("x", "a", lambda x, y: x + y)), 0, 5)


@query("j7_ecdf", f"WITH {FEAT_SQL}, n AS (SELECT pos, count(*) AS n FROM {SRC} GROUP BY pos) SELECT q.row_id, CAST(q.pos AS INTEGER) AS pos, round(least(1.0, ((SELECT count(*) FROM longf s WHERE s.role = 'source' AND s.pos = q.pos AND s.v <= q.v) + 0.5) / (n.n + 1)), 9) AS value FROM longf q JOIN n USING (pos) WHERE q.pos < 2")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf).withColumn("x", F.slice("x", 1, 2))
    return rounded(T.ecdf(f).withColumn("pos", F.col("pos").cast("int")))


@query("j7_mid_rank", f"WITH {FEAT_SQL} SELECT q.row_id, 0 AS pos, round(((SELECT count(*) FROM feat s WHERE s.role = 'source' AND s.x0 < q.x0) + (SELECT count(*) FROM feat s WHERE s.role = 'source' AND s.x0 <= q.x0)) / (2.0 * (SELECT count(*) FROM feat WHERE role = 'source')), 9) AS value FROM feat q")
def j7_mid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.ecdf(feat(spark, sf).withColumn("x", F.slice("x", 1, 1)), "mid"))


@query("j7_quantile_bins", f"WITH {FEAT_SQL}, e AS (SELECT quantile_cont(x3, 0.25) AS a, quantile_cont(x3, 0.5) AS b, quantile_cont(x3, 0.75) AS c FROM feat WHERE role = 'source') SELECT row_id, CASE WHEN x3 >= a THEN 1 ELSE 0 END + CASE WHEN x3 >= b THEN 1 ELSE 0 END + CASE WHEN x3 >= c THEN 1 ELSE 0 END AS bin FROM feat, e")
def j7_bins(spark: SparkSession, sf: str) -> DataFrame:
    return T.quantile_bins(feat(spark, sf), 4).select("row_id", F.get("bins", F.lit(3)).alias("bin"))


@query("j8_binarize", two("CASE WHEN v >= m THEN 1.0 ELSE -1.0 END", "quantile_cont(v, 0.5) AS m"))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.binarized(feat(spark, sf), signed=True), 0, 5)


@query("j9_anova", f"WITH {FEAT_SQL}, o AS (SELECT pos, label, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM {SRC} GROUP BY 1, 2) SELECT CAST(pos AS INTEGER) AS pos, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 6) AS f FROM o GROUP BY pos")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.anova(T.source(feat(spark, sf))), 6)


GREEDY = f"""WITH RECURSIVE {FEAT_SQL}, c AS (SELECT a.pos AS i, b.pos AS j, abs(corr(a.v, b.v)) AS r FROM longf a JOIN longf b USING (row_id) WHERE a.role = 'source' GROUP BY 1, 2),
l AS (SELECT i, list(r ORDER BY j) AS r FROM c GROUP BY 1),
k AS (SELECT CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT l.i, CASE WHEN len([j for j in kept if l.r[j + 1] > 0.1]) = 0 THEN list_append(kept, CAST(l.i AS BIGINT)) ELSE kept END FROM k JOIN l ON l.i = k.i + 1)
SELECT row_id, [CAST(embedding[j + 1] AS DOUBLE) for j in kept] AS x, feat.label, domain, role FROM feat JOIN embeddings ON vec_id = row_id, (SELECT kept FROM k ORDER BY i DESC LIMIT 1)"""


@query("j9_correlation_filter", GREEDY)
def j9_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the columns that a correlation limit keeps; greedy, tested by brute force."""
    f = feat(spark, sf)
    return T.selected(f, T.correlation_filtered(f, 0.1))


@query("j10_moments", f"WITH {FEAT_SQL} SELECT domain, count(*) AS n, round(sum(x0), 6) AS s0, round(sum(x0 * x3), 6) AS xx03, round(sum(x7 * x7), 6) AS xx77 FROM feat GROUP BY 1")
def j10_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = T.moments(feat(spark, sf), ["domain"])
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return m.select("domain", "n", at("s", 0).alias("s0"), at("xx", 3).alias("xx03"), at("xx", 7 * N_FEATURES + 7).alias("xx77"))


@query("j10_pca")
def j10_pca(spark: SparkSession, sf: str) -> DataFrame:
    return T.pca(feat(spark, sf), 3)[0]


@query("j10_zca")
def j10_zca(spark: SparkSession, sf: str) -> DataFrame:
    return T.zca(feat(spark, sf))


@query("j11_random_features")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    return T.random_features(feat(spark, sf), N_FEATURES, 16, gamma=1.0, seed=3)


KEEP = f"{math.ceil(2**32 / math.sqrt(N_FEATURES)):08x}"  # hex digits of the density's share of 32 bits


@query("j11_sparse_projection", f"""WITH {FEAT_SQL}, w AS (SELECT i AS pos, j, CASE WHEN left(md5('sign:3:' || i || ':' || j), 8) < '80000000' THEN 1 ELSE -1 END / sqrt(16 / sqrt({N_FEATURES})) AS w
FROM range({N_FEATURES}) a(i), range(16) b(j) WHERE left(md5('keep:3:' || i || ':' || j), 8) < '{KEEP}'),
y AS (SELECT row_id, o.j, coalesce(sum(v * w), 0) AS v FROM longf CROSS JOIN range(16) o(j) LEFT JOIN w ON w.pos = longf.pos AND w.j = o.j GROUP BY 1, 2)
SELECT row_id, CAST(j AS INTEGER) AS pos, round(v, 9) + 0.0 AS v FROM y""")
def j11_sparse(spark: SparkSession, sf: str) -> DataFrame:
    y = T.sparse_projected(feat(spark, sf), N_FEATURES, 16, seed=3).select("row_id", F.posexplode("x").alias("pos", "v"))
    return y.withColumn("v", F.round("v", 9) + F.lit(0.0))


MEANS = f"{FEAT_SQL}, cm AS (SELECT label, {', '.join(f'avg(x{i}) AS m{i}' for i in range(N_FEATURES))} FROM feat WHERE role = 'source' GROUP BY 1)"
D2 = " + ".join(f"(x{i} - m{i}) * (x{i} - m{i})" for i in range(N_FEATURES))


@query("j12_prototype_distances", f"WITH {MEANS} SELECT row_id, cm.label AS prototype, round({D2}, 9) AS distance FROM feat, cm")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.prototype_distances(feat(spark, sf)).select("row_id", "prototype", "distance"))


def _series(spark: SparkSession, sf: str, n: int = 4) -> DataFrame:
    """Trials of orders: for each part of a line one channel of samples."""
    o = table(spark, sf, "lineitem")
    rows = o.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"))).alias("r"))
    rows = rows.where(F.size("r") >= n)
    channels = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), _values(c).alias("samples")) for i, c in enumerate(("l_quantity", "l_discount"))]))
    return rows.select(F.col("l_orderkey").alias("trial_id"), channels.alias("c")).select("trial_id", "c.*")


def _values(c: str):
    return F.transform("r", lambda x: x[c].cast("double"))


@query("j13_covariance_features")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    return T.trial_covariances(_series(spark, sf), ["trial_id"])


@query("j14_tangent_features")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    logs = T.trial_covariances(_series(spark, sf), ["trial_id"]).withColumn("domain", (F.col("trial_id") % 4).cast("int"))
    return T.recentred(logs)


@query("j15_band_power")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    return T.band_power(_series(spark, sf), ["trial_id", "channel"], 10.0, (1.0, 4.0))


@query("j16_baseline_correction", f"WITH {OBS_SQL} SELECT event_id, round(value - coalesce(avg(CASE WHEN time BETWEEN 0 AND 864000 THEN value END) OVER (PARTITION BY stream_id), 0), 6) AS value FROM obs")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.baseline_corrected(obs(spark, sf), ["stream_id"], (0.0, 864000.0)).select("event_id", "value"), 6)


@query("j17_cue_summary", f"WITH {FEAT_SQL} SELECT domain, round(avg(x0), 9) AS mean0, round(covar_samp(x0, x1), 9) AS cov01 FROM feat GROUP BY 1")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf).select("domain", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))
    return rounded(f.groupBy("domain").agg(F.avg("a").alias("mean0"), F.covar_samp("a", "b").alias("cov01")))


@query("j18_pseudo_trials", f"WITH {FEAT_SQL}, r AS (SELECT domain, label, x0, row_number() OVER (PARTITION BY domain, label ORDER BY left(md5('4:' || row_id), 8), row_id) - 1 AS i, count(*) OVER (PARTITION BY domain, label) AS n FROM feat), c AS (SELECT *, least(3, n) AS k, n // least(3, n) AS size, n % least(3, n) AS long FROM r), d AS (SELECT *, CASE WHEN i < long * (size + 1) THEN i // (size + 1) ELSE long + (i - long * (size + 1)) // greatest(size, 1) END AS chunk FROM c) SELECT domain, label, CAST(chunk AS INTEGER) AS chunk, count(*) AS n_rows, round(avg(x0), 9) AS x0 FROM d GROUP BY 1, 2, 3")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    p = T.pseudo_trials(feat(spark, sf), ["domain", "label"], 3, "row_id", 4)
    return p.select("domain", "label", "chunk", "n_rows", F.round(F.get("x", F.lit(0)), 9).alias("x0"))


@query("j19_fold_standardize", f"WITH {FEAT_SQL}, s AS (SELECT a.domain AS fold, avg(b.x0) AS m, stddev_pop(b.x0) AS s FROM (SELECT DISTINCT domain FROM feat) a JOIN feat b ON b.domain <> a.domain GROUP BY 1) SELECT row_id, fold, round((x0 - m) / s, 6) AS x0 FROM feat JOIN s ON s.fold = feat.domain")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    return T.fold_standardized(feat(spark, sf).withColumn("fold", F.col("domain"))).select("row_id", "fold", F.round(F.get("x", F.lit(0)), 6).alias("x0"))


@query("j20_leave_one_out_moments", f"WITH {FEAT_SQL}, o AS (SELECT domain, count(*) AS n, sum(x0) AS s FROM feat GROUP BY 1) SELECT domain, CAST(sum(n) OVER () - n AS BIGINT) AS n_rest, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 9) AS mean_rest FROM o")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    m = T.moments(feat(spark, sf), ["domain"]).select("domain", "n", F.get("s", F.lit(0)).alias("s"))
    w = Window.partitionBy()
    n, s = F.sum("n").over(w) - F.col("n"), F.sum("s").over(w) - F.col("s")
    return rounded(m.select("domain", n.alias("n_rest"), (s / n).alias("mean_rest")))


COS = [f"x{t} * {(2 / N_FEATURES) ** 0.5!r} * cos(pi() * ({t} + 0.5) / {N_FEATURES})" for t in range(N_FEATURES)]


@query("j21_dct", f"WITH {FEAT_SQL} SELECT row_id, round(({' + '.join(f'x{t}' for t in range(N_FEATURES))}) / sqrt({N_FEATURES}), 9) AS x0, round({' + '.join(COS)}, 9) AS x1 FROM feat")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    return first(T.dct(feat(spark, sf), N_FEATURES, 3), 0, 1)


@query("k1_mixup", f"WITH {FEAT_SQL}, n AS (SELECT row_id, label, x0, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS c FROM feat WHERE role = 'source'), w AS (SELECT *, floor(CAST('0x' || left(md5('1:' || row_id || ':1'), 8) AS BIGINT) / 4294967296.0 * c) AS j, CAST('0x' || left(md5('1-lam:' || row_id || ':1'), 8) AS BIGINT) / 4294967296.0 AS lam FROM n) SELECT w.row_id, w.label, round(lam * w.x0 + (1 - lam) * p.x0, 9) AS x0 FROM w JOIN n p ON p.label = w.label AND p.i = w.j")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return A.mixed_up(T.source(feat(spark, sf)), seed=1).select("row_id", "label", F.round(F.get("x", F.lit(0)), 9).alias("x0"))


@query("k2_perturb", f"WITH {FEAT_SQL}, u AS (SELECT row_id, x2, CAST('0x' || left(md5('2-jitter:' || row_id || ':1:2'), 8) AS BIGINT) / 4294967296.0 AS a, CAST('0x' || left(md5('2-mask:' || row_id || ':1:2'), 8) AS BIGINT) / 4294967296.0 AS b, CAST('0x' || left(md5('2-scale:' || row_id || ':1:0'), 8) AS BIGINT) / 4294967296.0 AS c FROM feat) SELECT row_id, round(x2 + (a * 2 - 1) * 0.1, 9) AS jitter, round(CASE WHEN b < 0.3 THEN 0.0 ELSE x2 END, 9) AS mask, round(x2 * (1 + (c * 2 - 1) * 0.1), 9) AS scale FROM u")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf)
    one = lambda kind, amount: A.perturbed(f, kind, amount, seed=2).select("row_id", F.round(F.get("x", F.lit(2)), 9).alias(kind))
    return one("jitter", 0.1).join(one("mask", 0.3), "row_id").join(one("scale", 0.1), "row_id")


@query("k3_mixstyle", f"WITH {FEAT_SQL}, s AS (SELECT domain, avg(x0) AS m, greatest(stddev_pop(x0), 1e-12) AS s FROM feat GROUP BY 1) SELECT row_id, round((x0 - a.m) / a.s * (0.7 * a.s + 0.3 * b.s) + 0.7 * a.m + 0.3 * b.m, 9) AS x0 FROM feat JOIN s a ON a.domain = feat.domain JOIN s b ON b.domain = (feat.domain + 1) % 4")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return first(A.mixstyle(feat(spark, sf), 0.7), 0)


@query("k4_gaussian_rows")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return A.gaussian_rows(T.source(feat(spark, sf)).select("label", "x"), 50)


@query("k5_rebalance", f"WITH {FEAT_SQL}, c AS (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM feat GROUP BY label)) SELECT label, lo AS n_cut, hi AS n_filled FROM (SELECT DISTINCT label FROM feat), c")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf)
    n = lambda t, name: A.rebalanced(f, "label", "row_id", t).groupBy("label").agg(F.count("*").alias(name))
    return n("min", "n_cut").join(n("max", "n_filled"), "label")


@query("k6_bagging", f"WITH {FEAT_SQL}, u AS (SELECT bag, row_id, CAST('0x' || left(md5('0:' || bag || ':' || row_id), 8) AS BIGINT) / 4294967296.0 AS u FROM feat, unnest(range(1, 6)) b(bag)), w AS (SELECT bag, CASE {' '.join(f'WHEN u < {c!r} THEN {k}' for k, c in enumerate((0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)))} ELSE 8 END AS w FROM u) SELECT CAST(bag AS INTEGER) AS bag, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS total FROM w WHERE w > 0 GROUP BY 1")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return A.bags(feat(spark, sf), 5, "row_id").groupBy("bag").agg(F.count("*").alias("n_rows"), F.sum("weight").alias("total"))


def _subspace_sql(members: int, fraction: float) -> str:
    size = int(round(N_FEATURES * fraction))
    return f"""WITH {FEAT_SQL}, h AS (SELECT m, c, row_number() OVER (PARTITION BY m ORDER BY left(md5('0:' || m || ':' || c), 8), c) AS r FROM unnest(range({members})) a(m), unnest(range({N_FEATURES})) b(c)),
cm AS (SELECT label, pos, avg(v) AS m FROM longf WHERE role = 'source' GROUP BY 1, 2), sd AS (SELECT pos, greatest(stddev_samp(v), 1e-12) AS s FROM longf WHERE role = 'source' GROUP BY 1),
d AS (SELECT h.m, f.row_id, f.label AS own, cm.label, -sum(power((f.v - cm.m) / s, 2)) AS z FROM longf f JOIN cm USING (pos) JOIN sd USING (pos) JOIN h ON h.c = f.pos AND r <= {size} WHERE f.role = 'target' GROUP BY 1, 2, 3, 4),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY m, row_id)) AS e FROM d), p AS (SELECT *, e / sum(e) OVER (PARTITION BY m, row_id) AS p FROM e),
a AS (SELECT row_id, own, label, avg(p) AS p FROM p GROUP BY 1, 2, 3) SELECT row_id, own AS label, CAST(arg_max(label, p) AS INTEGER) AS predicted, round(max(p), 6) AS confidence FROM a GROUP BY 1, 2"""


@query("k6_random_subspaces", _subspace_sql(7, 0.5))
def k6_subspaces(spark: SparkSession, sf: str) -> DataFrame:
    """Centroid members on columns of their own, averaged."""
    f = feat(spark, sf)
    out = N.random_subspaces(f.where("role = 'source'"), f.where("role = 'target'"), 7)
    return out.select("row_id", "label", "predicted", F.round(F.array_max("p"), 6).alias("confidence"))


SCALED = " + ".join(f"power((f.x{i} - m{i}) / greatest(s{i}, 1e-12), 2)" for i in range(N_FEATURES))
DIST = f"{FEAT_SQL}, sc AS (SELECT {', '.join(f'stddev_pop(x{i}) AS s{i}' for i in range(N_FEATURES))} FROM feat), cm AS (SELECT label, {', '.join(f'avg(x{i}) AS m{i}' for i in range(N_FEATURES))} FROM feat GROUP BY 1), di AS (SELECT f.row_id, f.label, sqrt({SCALED}) AS d FROM feat f JOIN cm USING (label), sc)"


@query("k7_outlier_weights", f"WITH {DIST}, m AS (SELECT label, quantile_cont(d, 0.5) AS m FROM di GROUP BY 1), a AS (SELECT label, m, 1.4826 * quantile_cont(abs(d - m), 0.5) AS mad FROM di JOIN m USING (label) GROUP BY 1, 2) SELECT row_id, round(d, 6) AS distance, CASE WHEN d <= m + 1.5 * mad THEN 1.0 ELSE 0.0 END AS weight FROM di JOIN a USING (label)")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.outlier_weights(feat(spark, sf), multiplier=1.5).select("row_id", "distance", "weight"), 6)


@query("k8_distance_weights", f"WITH {DIST}, w AS (SELECT row_id, greatest(exp(-d * d / {N_FEATURES}), 1e-3) AS w FROM di) SELECT row_id, round(w / avg(w) OVER (), 6) AS weight FROM w")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.distance_weights(feat(spark, sf), ["label"]).select("row_id", "weight"), 6)


@query("k9_confidence_weights", f"WITH {OBS_SQL} SELECT event_id, round(ptrue / avg(ptrue) OVER (), 9) AS weight FROM obs")
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.confidence_weights(obs(spark, sf), "correct_confidence").select("event_id", "weight"))


@query("k10_domain_importance")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.domain_importance(feat(spark, sf)).select("row_id", "weight"), 6)


KERNEL = f"""WITH {FEAT_SQL}, e AS (SELECT row_id, CASE WHEN role = 'target' THEN -1 ELSE domain END AS d, pos, v FROM longf), n AS (SELECT d, count(*) / {N_FEATURES} AS n FROM e GROUP BY 1),
k AS (SELECT a.d AS da, b.d AS db, exp(-0.5 * sum(power(a.v - b.v, 2))) AS k FROM e a JOIN e b USING (pos) GROUP BY a.row_id, b.row_id, 1, 2),
m AS (SELECT da, db, sum(k) AS s FROM k GROUP BY 1, 2), q AS (SELECT da, db, s / x.n / y.n AS m FROM m JOIN n x ON x.d = da JOIN n y ON y.d = db),
z AS (SELECT s.da AS domain, greatest(0, s.m + t.m - 2 * c.m) AS mmd2 FROM q s JOIN q c ON c.da = s.da AND c.db = -1 JOIN q t ON t.da = -1 AND t.db = -1 WHERE s.da >= 0 AND s.db = s.da),
w AS (SELECT *, exp((-mmd2 + min(mmd2) OVER ()) / 0.01) AS e FROM z) SELECT CAST(domain AS INTEGER) AS domain, round(mmd2, 9) AS mmd2, round(-mmd2, 9) AS score, round(e / sum(e) OVER () * count(*) OVER (), 6) AS weight FROM w"""


@query("k11_mmd_weights", KERNEL)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    s = A.kernel_mmd(feat(spark, sf), 0.5)
    return rounded(A.softmax_weights(s.withColumn("score", -F.col("mmd2")), "score", 0.01), 9, weight=6)


@query("k11_mmd_estimates")
def k11_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """From random features, without pairs of rows; tested against the exact means."""
    f = feat(spark, sf)
    return rounded(A.mmd_estimates(f, N_FEATURES, A.median_gamma(f)), 6)


@query("k12_similarity_weights", f"WITH {FEAT_SQL}, m AS (SELECT domain, {', '.join(f'avg(x{i}) AS m{i}' for i in range(N_FEATURES))} FROM feat GROUP BY 1), s AS (SELECT a.domain, -sqrt({' + '.join(f'power(a.m{i} - t.m{i}, 2)' for i in range(N_FEATURES))}) AS score FROM m a, m t WHERE t.domain = 0 AND a.domain <> 0), k AS (SELECT * FROM s ORDER BY score DESC, domain LIMIT 2) SELECT domain, round(score, 9) AS score, round(0.5 * exp(score / 0.1) / sum(exp(score / 0.1)) OVER () * 2 + 0.5, 6) AS weight FROM k")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    s = A.domain_similarity(feat(spark, sf))
    return rounded(A.softmax_weights(s, "score", 0.1, 2, 0.5), 9, weight=6)


@query("k12_covariance_distance", f"WITH {FEAT_SQL}, c AS (SELECT a.domain, a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS c FROM longf a JOIN longf b USING (row_id) GROUP BY 1, 2, 3) SELECT s.domain, round(sqrt(sum(power(s.c - t.c, 2))), 6) AS distance FROM c s JOIN c t ON t.domain = 0 AND s.i = t.i AND s.j = t.j WHERE s.domain <> 0 GROUP BY 1")
def k12_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.covariance_distance(feat(spark, sf)), 6)


TRANSFER = f"""WITH {FEAT_SQL}, c AS (SELECT domain, label, pos, avg(v) AS m, count(*) AS n FROM longf WHERE role = 'source' GROUP BY 1, 2, 3),
o AS (SELECT domain, pos, avg(v) AS m, count(*) AS n FROM longf WHERE role = 'source' GROUP BY 1, 2), t AS (SELECT pos, avg(v) AS m, count(*) AS n FROM longf WHERE role = 'target' GROUP BY 1),
d AS (SELECT domain, label, pos, c.m - o.m AS x, c.n FROM c JOIN o USING (domain, pos)),
b AS (SELECT a.domain, a.pos AS i, b.pos AS j, abs(sum(a.n * a.x * b.x)) AS s FROM d a JOIN d b ON a.domain = b.domain AND a.label = b.label GROUP BY 1, 2, 3),
num AS (SELECT domain, max(s) AS num FROM (SELECT domain, j, sum(s) AS s FROM b GROUP BY 1, 2) GROUP BY 1),
den AS (SELECT domain, max(o.n * t.n / CAST(o.n + t.n AS DOUBLE)) * max(abs(o.m - t.m)) * sum(abs(o.m - t.m)) AS den FROM o JOIN t USING (pos) GROUP BY 1)
SELECT domain, round(num / (den + 1e-12), 6) AS score FROM num JOIN den USING (domain)"""


@query("k13_transferability", TRANSFER)
def k13(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.transferability(feat(spark, sf)), 6)

