"""Queries on decoders and transfer between domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.operators import decode as C
from chronoprob.operators import features as T
from chronoprob.operators import gradients as G
from chronoprob.operators import matching as M
from chronoprob.operators import source_free as S

from .fixtures import FEAT_SQL, N_FEATURES, OBS_SQL, feat, obs, table
from .metrics import NLL, rounded
from .registry import query

D8 = range(N_FEATURES)


def long_feat(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows whose windows are taken."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 4).cast("int").alias("domain"))


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = feat(spark, sf)
    return f.where("role = 'source'"), f.where("role = 'target'")


def d2(a: str, m: str, scale: str = "") -> str:
    return " + ".join(f"power(({a}.x{i} - {m}.m{i}){f' / {scale}.s{i}' if scale else ''}, 2)" for i in D8)


MEANS = f"cm AS (SELECT label, count(*) AS n, {', '.join(f'avg(x{i}) AS m{i}' for i in D8)} FROM feat WHERE role = 'source' GROUP BY 1), sd AS (SELECT {', '.join(f'greatest(stddev_samp(x{i}), 1e-12) AS s{i}' for i in D8)} FROM feat WHERE role = 'source')"


@query("m1_centroid", f"WITH {FEAT_SQL}, {MEANS}, s AS (SELECT t.row_id, cm.label, -({d2('t', 'cm', 'sd')}) AS sc FROM feat t, cm, sd WHERE t.role = 'target'), e AS (SELECT row_id, label, exp(sc - max(sc) OVER (PARTITION BY row_id)) AS e FROM s), p AS (SELECT row_id, label, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e) SELECT row_id, CAST(arg_max(label, p) AS INTEGER) AS predicted, round(max(p), 6) AS confidence FROM p GROUP BY 1")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    return C.centroid(s, t).select("row_id", "predicted", F.round(F.array_max("p"), 6).alias("confidence"))


def _gaussian_sql(var: str, over: str) -> str:
    """Variances of the classes' columns as ``var`` over a window of them."""
    return f"""WITH {FEAT_SQL}, o AS (SELECT label, pos, avg(v) AS m, greatest(coalesce(var_samp(v), 0), 1e-6) AS v, count(*) AS n FROM longf WHERE role = 'source' GROUP BY 1, 2),
g AS (SELECT label, pos, m, greatest({var.format(over)}, 1e-6) AS v, n / CAST(sum(n) OVER (PARTITION BY pos) AS DOUBLE) AS share FROM o),
s AS (SELECT row_id, g.label, ln(max(share)) - sum(power(f.v - m, 2) / g.v + ln(g.v)) / 2 AS sc FROM longf f JOIN g USING (pos) WHERE f.role = 'target' GROUP BY 1, 2) SELECT row_id, CAST(arg_max(label, sc) AS INTEGER) AS predicted FROM s GROUP BY 1"""


@query("m2_gaussian", _gaussian_sql("sum(v * n) OVER ({0}) / sum(n) OVER ({0})", "PARTITION BY pos"))
def m2(spark: SparkSession, sf: str) -> DataFrame:
    return C.gaussian(*halves(spark, sf), "tied_diagonal").select("row_id", "predicted")


@query("m2_gaussian_classes", _gaussian_sql("v", ""))
def m2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return C.gaussian(*halves(spark, sf)).select("row_id", "predicted")


@query("m2_gaussian_spherical", _gaussian_sql("avg(v) OVER ({0})", "PARTITION BY label"))
def m2_spherical(spark: SparkSession, sf: str) -> DataFrame:
    return C.gaussian(*halves(spark, sf), "spherical").select("row_id", "predicted")


@query("m2_mahalanobis")
def m2_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    return C.mahalanobis(*halves(spark, sf)).select("row_id", "label", "predicted")


@query("m3_nearest_neighbours", f"WITH {FEAT_SQL}, d AS (SELECT t.row_id, s.row_id AS train_id, s.label, sqrt({' + '.join(f'power(t.x{i} - s.x{i}, 2)' for i in D8)}) AS distance FROM feat t, feat s WHERE t.role = 'target' AND s.role = 'source'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY distance, train_id) AS INTEGER) AS place FROM d) SELECT row_id, train_id, CAST(label AS INTEGER) AS label, round(distance, 6) AS distance, place FROM r WHERE place <= 5")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    return rounded(C.nearest_neighbours(s, t, 5).select("row_id", "train_id", "label", "distance", "place"), 6)


@query("m3_knn", f"WITH {FEAT_SQL}, d AS (SELECT t.row_id, s.row_id AS train_id, s.label, sqrt({' + '.join(f'power(t.x{i} - s.x{i}, 2)' for i in D8)}) AS distance FROM feat t, feat s WHERE t.role = 'target' AND s.role = 'source'), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, train_id) AS place FROM d), v AS (SELECT row_id, label, sum(1 / greatest(distance, 1e-12)) AS v FROM r WHERE place <= 7 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, label) AS n, sum(v) OVER (PARTITION BY row_id) AS s FROM v) SELECT row_id, CAST(label AS INTEGER) AS predicted, round(v / s, 6) AS share FROM b WHERE n = 1")
def m3_knn(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    return rounded(C.knn(s, t, 7, weighted=True), 6)


def _accuracy(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("decoder"), F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("m4_registered_decoders")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    out = None
    for name in ("logistic", "Random-Forest", "gnb"):
        one = _accuracy(C.fit_named(name, s, t), C.normalized_name(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("m4_tuned_logistic")
def m4_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """The inverse ridge is chosen on folds of the source by domain."""
    s, t = halves(spark, sf)
    return G.tuned_logistic(s, t, "domain", (0.01, 0.1, 1.0), rounds=40, tolerance=1e-4)[0].select("row_id", "label", "predicted")


FOLD_MODELS = f"""WITH {FEAT_SQL}, s AS (SELECT domain, label, pos, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM longf GROUP BY 1, 2, 3),
r AS (SELECT d.domain, label, pos, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM (SELECT DISTINCT domain FROM feat) d JOIN s ON s.domain <> d.domain GROUP BY 1, 2, 3),
sc AS (SELECT domain, pos, greatest(sqrt(greatest(0, (sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1))), 1e-12) AS sd FROM r GROUP BY 1, 2),
d AS (SELECT f.row_id, f.domain, f.label AS own, r.label, f.pos // 8 AS w, sum(power((f.v - r.s / r.n) / sd, 2)) AS d FROM longf f JOIN r ON r.domain = f.domain AND r.pos = f.pos JOIN sc ON sc.domain = f.domain AND sc.pos = f.pos GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT row_id, domain, own, w, arg_min(label, d) AS p FROM d GROUP BY 1, 2, 3, 4)
SELECT CAST(w AS INTEGER) AS "window", domain, round(avg(CASE WHEN p = own THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM p GROUP BY 1, 2"""


@query("m5_time_resolved", FOLD_MODELS)
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.time_resolved(long_feat(spark, sf), 8), 6)


LOO = f"""cs AS (SELECT domain, label, count(*) AS n, {', '.join(f'sum(x{i}) AS s{i}' for i in D8)} FROM feat GROUP BY 1, 2),
lm AS (SELECT d.domain, c.label, {', '.join(f'sum(s{i}) / sum(n) AS m{i}' for i in D8)} FROM (SELECT DISTINCT domain FROM feat) d JOIN cs c ON c.domain <> d.domain GROUP BY 1, 2),
ls AS (SELECT f.row_id, f.domain, f.label AS own, lm.label, {d2('f', 'lm')} AS d FROM feat f JOIN lm USING (domain))"""


@query("m6_leave_one_domain_out", f"WITH {FEAT_SQL}, {LOO} SELECT row_id, domain, own AS label, CAST(arg_min(label, d) AS INTEGER) AS predicted FROM ls GROUP BY 1, 2, 3")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    return C.leave_one_domain_out(feat(spark, sf)).select("row_id", "domain", "label", "predicted")


@query("m6_nested_selection")
def m6_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Each domain under the other domains' decoder, whose inverse ridge inner left-out domains choose."""
    rows, inner = G.nested_leave_one_out(feat(spark, sf), "domain", (0.01, 0.1, 1.0), rounds=40, tolerance=1e-4)
    chosen = inner.where("chosen").groupBy("domain").agg(F.first("c").alias("c"), F.round(F.avg("score"), 4).alias("inner_score"))
    return rows.select("row_id", "domain", "label", "predicted").join(chosen, "domain")


@query("m7_temporal_generalization", f"WITH {FEAT_SQL}, t AS (SELECT pos // 8 AS tw, pos % 8 AS i, label, avg(v) AS m FROM longf WHERE domain <> 0 GROUP BY 1, 2, 3), d AS (SELECT tw, f.pos // 8 AS w, row_id, f.label AS own, t.label, sum(power(f.v - m, 2)) AS d FROM longf f JOIN t ON f.pos % 8 = t.i WHERE f.domain = 0 GROUP BY 1, 2, 3, 4, 5), p AS (SELECT tw, w, row_id, own, arg_min(label, d) AS p FROM d GROUP BY 1, 2, 3, 4) SELECT CAST(tw AS INTEGER) AS train_window, CAST(w AS INTEGER) AS test_window, round(avg(CASE WHEN p = own THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1, 2")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    f = long_feat(spark, sf)
    return rounded(C.temporal_generalization(f.where("domain <> 0"), f.where("domain = 0"), 8), 6)


@query("m8_projection_classifier")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    """Principal axes of the source, then a logistic classifier."""
    z, _ = T.pca(feat(spark, sf), 4)
    return C.fit_named("logistic", z.where("role = 'source'"), z.where("role = 'target'"))


@query("m9_decision_windows", f"WITH {OBS_SQL}, m AS (SELECT stream_id, {', '.join(f'avg(p{i}) AS q{i}' for i in range(5))} FROM obs GROUP BY 1) SELECT stream_id, round(q0, 9) AS q0, round(q4, 9) AS q4, CASE {' '.join(f'WHEN q{i} = greatest(q0, q1, q2, q3, q4) THEN {i}' for i in range(5))} END AS decision FROM m")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    d = C.decision_windows(obs(spark, sf), ["stream_id"])
    return d.select("stream_id", *[F.round(F.get("p", F.lit(i)), 9).alias(f"q{i}") for i in (0, 4)], P.predicted_index(F.col("p")).alias("decision"))


PERMUTED = f"""WITH {FEAT_SQL}, b AS (SELECT row_id, label, row_number() OVER (ORDER BY left(md5('0:' || row_id), 8), row_id) AS i FROM feat WHERE role = 'source'),
pl AS (SELECT perm, label, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm > 0 THEN left(md5('0:' || perm || ':' || row_id), 8) ELSE left(md5('0:' || row_id), 8) END, row_id) AS i FROM b, unnest(range(21)) u(perm)),
cm AS (SELECT perm, pl.label, pos, avg(v) AS m FROM pl JOIN b USING (i) JOIN longf ON longf.row_id = b.row_id GROUP BY 1, 2, 3), sd AS (SELECT pos, greatest(stddev_samp(v), 1e-12) AS s FROM longf WHERE role = 'source' GROUP BY 1),
d AS (SELECT perm, row_id, f.label AS own, cm.label, sum(power((f.v - m) / s, 2)) AS d FROM longf f JOIN cm USING (pos) JOIN sd USING (pos) WHERE f.role = 'target' GROUP BY 1, 2, 3, 4),
p AS (SELECT perm, row_id, own, arg_min(label, d) AS p FROM d GROUP BY 1, 2, 3), a AS (SELECT perm, avg(CASE WHEN p = own THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY 1)
SELECT round(o.accuracy, 6) AS accuracy, round((1 + count(*) FILTER (WHERE a.accuracy >= o.accuracy)) / (count(*) + 1.0), 6) AS p_value FROM a, a o WHERE o.perm = 0 AND a.perm > 0 GROUP BY o.accuracy"""


@query("m10_permutation", PERMUTED)
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.permutation_p(C.permutation_curve(*halves(spark, sf), 20)), 6)


@query("m11_conditions", f"WITH {OBS_SQL} SELECT condition, n_rows, round(accuracy, 9) AS accuracy, round(accuracy - max(CASE WHEN condition = 'all' THEN accuracy END) OVER (), 9) AS vs_control FROM (SELECT condition, count(*) AS n_rows, avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM obs, (VALUES ('all'), ('confident'), ('late')) c(condition) WHERE condition = 'all' OR (condition = 'confident' AND conf >= 0.3) OR (condition = 'late' AND time >= 864000) GROUP BY 1)")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.functions.udfs import run_conditions
    from chronoprob.operators.metrics import scored

    rows = scored(obs(spark, sf))
    conditions = {"all": F.lit(True), "confident": F.col("conf") >= 0.3, "late": F.col("time") >= 864000}
    return rounded(run_conditions(rows, conditions, {"n_rows": F.count("*"), "accuracy": F.avg("hit")}, "all", "accuracy"))


@query("m12_coral")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return C.coral(feat(spark, sf)).select("row_id", "role", "x")


@query("m12_conditional_coral")
def m12_conditional(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo labels of the target are those of the source's centroids."""
    f = feat(spark, sf)
    guess = C.centroid(f.where("role = 'source'"), f.where("role = 'target'"))
    return M.conditional_coral(f, guess, threshold=0.12)[0].select("row_id", "role", "x")


@query("m13_subspace_alignment")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return C.subspace_aligned(feat(spark, sf), 3).select("row_id", "role", "x")


@query("m13_geodesic_features")
def m13_geodesic(spark: SparkSession, sf: str) -> DataFrame:
    return C.geodesic_features(feat(spark, sf), 2, 3).select("row_id", "role", "x")


@query("m14_joint_adaptation")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = M.joint_adaptation(feat(spark, sf), 3, 4)
    return out.select("row_id", "role", "x", "predicted")


@query("m14_soft_joint_adaptation")
def m14_soft(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = M.joint_adaptation(feat(spark, sf), 3, 4, soft=True, unit=True)
    return out.select("row_id", "role", "x", "predicted")


@query("m15_anchor_alignment")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    return C.anchor_alignment(feat(spark, sf))[0].select("row_id", "domain", "x")


@query("m15_mcca_alignment")
def m15_mcca(spark: SparkSession, sf: str) -> DataFrame:
    return C.anchor_alignment(feat(spark, sf), mode="mcca", components=4)[0].select("row_id", "domain", "x")


@query("m15_ridge_alignment")
def m15_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return C.anchor_alignment(feat(spark, sf), mode="ridge", regularization=1.0)[0].select("row_id", "domain", "x")


@query("m15_contrastive_alignment")
def m15_contrastive(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows of each class as anchors of a fixed template."""
    return M.contrastive_alignment(feat(spark, sf), 6, 3).select("row_id", "domain", "x")


@query("m16_alignment_diagnostics")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors' correlation with the template before and after, beside the rows aligned."""
    out, facts = C.anchor_alignment(feat(spark, sf))
    return out.groupBy("domain").agg(F.count("*").alias("n_rows")).withColumns({"n_anchors": F.lit(facts["n_anchors"]), "before": F.lit(round(facts["before"], 6)), "after": F.lit(round(facts["after"], 6))})


FEW = f"""WITH {FEAT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY left(md5('0:' || row_id), 8), row_id) AS n FROM feat WHERE role = 'target'),
tr AS (SELECT label, {', '.join(f'x{i}' for i in D8)} FROM feat WHERE role = 'source' UNION ALL SELECT label, {', '.join(f'x{i}' for i in D8)} FROM k, unnest(range(3)) WHERE n <= 2),
cm AS (SELECT label, {', '.join(f'avg(x{i}) AS m{i}' for i in D8)} FROM tr GROUP BY 1), sd AS (SELECT {', '.join(f'greatest(stddev_samp(x{i}), 1e-12) AS s{i}' for i in D8)} FROM tr)
SELECT row_id, t.label, CAST(arg_min(cm.label, {d2('t', 'cm', 'sd')}) AS INTEGER) AS predicted FROM k t, cm, sd WHERE n > 2 GROUP BY 1, 2"""


@query("m17_few_shot", FEW)
def m17(spark: SparkSession, sf: str) -> DataFrame:
    return C.few_shot(feat(spark, sf), 2, 3).select("row_id", "label", "predicted")


BLEND = f"""WITH {FEAT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY left(md5('0:' || row_id), 8), row_id) AS n FROM feat WHERE role = 'target'),
a AS (SELECT * FROM feat WHERE role = 'source' UNION ALL SELECT * EXCLUDE n FROM k WHERE n <= 3),
ms AS (SELECT label, role, count(*) AS n, {', '.join(f'avg(x{i}) AS m{i}' for i in D8)} FROM a GROUP BY 1, 2), sd AS (SELECT {', '.join(f'greatest(stddev_samp(x{i}), 1e-8) AS s{i}' for i in D8)} FROM a),
cm AS (SELECT s.label, {', '.join(f'CASE WHEN t.n IS NULL THEN s.m{i} ELSE (4 * s.m{i} + t.n * t.m{i}) / (4 + t.n) END AS m{i}' for i in D8)} FROM ms s LEFT JOIN ms t ON t.label = s.label AND t.role = 'target' WHERE s.role = 'source'),
s AS (SELECT k.row_id, k.label, cm.label AS c, -({d2('k', 'cm', 'sd')}) AS sc FROM k, cm, sd WHERE k.n > 3), e AS (SELECT *, exp(sc - max(sc) OVER (PARTITION BY row_id)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)
SELECT row_id, label, CAST(arg_max(c, p) AS INTEGER) AS predicted, round(max(p), 6) AS confidence FROM p GROUP BY 1, 2"""


@query("m1_blended_prototypes", BLEND)
def m1_blended(spark: SparkSession, sf: str) -> DataFrame:
    f = feat(spark, sf)
    known, rest = C.few_known(f, 3)
    return C.blended_prototypes(f.where("role = 'source'"), known, rest).select("row_id", "label", "predicted", F.round(F.array_max("p"), 6).alias("confidence"))


CORRELATED = f"""WITH {FEAT_SQL}, w AS (SELECT label, pos, sum(v * (1 + row_id % 3)) / sum(1 + row_id % 3) AS v FROM longf WHERE role = 'source' GROUP BY 1, 2),
s AS (SELECT row_id, w.label, corr(f.v, w.v) AS sc FROM longf f JOIN w USING (pos) WHERE f.role = 'target' GROUP BY 1, 2), e AS (SELECT *, exp(sc - max(sc) OVER (PARTITION BY row_id)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)
SELECT row_id, CAST(arg_max(label, p) AS INTEGER) AS predicted, round(max(p), 6) AS confidence FROM p GROUP BY 1"""


@query("m1_correlated_prototypes", CORRELATED)
def m1_correlated(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows weigh 1, 2 or 3."""
    s, t = halves(spark, sf)
    return C.correlated(s.withColumn("weight", 1 + F.col("row_id") % 3), t, "weight").select("row_id", "predicted", F.round(F.array_max("p"), 6).alias("confidence"))


@query("m18_source_free")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    start = C.centroid(s, t)
    got = C.source_free(t, start)
    return got.select("row_id", P.predicted_index(F.col("p")).alias("predicted"), F.round(P.confidence(F.col("p")), 6).alias("confidence"))


@query("m18_setting_grid")
def m18_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the target by the best of many settings, and what is told of it."""
    s, t = halves(spark, sf)
    got, ranked = S.grid(t, C.centroid(s, t), S.grid_settings(thresholds=(0.3, 0.6), weights=(0.25, 0.5)))
    told = {k: F.lit(round(v, 6) if isinstance(v, float) else v) for k, v in ranked[0].items() if k in ("setting", "score", "rounds", "stop")} if ranked else {}
    return got.select("row_id", P.predicted_index(F.col("p")).alias("predicted"), F.round(P.confidence(F.col("p")), 6).alias("confidence")).withColumns(told)


@query("m18_consensus")
def m18_consensus(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    got, _ = S.consensus(t, C.centroid(s, t))
    return got.select("row_id", P.predicted_index(F.col("p")).alias("predicted"), F.round(P.confidence(F.col("p")), 6).alias("confidence"))


@query("m19_reconstruction")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.reconstruction_error(feat(spark, sf), 3), 6)


@query("m20_domain_risk", f"WITH {OBS_SQL}, d AS (SELECT subject, avg({NLL}) AS l FROM obs GROUP BY 1) SELECT round(avg(l), 9) AS mean_loss, round(var_pop(l), 9) AS variance, count(*) AS n_domains FROM d")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.domain_risk(obs(spark, sf), "subject", P.log_loss(F.col("p"), F.col("true_label"))))


@query("m20_risk_extrapolation")
def m20_vrex(spark: SparkSession, sf: str) -> DataFrame:
    s, t = halves(spark, sf)
    return G.extrapolated_risk(s, t, rounds=60, tolerance=1e-6)[0].select("row_id", "label", "predicted")


@query("m21_sweep", f"WITH {FEAT_SQL}, {LOO}, p AS (SELECT row_id, domain, own, arg_min(label, d) AS predicted FROM ls GROUP BY 1, 2, 3) SELECT 'centroid' AS method, domain AS fold, count(*) AS n, round(avg(CASE WHEN own = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p GROUP BY 2 UNION ALL SELECT 'majority', f.domain, count(*), round(avg(CASE WHEN f.label = m.label THEN 1.0 ELSE 0.0 END), 9) FROM feat f JOIN (SELECT d.domain, arg_max(c.label, c.n * 1000 - c.label) AS label FROM (SELECT DISTINCT domain FROM feat) d JOIN (SELECT a.domain, f.label, count(*) AS n FROM (SELECT DISTINCT domain FROM feat) a JOIN feat f ON f.domain <> a.domain GROUP BY 1, 2) c USING (domain) GROUP BY 1) m ON m.domain = f.domain GROUP BY 2")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    """Methods by folds in one table; partial results are kept by method and fold, and metrics come from them."""
    from chronoprob.sources.observations import shared_path, write_table

    f = feat(spark, sf)
    one = C.leave_one_domain_out(f).select(F.lit("centroid").alias("method"), F.col("domain").alias("fold"), "row_id", "label", "predicted")
    n = f.groupBy("domain", "label").agg(F.count("*").alias("n"))
    totals = f.groupBy("label").agg(F.count("*").alias("all_n")).join(F.broadcast(f.select("domain").distinct()))  # classes by folds
    rest = totals.join(n, ["domain", "label"], "left").select("domain", "label", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"))
    usual = rest.groupBy("domain").agg((-F.max(F.struct("n", (-F.col("label")).alias("l")))["l"]).alias("predicted"))
    two = f.join(usual, "domain").select(F.lit("majority").alias("method"), F.col("domain").alias("fold"), "row_id", "label", "predicted")
    path = write_table(one.unionByName(two), shared_path(spark, "sweep"), partition_by=("method", "fold"))
    rows = spark.read.parquet(path)
    return rounded(rows.groupBy("method", "fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy")))


def _window_model(pdf):
    """A caller's fit and predict on one domain's window: class means of the training rows, nearest for the others."""
    import numpy as np
    import pandas as pd

    train, test = pdf[pdf["role"] == "source"], pdf[pdf["role"] == "target"]
    if not len(train) or not len(test):
        return pd.DataFrame([], columns=["domain", "window", "row_id", "label", "predicted"])
    x, y = np.stack(train["x"].to_list()), train["label"].to_numpy()
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(axis=0) for c in classes])
    d = ((np.stack(test["x"].to_list())[:, None, :] - means) ** 2).sum(-1)
    return pd.DataFrame({"domain": test["domain"].tolist(), "window": test["window"].tolist(), "row_id": test["row_id"].tolist(), "label": test["label"].tolist(), "predicted": classes[d.argmin(axis=1)].tolist()})


USER_MODEL = f"""WITH {FEAT_SQL}, t AS (SELECT domain, pos // 8 AS w, pos, label, avg(v) AS m FROM longf WHERE row_id % 3 <> 0 GROUP BY 1, 2, 3, 4),
d AS (SELECT f.domain, w, row_id, f.label AS own, t.label, sum(power(f.v - m, 2)) AS d FROM longf f JOIN t ON t.domain = f.domain AND t.pos = f.pos WHERE row_id % 3 = 0 GROUP BY 1, 2, 3, 4, 5)
SELECT CAST(domain AS INTEGER) AS domain, CAST(w AS INTEGER) AS "window", row_id, own AS label, CAST(arg_min(label, d) AS INTEGER) AS predicted FROM d GROUP BY 1, 2, 3, 4"""


@query("o1_user_model", USER_MODEL)
def o1(spark: SparkSession, sf: str) -> DataFrame:
    from chronoprob.functions.udfs import fit_predict

    rows = C.windows_of(long_feat(spark, sf), 8).withColumn("role", F.when(F.col("row_id") % 3 == 0, "target").otherwise("source"))
    return fit_predict(rows, ["domain", "window"], _window_model, "domain int, window int, row_id long, label int, predicted int")


BAYES = f"""WITH {FEAT_SQL}, o AS (SELECT label, pos, avg(v) AS m, var_pop(v) AS v, count(*) AS n FROM longf WHERE role = 'source' GROUP BY 1, 2),
g AS (SELECT *, (n + 1) / CAST(sum(n) OVER (PARTITION BY pos) + count(*) OVER (PARTITION BY pos) AS DOUBLE) AS share FROM o),
s AS (SELECT row_id, f.label AS own, g.label, ln(max(share)) - sum(power(f.v - m, 2) / g.v + ln(g.v)) / 2 AS sc FROM longf f JOIN g USING (pos) WHERE f.role = 'target' GROUP BY 1, 2, 3)
SELECT row_id, own AS label, CAST(arg_max(label, sc) AS INTEGER) AS predicted, TRUE AS same FROM s GROUP BY 1, 2"""


@query("o2_registry", BAYES)
def o2(spark: SparkSession, sf: str) -> DataFrame:
    """A registered decoder by its name and by an alias: the same predictions."""
    s, t = halves(spark, sf)
    named, alias = C.fit_named("Naive-Bayes", s, t), C.fit_named("gnb", s, t).select("row_id", F.col("predicted").alias("other"))
    return named.join(alias, "row_id").select("row_id", "label", "predicted", (F.col("predicted") == F.col("other")).alias("same"))


@query("o3_trial_source", "SELECT CAST(vec_id AS BIGINT) AS trial_id, CAST(len(embedding) AS INTEGER) AS n_samples FROM embeddings")
def o3(spark: SparkSession, sf: str) -> DataFrame:
    """Trials written as text files and read through the registered data source."""
    from chronoprob.sources.observations import shared_path
    from chronoprob.sources.trials import register

    register(spark)
    path = shared_path(spark, "trials")
    e = table(spark, sf, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("string")), ",")).alias("value"))
    e.repartition(4).write.text(path)
    return spark.read.format("trial_csv").load(path).select("trial_id", F.size("samples").alias("n_samples"))


@query("o5_condition_table", f"WITH {OBS_SQL} SELECT event_id, condition FROM obs, (VALUES ('plain', 0.0), ('strict', 0.35)) c(condition, floor) WHERE conf >= floor")
def o5(spark: SparkSession, sf: str) -> DataFrame:
    """A table function gives each row the conditions that it meets, as a lateral join."""
    from chronoprob.functions.udfs import condition_function

    condition_function(spark, "met_conditions", {"plain": 0.0, "strict": 0.35})
    obs(spark, sf).select("event_id", P.confidence(F.col("p")).alias("conf")).createOrReplaceTempView("o5_rows")
    return spark.sql("SELECT event_id, condition FROM o5_rows, LATERAL met_conditions(conf)")
