"""Closed-form checks of probability functions, metrics and validation."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.functions import probability as P
from chronoprob.functions import vectors as V
from chronoprob.operators import metrics as M
from chronoprob.operators import schema as S


def rows(spark, data, schema="id int, true_label int, p array<double>"):
    return spark.createDataFrame(data, schema)


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_ties_go_to_the_lower_class(spark):
    df = rows(spark, [(1, 2, [0.2, 0.4, 0.4])])
    assert one(df, P.predicted_index(F.col("p"))) == 1
    assert one(df, P.rank_of(F.col("p"), F.col("true_label"))) == 2
    assert [x["class"] for x in one(df, P.ranking(F.col("p")))] == [1, 2, 0]


def test_uniform_rows(spark):
    df = rows(spark, [(1, 0, [0.25] * 4)])
    assert one(df, P.entropy(F.col("p"), True)) == pytest.approx(1.0)
    assert one(df, P.margin(F.col("p"))) == 0.0
    assert one(df, P.log_loss(F.col("p"), F.col("true_label"))) == pytest.approx(math.log(4))
    assert one(df, P.brier(F.col("p"), F.col("true_label"))) == pytest.approx(0.75)


def test_temperature_and_prior(spark):
    df = rows(spark, [(1, 0, [0.8, 0.2])])
    assert one(df, P.tempered(F.col("p"), 1.0)) == pytest.approx([0.8, 0.2])
    assert one(df, P.tempered(F.col("p"), 1e9)) == pytest.approx([0.5, 0.5])
    even = F.array(F.lit(0.5), F.lit(0.5))
    assert one(df, P.reweighted(F.col("p"), even, even)) == pytest.approx([0.8, 0.2])


def test_calibration_bins_use_the_edges_of_tenths(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "c double")
    assert [r["b"] for r in df.select(P.calibration_bin(F.col("c")).alias("b")).collect()] == [2, 3, 9, 0]


def test_ece_and_empty_bins(spark):
    df = rows(spark, [(1, 0, [0.75, 0.25]), (2, 1, [0.75, 0.25])])
    assert M.ece(df).first()["ece"] == pytest.approx(0.25)
    bins = M.reliability(df).orderBy("bin").collect()
    assert [r["n_samples"] for r in bins] == [0] * 7 + [2, 0, 0]
    assert bins[0]["accuracy"] is None and bins[7]["gap"] == pytest.approx(-0.25)


def test_weighted_metrics_equal_repeated_rows(spark):
    data = [(1, 0, [0.6, 0.4], 2.0), (2, 1, [0.7, 0.3], 1.0)]
    weighted = M.all_metrics(rows(spark, data, "id int, true_label int, p array<double>, w double"), [], weight="w").first()
    plain = M.all_metrics(rows(spark, [data[0][:3], data[0][:3], data[1][:3]]), []).first()
    for c in ("accuracy", "brier", "log_loss", "ece"):
        assert weighted[c] == pytest.approx(plain[c])


def test_validation_names_each_fault(spark):
    df = spark.createDataFrame([(1, 7, 0.0, [0.5, 0.5]), (2, 7, 0.0, [0.5, 0.5]), (3, 7, None, [0.5, 0.5]), (4, 7, 2.0, [1.5, -0.5]), (5, 7, 3.0, [0.5, 0.1])], "event_id long, stream_id long, time double, p array<double>")
    got = {(r["code"], r["row"]) for r in S.validation_issues(df, ["stream_id"]).collect()}
    assert got == {("duplicate_time", 1), ("duplicate_time", 2), ("time_missing", 3), ("probability_domain", 4), ("probability_sum", 5)}


def test_row_maps(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0, 1.0],)], "x array<double>")
    x = F.col("x")
    assert one(df, V.row_normalized(x, "l1")) == pytest.approx([3 / 8, -0.5, 0, 1 / 8])
    assert one(df, V.rolled(x, 1)) == [1.0, 3.0, -4.0, 0.0]
    assert one(df, V.rolled(x, -1)) == [-4.0, 0.0, 1.0, 3.0]
    assert one(df, V.rolled(x, 1, "fill", 9.0)) == [9.0, 3.0, -4.0, 0.0]
    assert one(df, V.signed_power(x, 0.5)) == pytest.approx([3**0.5, -2.0, 0.0, 1.0])


def test_student_tail():
    assert M._student_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert M._student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert M._student_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_bound_values_are_computed_once_a_row(spark):
    """A softmax over the distances to many class means stays linear in the classes."""
    from chronoprob.functions.vectors import row_normalized, squared_distance

    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * F.col("id") % 7).cast("double")).alias("x"))
    means = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (k * i % 5).cast("double")))
    scores = F.transform(means, lambda m: -squared_distance(F.col("x"), m) / 64)
    began = time.perf_counter()
    got = rows.select(P.total(P.softmax(scores)).alias("s"), P.total(F.transform(row_normalized(F.col("x"), "l2", center=True), lambda v: v * v)).alias("n")).agg(F.min("s"), F.max("s"), F.max("n")).first()
    assert time.perf_counter() - began < 30  # nested recomputation takes hours
    assert np.allclose(got, 1)
