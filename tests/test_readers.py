"""Readers, writers and the trial source."""

import pytest

from chronoprob.sources import observations as O
from chronoprob.sources.trials import register


def test_columns_are_found_by_number():
    assert O.probability_columns(["prob_class_10", "x", "prob_class_2"]) == ["prob_class_2", "prob_class_10"]
    with pytest.raises(ValueError):
        O.probability_columns(["prob_class_1", "prob_class_01"])
    with pytest.raises(ValueError):
        O.probability_columns(["x"])


def test_defaults_from_files(spark, tmp_path):
    (tmp_path / "sub-07.csv").write_text("time,sample_index,prob_class_0,prob_class_1\n0.1,5,0.25,0.75\n")
    row = O.read_observations(spark, str(tmp_path / "sub-07.csv")).first()
    assert (row["subject"], row["sequence_id"], row["decoder"], row["emission_mode"], row["p"]) == ("sub-07", 5, "decoder", "calibrated", [0.25, 0.75])


def test_results_need_their_metrics(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time,accuracy\n0.1,0.5\n")
    with pytest.raises(ValueError):
        O.read_results(spark, str(tmp_path / "r.csv"))


def test_window_grid_does_not_drift(spark):
    trials = spark.createDataFrame([(1, 0.0, 1.0)], "trial_id int, a double, b double")
    rows = O.window_grid(trials, "a", "b", 0.5, 0.1).orderBy("window_index").collect()
    assert len(rows) == 6 and rows[3]["window_start"] == 3 * 0.1


def test_trial_source(spark, tmp_path):
    (tmp_path / "t.txt").write_text("4,1.5,2.5\n9,0.5\n")
    register(spark)
    got = {r["trial_id"]: r["samples"] for r in spark.read.format("trial_csv").load(str(tmp_path)).collect()}
    assert got == {4: [1.5, 2.5], 9: [0.5]}
