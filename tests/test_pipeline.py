"""The stage runner end to end on sf0.001 with one logistic model."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_stage_functions_write_and_reread(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    from cohortlab.plans import pipeline
    from cohortlab.plans.study import Study
    out = str(tmp_path / "out")
    s = Study(spark, SF)
    cohort = pipeline.run_preprocessing(s, out)
    assert cohort.count() == 70
    m = pipeline.run_features(spark, out)                 # re-reads the cohort Parquet
    assert m.count() == 70 and "TIME_IDX" in m.columns
    pipeline.run_reports(spark, out)
    pipeline.run_modeling(spark, out, names=["M1_lr_baseline"])
    t3 = pipeline.run_evaluation(spark, out, names=["M1_lr_baseline"]).collect()
    assert [r.Model for r in t3] == ["M0_dummy", "M1_lr_baseline"]
    assert os.path.isdir(os.path.join(out, "models", "M1_lr_baseline"))
