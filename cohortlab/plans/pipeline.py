"""The five study stages as functions with Parquet / CSV / model outputs.

Each stage takes its upstream DataFrame or, when ``None``, re-reads the
upstream stage's completed output (A13), so stages can run separately like the
original command-line stages.  Outputs go under ``out_dir`` (a shared
path on a cluster) through ``handoff``: a stage run again on the same inputs
re-reads what it wrote, and a half-written output is never read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import attribution, buckets, features, metrics, models, panel, profile, split
from cohortlab.plans import handoff
from cohortlab.plans.study import Study
from cohortlab.sources import csv as csv_src

ROWS = ["PROJECT_ID", "AUTHOR_DATE"]       # clustering of the row-level tables


def _p(out_dir: str, *parts: str) -> str:
    return os.path.join(out_dir, *parts)


def _made_from(spark: SparkSession, stage: str, given: DataFrame | None, path: str) -> str:
    """Fingerprint of a stage that reads the output at ``path``, or the table it was given."""
    if given is None:
        return handoff.fingerprint(spark, stage=stage, version=handoff.version_of(spark, path))
    return handoff.fingerprint(spark, given, stage=stage)


def run_preprocessing(study: Study, out_dir: str) -> DataFrame:
    """Raw inputs -> interim tables and the cohort, all as Parquet (A9); returns the cohort."""
    spark, made_from = study.spark, study.fingerprint()
    key = ["PROJECT_ID", "COMMIT_HASH"]
    handoff.reuse(spark, _p(out_dir, "interim", "churn_per_commit"), made_from, lambda: study.churn, key)
    handoff.reuse(spark, _p(out_dir, "interim", "bic_labels"), made_from, lambda: study.bic_labels, key)
    handoff.reuse(spark, _p(out_dir, "interim", "refactoring_binary"), made_from, lambda: study.refs, key)
    return handoff.reuse(spark, _p(out_dir, "processed", "cohort_final"), made_from, lambda: study.cohort, ROWS)


def run_features(spark: SparkSession, out_dir: str, cohort: DataFrame | None = None,
                 impute_first: bool = False) -> DataFrame:
    """cohort (or its completed output) -> modeling table and panel as Parquet."""
    path = _p(out_dir, "processed", "cohort_final")
    made_from = _made_from(spark, f"features impute_first={impute_first}", cohort, path)

    def imputed() -> DataFrame:
        return features.imputed_cohort(cohort if cohort is not None else handoff.read(spark, path), impute_first)

    handoff.reuse(spark, _p(out_dir, "processed", "panel_data"), made_from, lambda: panel.final_panel(imputed()),
                  ["PROJECT_ID", "PERIOD_START"])
    return handoff.reuse(spark, _p(out_dir, "processed", "modeling_ready"), made_from,
                         lambda: features.modeling_ready(imputed()), ROWS)


def run_reports(spark: SparkSession, out_dir: str, modeling: DataFrame | None = None) -> None:
    """Report tables as headered CSV."""
    m = modeling if modeling is not None else handoff.read(spark, _p(out_dir, "processed", "modeling_ready"))
    csv_src.write_csv_report(profile.describe_by_label(m, config.DESCRIBE_VARIABLES),
                             _p(out_dir, "tables", "table1_descriptive_stats"))
    csv_src.write_csv_report(profile.project_report(m), _p(out_dir, "tables", "table2_bic_per_project"))
    csv_src.write_csv_report(buckets.rate_by_quartile(m), _p(out_dir, "tables", "bic_by_tdr_quartile"))


def run_modeling(spark: SparkSession, out_dir: str, modeling: DataFrame | None = None,
                 names: list[str] | None = None) -> dict[str, models.Fitted]:
    """Split, fit and save the models (A12); the scored test set is persisted."""
    path = _p(out_dir, "processed", "modeling_ready")
    sp = handoff.reuse(spark, _p(out_dir, "processed", "split"), _made_from(spark, "split", modeling, path), lambda: split.chrono_split(
        modeling if modeling is not None else handoff.read(spark, path)), ROWS)
    train = sp.filter(F.col("split") == "train")
    proj = models.vocabulary(train)
    fitted = {}
    for name in names or config.MODEL_ORDER[1:]:
        feats = config.MODEL_FEATURES[name]
        if name.startswith(("M1", "M2", "M3")):
            f = models.fit_logistic(train, feats, name, proj)
        elif name.startswith("M4"):
            f = models.fit_forest(train, feats, name, proj)
        else:
            f = models.fit_boosted(train, feats, name, proj)
        models.save(f, _p(out_dir, "models", name))
        fitted[name] = f
    coefs = [models.coefficient_table(f) for f in fitted.values() if f.kind == "logistic"]
    if coefs:
        t = coefs[0]
        for c in coefs[1:]:
            t = t.unionByName(c)
        csv_src.write_csv_report(t, _p(out_dir, "tables", "model_coefficients"))
    return fitted


def run_evaluation(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> DataFrame:
    """Score the test set with the saved models, persist the scores, write Table 3.

    Everything comes from ``out_dir``: no object of the training run is needed.
    """
    fitted = {n: models.load(_p(out_dir, "models", n)) for n in names or config.MODEL_ORDER[1:]}
    sp = handoff.read(spark, _p(out_dir, "processed", "split"))
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    parts = [models.dummy_scores(train, test)] + [f.score(test) for f in fitted.values()]
    sc = parts[0]
    for p in parts[1:]:
        sc = sc.unionByName(p)
    # the models are no table: their scores are written each time
    sc = handoff.write(sc.withColumnRenamed(config.TARGET, "label"), _p(out_dir, "processed", "test_scores"),
                       handoff.fingerprint(spark, sp, stage="scores"), ["model", "PROJECT_ID"])
    table3 = metrics.model_comparison(sc)
    csv_src.write_csv_report(table3, _p(out_dir, "tables", "table3_model_comparison"))
    lin = [f for f in fitted.values() if f.name.startswith("M3")]
    if lin:
        csv_src.write_csv_report(attribution.linear_attribution(lin[0], test, background=train),
                                 _p(out_dir, "tables", "attribution_M3"))
    return table3
