"""Feature, panel and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import buckets, features, panel, profile
from cohortlab.plans.oracle import MEAS
from cohortlab.plans.registry import register

LOGS = ["log_churn", "log_ncloc", "log_sqale_index", "log_ref_count"]
COH_D = MEAS + ["LINES_ADDED", "LINES_REMOVED", "CHURN", "REF_COUNT"]


@register("log_features", """
  SELECT PROJECT_ID, COMMIT_HASH, log_churn, log_ncloc, log_sqale_index, log_ref_count FROM fe_log""",
          doubles=LOGS, ops="H1")
def log_features(s):
    return features.log_transforms(s.cohort).select("PROJECT_ID", "COMMIT_HASH", *LOGS)


@register("log_feature_moments", """
  SELECT * FROM (VALUES ('log_churn'), ('log_ncloc'), ('log_sqale_index'), ('log_ref_count')) AS v(feature)
  JOIN (SELECT 'log_churn' AS f, avg(log_churn) AS mean, stddev_samp(log_churn) AS std FROM fe_log
        UNION ALL SELECT 'log_ncloc', avg(log_ncloc), stddev_samp(log_ncloc) FROM fe_log
        UNION ALL SELECT 'log_sqale_index', avg(log_sqale_index), stddev_samp(log_sqale_index) FROM fe_log
        UNION ALL SELECT 'log_ref_count', avg(log_ref_count), stddev_samp(log_ref_count) FROM fe_log) s
  ON v.feature = s.f""", doubles=["mean", "std"], ops="D17")
def log_feature_moments(s):
    return features.log_moments(features.log_transforms(s.cohort)).withColumn("f", F.col("feature"))


@register("impute_group_median", "SELECT PROJECT_ID, COMMIT_HASH, " + ", ".join(MEAS) + " FROM fe_imp",
          doubles=MEAS, ops="E4 D16 B6 C10")
def impute_group_median(s):
    return s.imputed.select("PROJECT_ID", "COMMIT_HASH", *MEAS)


@register("log_features_impute_first", """
  SELECT PROJECT_ID, COMMIT_HASH, ln(1 + CHURN) AS log_churn, coalesce(ln(1 + NCLOC), 0.0) AS log_ncloc,
         coalesce(ln(1 + SQALE_INDEX), 0.0) AS log_sqale_index, ln(1 + REF_COUNT) AS log_ref_count FROM fe_first""",
          doubles=LOGS, ops="H1 S18")
def log_features_impute_first(s):
    return features.imputed_cohort(s.cohort, impute_first=True).select("PROJECT_ID", "COMMIT_HASH", *LOGS)


@register("vif_two_columns", """
  SELECT v.Variable, 1 / (1 - r * r) AS VIF FROM
    (SELECT corr(SQALE_DEBT_RATIO, log_churn) AS r FROM fe_imp WHERE SQALE_DEBT_RATIO IS NOT NULL AND log_churn IS NOT NULL),
    (VALUES ('SQALE_DEBT_RATIO'), ('log_churn')) AS v(Variable)""", doubles=["VIF"], ops="D20 B10 G4")
def vif_two_columns(s):
    """With two columns each factor is 1 / (1 - r^2) over the complete rows."""
    return profile.vif(s.imputed, ["SQALE_DEBT_RATIO", "log_churn"])


_MISS_BEFORE = " UNION ALL ".join(
    f"SELECT '{m}' AS \"column\", count(*) - count({m}) AS n_missing, 'before' AS stage FROM fe_log" for m in MEAS)
_MISS_AFTER = " UNION ALL ".join(
    f"SELECT '{m}' AS \"column\", count(*) - count({m}) AS n_missing, 'after' AS stage FROM fe_imp"
    for m in MEAS + ["log_churn", "log_ncloc"])


@register("missing_counts", _MISS_BEFORE + " UNION ALL " + _MISS_AFTER, ops="D18 H10")
def missing_counts(s):
    before = features.missing_counts(features.log_transforms(s.cohort), MEAS, "before")
    after = features.missing_counts(s.imputed, MEAS + ["log_churn", "log_ncloc"], "after")
    return before.unionByName(after)


@register("interactions", "SELECT PROJECT_ID, COMMIT_HASH, TDR_x_REF, TDR_x_REFCOUNT FROM modeling",
          doubles=["TDR_x_REF", "TDR_x_REFCOUNT"], ops="B15")
def interactions(s):
    return features.interactions(s.imputed).select("PROJECT_ID", "COMMIT_HASH", "TDR_x_REF", "TDR_x_REFCOUNT")


@register("project_index", "SELECT PROJECT_ID, COMMIT_HASH, PROJECT_IDX FROM modeling", ops="E5")
def project_index(s):
    return features.dense_code(s.cohort.select("PROJECT_ID", "COMMIT_HASH"))


@register("time_index", "SELECT PROJECT_ID, COMMIT_HASH, AUTHOR_DATE, TIME_IDX FROM modeling", ops="E1 F1")
def time_index(s):
    return features.time_index(s.cohort.select("PROJECT_ID", "COMMIT_HASH", "AUTHOR_DATE"))


@register("modeling_ready", "SELECT * FROM modeling",
          doubles=COH_D + LOGS + ["TDR_x_REF", "TDR_x_REFCOUNT"], ops="A10 B21")
def modeling_ready(s):
    return s.modeling


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 2) AS r FROM fe_imp"
    for a in MEAS for b in MEAS)


@register("corr_matrix", _CORR, doubles=["r"], ops="D19 S13")
def corr_matrix(s):
    return profile.corr_matrix(s.imputed, config.CORR_VARIABLES)


_PANEL_D = ["TDR_mean", "TDR_max", "CHURN_sum", "NCLOC_mean", "REF_COUNT_sum", "BIC_RATE", "TDR_LAG1",
            "DELTA_TDR", "log_churn_sum", "log_ncloc", "BIC_RATE_NEXT_30D", "BIC_RATE_NEXT_60D",
            "BIC_RATE_NEXT_90D"]


@register("panel_month", """
  SELECT PROJECT_ID, PERIOD, PERIOD_START, TDR_mean, TDR_max, CHURN_sum, NCLOC_mean, N_COMMITS,
         BIC_COUNT, REF_COUNT_sum, BIC_RATE FROM panel_all""",
          doubles=["TDR_mean", "TDR_max", "CHURN_sum", "NCLOC_mean", "REF_COUNT_sum", "BIC_RATE"], ops="D9 H7 H11")
def panel_month(s):
    return panel.panel_month(s.imputed).select(
        "PROJECT_ID", "PERIOD", "PERIOD_START", "TDR_mean", "TDR_max", "CHURN_sum", "NCLOC_mean",
        "N_COMMITS", "BIC_COUNT", "REF_COUNT_sum", "BIC_RATE")


@register("panel_lag", """
  SELECT PROJECT_ID, PERIOD, TDR_mean, TDR_LAG1, DELTA_TDR, log_churn_sum, log_ncloc FROM panel_all""",
          doubles=["TDR_mean", "TDR_LAG1", "DELTA_TDR", "log_churn_sum", "log_ncloc"], ops="E2 E3")
def panel_lag(s):
    return panel.panel_month(s.imputed).select(
        "PROJECT_ID", "PERIOD", "TDR_mean", "TDR_LAG1", "DELTA_TDR", "log_churn_sum", "log_ncloc")


@register("panel_forward_rate", """
  SELECT PROJECT_ID, PERIOD_START, BIC_RATE_NEXT_30D, BIC_RATE_NEXT_60D, BIC_RATE_NEXT_90D FROM panel_all""",
          doubles=["BIC_RATE_NEXT_30D", "BIC_RATE_NEXT_60D", "BIC_RATE_NEXT_90D"], ops="C8 E8 H8")
def panel_forward_rate(s):
    return s.panel_all.select("PROJECT_ID", "PERIOD_START", "BIC_RATE_NEXT_30D", "BIC_RATE_NEXT_60D",
                              "BIC_RATE_NEXT_90D")


@register("panel", "SELECT * FROM panel_all WHERE DELTA_TDR IS NOT NULL", doubles=_PANEL_D, ops="B9 A10")
def panel_q(s):
    return s.panel


@register("forward_rate_means", """
  SELECT CAST(30 AS INTEGER) AS tau_days, avg(BIC_RATE_NEXT_30D) AS mean_forward_rate FROM panel_all
  UNION ALL SELECT 60, avg(BIC_RATE_NEXT_60D) FROM panel_all
  UNION ALL SELECT 90, avg(BIC_RATE_NEXT_90D) FROM panel_all""", doubles=["mean_forward_rate"], ops="D23")
def forward_rate_means(s):
    return panel.forward_rate_means(s.panel_all)


_DESC = " UNION ALL ".join(f"""
  SELECT '{v}' AS Variable, g AS "Group", count({v}) AS N, round(avg({v}), 4) AS Mean,
         round(median({v}), 4) AS Median, round(stddev_samp({v}), 4) AS SD,
         round(min({v}), 4) AS Min, round(max({v}), 4) AS Max,
         round(avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS Missing_pct
  FROM (SELECT CAST({v} AS DOUBLE) AS {v}, 'BIC=' || CAST(BIC AS VARCHAR) AS g FROM modeling
        UNION ALL SELECT CAST({v} AS DOUBLE), 'All' FROM modeling) GROUP BY g""" for v in config.DESCRIBE_VARIABLES)


@register("describe_by_label", _DESC, doubles=["Mean", "Median", "SD", "Min", "Max", "Missing_pct"], ops="D10 B16")
def describe_by_label(s):
    return profile.describe_by_label(s.modeling, config.DESCRIBE_VARIABLES)


@register("project_report", """
  SELECT replace(PROJECT_ID, 'org.apache:', '') AS PROJECT_ID, count(COMMIT_HASH) AS N_Commits,
         CAST(sum(BIC) AS BIGINT) AS N_BIC, round(avg(BIC) * 100, 2) AS BIC_Rate_pct,
         median(SQALE_DEBT_RATIO) AS TDR_Median, median(CHURN) AS Churn_Median,
         CAST(sum(HAS_REFACTORING) AS BIGINT) AS N_Refactoring
  FROM modeling GROUP BY PROJECT_ID""", doubles=["BIC_Rate_pct", "TDR_Median", "Churn_Median"], ops="D11 H6 F2")
def project_report(s):
    return profile.project_report(s.modeling)


@register("project_rate_buckets", """
  SELECT *, avg(pct) OVER () AS mean_of_rates_pct FROM (
    SELECT PROJECT_ID, avg(BIC) AS mean, count(*) AS count, avg(BIC) * 100 AS pct,
           replace(PROJECT_ID, 'org.apache:', '') AS short_name,
           CASE WHEN avg(BIC) * 100 > 15 THEN 'high' WHEN avg(BIC) * 100 > 8 THEN 'mid' ELSE 'low' END AS bucket
    FROM modeling GROUP BY PROJECT_ID)""", doubles=["mean", "pct", "mean_of_rates_pct"], ops="K1 D12 B19 H6")
def project_rate_buckets(s):
    return buckets.project_rate_buckets(s.modeling)


@register("debt_quartiles", """
  SELECT s.quartile, s.Q, g.BIC_rate, CAST(coalesce(g.n, 0) AS BIGINT) AS n, g.BIC_rate * 100 AS pct
  FROM qspine s LEFT JOIN (SELECT quartile, avg(BIC) AS BIC_rate, count(*) AS n FROM quart
                           WHERE quartile IS NOT NULL GROUP BY 1) g ON s.quartile = g.quartile""",
          doubles=["BIC_rate", "pct"], ops="D13 D14 K2 S12")
def debt_quartiles(s):
    return buckets.rate_by_quartile(s.modeling)


@register("quartile_by_flag", """
  SELECT s.quartile, s.Q,
         coalesce(avg(CASE WHEN HAS_REFACTORING = 0 THEN BIC END) * 100, 0.0) AS pct_no_refactoring,
         coalesce(avg(CASE WHEN HAS_REFACTORING = 1 THEN BIC END) * 100, 0.0) AS pct_has_refactoring
  FROM qspine s LEFT JOIN quart q ON s.quartile = q.quartile GROUP BY s.quartile, s.Q""",
          doubles=["pct_no_refactoring", "pct_has_refactoring"], ops="D15 K3")
def quartile_by_flag(s):
    return buckets.rate_by_quartile_and_flag(s.modeling)
