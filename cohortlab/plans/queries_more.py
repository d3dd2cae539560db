"""Source, cleaning and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import profile
from cohortlab.plans.oracle import MEAS
from cohortlab.plans.registry import register
from cohortlab.session import scratch_path
from cohortlab.sources import csv as csv_src
from cohortlab.sources import fixtures

# driver table columns (fixed by the driver's data set)
DRIVER_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _inv_sql(tables: dict[str, list[str]]) -> str:
    parts = []
    for t, cols in tables.items():
        miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
        parts.append(f"""SELECT '{t}' AS File, count(*) AS Rows, CAST({len(cols)} AS BIGINT) AS Cols,
          CAST({miss} AS BIGINT) AS Missing_Cells,
          CASE WHEN count(*) * {len(cols)} > 0 THEN round(({miss}) * 100.0 / (count(*) * {len(cols)}), 2)
               ELSE 0.0 END AS Missing_pct FROM {t}""")
    return " UNION ALL ".join(parts)


@register("inventory", _inv_sql(DRIVER_COLUMNS), doubles=["Missing_pct"], ops="A15 A16 A8")
def inventory(s):
    return profile.inventory(fixtures.driver_tables(s.spark, s.sf_dir))


_STUDY_COLS = {
    "fx_commits": ["PROJECT_ID", "COMMIT_HASH", "AUTHOR_DATE", "IN_MAIN_BRANCH", "MERGE"],
    "fx_changes": ["PROJECT_ID", "COMMIT_HASH", "LINES_ADDED", "LINES_REMOVED"],
    "fx_projects": ["PROJECT_ID", "NAME", "REGION"],
    "fx_szz": ["PROJECT_ID", "FAULT_FIXING_COMMIT_HASH", "FAULT_INDUCING_COMMIT_HASH"],
    "fx_refactoring": ["PROJECT_ID", "COMMIT_HASH", "REFACTORING_TYPE"],
    "fx_sonar_analysis": ["PROJECT_ID", "ANALYSIS_KEY", "DATE", "REVISION"],
    "fx_sonar_measures": ["PROJECT_ID", "ANALYSIS_KEY"] + MEAS,
}


@register("inventory_study", _inv_sql(_STUDY_COLS).replace("SELECT 'fx_", "SELECT '"),
          doubles=["Missing_pct"], ops="A15 A16")
def inventory_study(s):
    return profile.inventory(s.raw)


@register("dedup_snapshots", "SELECT * FROM c_sonar_analysis", ops="B3 B2 S2")
def dedup_snapshots(s):
    return s.clean["sonar_analysis"]


@register("distinct_szz", "SELECT * FROM c_szz", ops="B4")
def distinct_szz(s):
    return s.clean["szz"]


@register("clip_measures", "SELECT * FROM c_sonar_measures", doubles=MEAS, ops="B7 S6 S7")
def clip_measures(s):
    return s.clean["sonar_measures"]


@register("churn_summary", """
  SELECT count(*) AS n_commits, median(CHURN) AS churn_median, avg(CHURN) AS churn_mean,
         max(CHURN) AS churn_max FROM churn""", doubles=["churn_median", "churn_mean"], ops="D5")
def churn_summary(s):
    return profile.churn_summary(s.churn)


@register("ref_count_summary", """
  SELECT count(*) AS n_commits, median(REF_COUNT) AS ref_count_median, avg(REF_COUNT) AS ref_count_mean,
         max(REF_COUNT) AS ref_count_max FROM refs""", doubles=["ref_count_median", "ref_count_mean"], ops="D5 S3")
def ref_count_summary(s):
    return profile.ref_count_summary(s.refs)


@register("cohort_summary", """
  SELECT count(*) AS n_commits, count(DISTINCT PROJECT_ID) AS n_projects, CAST(sum(BIC) AS BIGINT) AS n_bic,
         avg(BIC) * 100 AS bic_pct, count(*) FILTER (WHERE BIC = 0) AS n_non_bic,
         CAST(sum(HAS_REFACTORING) AS BIGINT) AS n_refactoring, avg(HAS_REFACTORING) * 100 AS refactoring_pct,
         CAST(min(AUTHOR_DATE) AS DATE) AS first_date, CAST(max(AUTHOR_DATE) AS DATE) AS last_date
  FROM cohort""", doubles=["bic_pct", "refactoring_pct"], ops="D6 H9 D4")
def cohort_summary(s):
    return profile.cohort_summary(s.cohort)


def _scratch(s, name):
    return scratch_path(s.spark, name)


@register("csv_roundtrip_commits", "SELECT * FROM fx_commits", ops="A1 B2 S14")
def csv_roundtrip_commits(s):
    path = _scratch(s, "commits_csv")
    fixtures.csv_roundtrip(s.raw["commits"], path)
    return csv_src.read_csv(s.spark, path, csv_src.COMMITS)


@register("csv_roundtrip_changes", "SELECT * FROM fx_changes", ops="A2 S14")
def csv_roundtrip_changes(s):
    path = _scratch(s, "changes_csv")
    fixtures.csv_roundtrip(s.raw["changes"], path)
    return csv_src.read_csv(s.spark, path, csv_src.CHANGES)


@register("csv_split_changes", "SELECT * FROM fx_changes", ops="A2 S14")
def csv_split_changes(s):
    """Every row has a quoted field with line breaks, and every file is read by several tasks."""
    path = scratch_path(s.spark, "changes_split_csv")
    fixtures.csv_roundtrip(s.raw["changes"], path, extra='first line\nthen "this",\n\nand the last')
    return csv_src.read_csv(s.spark, path, csv_src.CHANGES, split_bytes=1 << 17)


@register("csv_quarantine_changes", """
  SELECT PROJECT_ID, COMMIT_HASH, CAST(LINES_ADDED AS VARCHAR) || ' lines' AS LINES_ADDED,
         coalesce(CAST(LINES_REMOVED AS VARCHAR), 'NA') AS LINES_REMOVED FROM fx_changes WHERE LINES_ADDED % 10 = 0""", ops="A2 B2 S14")
def csv_quarantine_changes(s):
    """The rows that strict reading sets aside: each tenth number of lines is no number."""
    path = scratch_path(s.spark, "changes_bad_csv")
    text = F.col("LINES_ADDED").cast("string")
    fixtures.csv_roundtrip(s.raw["changes"].withColumn("LINES_ADDED", F.when(
        F.col("LINES_ADDED") % 10 == 0, F.concat(text, F.lit(" lines"))).otherwise(text)), path)
    return csv_src.read_csv_checked(s.spark, path, csv_src.CHANGES)[1]


@register("csv_roundtrip_szz", "SELECT * FROM fx_szz", ops="A4 S14")
def csv_roundtrip_szz(s):
    path = _scratch(s, "szz_csv")
    fixtures.csv_roundtrip(s.raw["szz"], path)
    return csv_src.read_csv(s.spark, path, csv_src.SZZ)


@register("csv_roundtrip_refactoring", "SELECT * FROM fx_refactoring", ops="A5 S14")
def csv_roundtrip_refactoring(s):
    path = _scratch(s, "refactoring_csv")
    fixtures.csv_roundtrip(s.raw["refactoring"], path)
    return csv_src.read_csv(s.spark, path, csv_src.REFACTORING)


@register("csv_roundtrip_analysis", "SELECT * FROM fx_sonar_analysis", ops="A6 B2 S14")
def csv_roundtrip_analysis(s):
    path = _scratch(s, "analysis_csv")
    fixtures.csv_roundtrip(s.raw["sonar_analysis"], path)
    return csv_src.read_csv(s.spark, path, csv_src.SONAR_ANALYSIS)


@register("csv_roundtrip_projects", "SELECT * FROM fx_projects", ops="A3 S14")
def csv_roundtrip_projects(s):
    path = _scratch(s, "projects_csv")
    fixtures.csv_roundtrip(s.raw["projects"], path)
    return csv_src.read_csv(s.spark, path, infer=True).select(*s.raw["projects"].columns)


@register("csv_roundtrip_measures", "SELECT * FROM fx_sonar_measures", doubles=MEAS, ops="A7 S14")
def csv_roundtrip_measures(s):
    path = _scratch(s, "measures_csv")
    fixtures.csv_roundtrip(s.raw["sonar_measures"], path)
    return csv_src.read_csv(s.spark, path, csv_src.SONAR_MEASURES)


@register("csv_report_roundtrip", """
  SELECT replace(PROJECT_ID, 'org.apache:', '') AS PROJECT_ID, count(*) AS N, CAST(sum(BIC) AS BIGINT) AS BIC_count
  FROM cohort GROUP BY PROJECT_ID""", ops="A11 A3")
def csv_report_roundtrip(s):
    from cohortlab.operators.profile import bic_by_project
    path = _scratch(s, "report_csv")
    rep = bic_by_project(s.cohort).select(F.replace("PROJECT_ID", F.lit("org.apache:"), F.lit("")).alias("PROJECT_ID"),
                                          "N", "BIC_count")
    csv_src.write_csv_report(rep, path)
    back = csv_src.read_csv(s.spark, path, infer=True)
    return back.select(F.col("PROJECT_ID").cast("string"), F.col("N").cast("bigint"),
                       F.col("BIC_count").cast("bigint"))


@register("stage_roundtrip", "SELECT * FROM modeling",
          doubles=MEAS + ["LINES_ADDED", "LINES_REMOVED", "CHURN", "REF_COUNT", "log_churn", "log_ncloc",
                          "log_sqale_index", "log_ref_count", "TDR_x_REF", "TDR_x_REFCOUNT"], ops="A9 A10 A13")
def stage_roundtrip(s):
    """Preprocessing writes its Parquet outputs; the feature stage re-reads the cohort from disk."""
    from cohortlab.plans import pipeline
    out = _scratch(s, "pipeline")
    pipeline.run_preprocessing(s, out)
    return pipeline.run_features(s.spark, out, cohort=None)
