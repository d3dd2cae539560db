"""DuckDB SQL forms of the registered queries (the correctness oracle).

Named CTE fragments are assembled per query by dependency closure.  The
fixture CTEs reproduce the mapping of the driver's tables onto the study's
logical inputs; the rest restate each stage's semantics in plain SQL.
"""

from __future__ import annotations

import re

MEAS = ["SQALE_DEBT_RATIO", "SQALE_INDEX", "CODE_SMELLS", "COMPLEXITY",
        "COGNITIVE_COMPLEXITY", "DUPLICATED_LINES_DENSITY", "NCLOC"]

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


# --- fixture mapping ----------------------------------------------------------
cte("fx_commits", """
  SELECT 'org.apache:' || n_name AS PROJECT_ID, CAST(o_orderkey AS VARCHAR) AS COMMIT_HASH,
         o_orderdate AS AUTHOR_DATE, o_orderstatus <> 'P' AS IN_MAIN_BRANCH,
         o_orderpriority = '5-LOW' AS MERGE
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
cte("fx_changes", """
  SELECT PROJECT_ID, COMMIT_HASH, CAST(l_quantity AS BIGINT) AS LINES_ADDED,
         CASE WHEN l_returnflag = 'N' THEN NULL
              ELSE CAST(round(l_tax * 100) AS BIGINT) END AS LINES_REMOVED
  FROM lineitem JOIN fx_commits ON COMMIT_HASH = CAST(l_orderkey AS VARCHAR)""")
cte("fx_szz", """
  SELECT PROJECT_ID, CAST(l_partkey AS VARCHAR) AS FAULT_FIXING_COMMIT_HASH,
         COMMIT_HASH AS FAULT_INDUCING_COMMIT_HASH
  FROM lineitem JOIN fx_commits ON COMMIT_HASH = CAST(l_orderkey AS VARCHAR)
  WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND round(l_discount * 100) >= 8""")
cte("fx_refactoring", """
  SELECT PROJECT_ID, COMMIT_HASH, l_returnflag || l_linestatus AS REFACTORING_TYPE
  FROM lineitem JOIN fx_commits ON COMMIT_HASH = CAST(l_orderkey AS VARCHAR)
  WHERE round(l_tax * 100) >= 7""")
cte("fx_snap_raw", """
  SELECT 'org.apache:' || n_name AS PROJECT_ID, strftime(snap, '%Y%m%d') AS ANALYSIS_KEY,
         snap AS DATE, count(*) AS n,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t,
         CAST(sum(l_linenumber) AS BIGINT) AS ln, CAST(sum(l_partkey) AS BIGINT) AS pk,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM (SELECT *, make_timestamp(year(l_shipdate), month(l_shipdate), CASE WHEN day(l_shipdate) < 15 THEN 1 ELSE 15 END,
                                 0, 0, 0.0) AS snap FROM lineitem)
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3""")
cte("fx_sonar_analysis", "SELECT PROJECT_ID, ANALYSIS_KEY, DATE, ANALYSIS_KEY AS REVISION FROM fx_snap_raw")
cte("fx_sonar_measures", """
  SELECT PROJECT_ID, ANALYSIS_KEY,
         CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(d AS DOUBLE) / n END AS SQALE_DEBT_RATIO,
         CAST(pk AS DOUBLE) AS SQALE_INDEX, CAST(n AS DOUBLE) AS CODE_SMELLS,
         CAST(ln AS DOUBLE) AS COMPLEXITY,
         CASE WHEN ln % 3 = 0 THEN NULL ELSE CAST(ln * 2 AS DOUBLE) END AS COGNITIVE_COMPLEXITY,
         CAST(t - 4 AS DOUBLE) AS DUPLICATED_LINES_DENSITY,
         CASE WHEN q % 11 = 0 THEN NULL ELSE CAST(q AS DOUBLE) END AS NCLOC
  FROM fx_snap_raw""")

# --- cleaning -------------------------------------------------------------------
cte("c_commits", """
  SELECT PROJECT_ID, COMMIT_HASH, AUTHOR_DATE, IN_MAIN_BRANCH, MERGE FROM (
    SELECT *, row_number() OVER (PARTITION BY PROJECT_ID, COMMIT_HASH
                                 ORDER BY AUTHOR_DATE, IN_MAIN_BRANCH, MERGE) AS rn
    FROM fx_commits) WHERE rn = 1""")
cte("c_changes", """
  SELECT PROJECT_ID, COMMIT_HASH, coalesce(LINES_ADDED, 0) AS LINES_ADDED,
         coalesce(LINES_REMOVED, 0) AS LINES_REMOVED FROM fx_changes""")
cte("c_sonar_analysis", """
  SELECT PROJECT_ID, ANALYSIS_KEY, DATE, REVISION FROM (
    SELECT *, row_number() OVER (PARTITION BY PROJECT_ID, ANALYSIS_KEY ORDER BY DATE, REVISION) AS rn
    FROM fx_sonar_analysis) WHERE rn = 1""")
cte("c_sonar_measures", "SELECT PROJECT_ID, ANALYSIS_KEY, " + ", ".join(
    f"CASE WHEN isnan({m}) THEN NULL WHEN {m} < 0 THEN 0.0 ELSE {m} END AS {m}" for m in MEAS)
    + " FROM fx_sonar_measures")
cte("c_szz", "SELECT DISTINCT * FROM fx_szz")
cte("c_refactoring", "SELECT DISTINCT * FROM fx_refactoring")

# --- preprocessing stages --------------------------------------------------------
cte("base", """
  SELECT * FROM c_commits WHERE IN_MAIN_BRANCH AND NOT MERGE AND PROJECT_ID IN (
    SELECT PROJECT_ID FROM c_commits WHERE IN_MAIN_BRANCH AND NOT MERGE
    GROUP BY PROJECT_ID HAVING count(*) >= 50)""")
cte("churn", """
  SELECT PROJECT_ID, COMMIT_HASH, CAST(sum(LINES_ADDED) AS BIGINT) AS LINES_ADDED,
         CAST(sum(LINES_REMOVED) AS BIGINT) AS LINES_REMOVED,
         CAST(sum(LINES_ADDED) + sum(LINES_REMOVED) AS BIGINT) AS CHURN
  FROM c_changes WHERE PROJECT_ID IS NOT NULL AND COMMIT_HASH IS NOT NULL GROUP BY 1, 2""")
cte("bic", """
  SELECT DISTINCT PROJECT_ID, FAULT_INDUCING_COMMIT_HASH AS COMMIT_HASH, 1 AS BIC FROM c_szz
  WHERE PROJECT_ID IS NOT NULL AND FAULT_INDUCING_COMMIT_HASH IS NOT NULL""")
cte("refs", """
  SELECT PROJECT_ID, COMMIT_HASH, count(REFACTORING_TYPE) AS REF_COUNT, 1 AS HAS_REFACTORING
  FROM (SELECT DISTINCT PROJECT_ID, COMMIT_HASH, REFACTORING_TYPE FROM c_refactoring
        WHERE PROJECT_ID IS NOT NULL AND COMMIT_HASH IS NOT NULL) GROUP BY 1, 2""")
cte("snaps0", """
  SELECT a.PROJECT_ID, a.ANALYSIS_KEY, a.DATE, """ + ", ".join(f"m.{m}" for m in MEAS) + """
  FROM c_sonar_analysis a JOIN c_sonar_measures m
    ON a.PROJECT_ID = m.PROJECT_ID AND a.ANALYSIS_KEY = m.ANALYSIS_KEY
  WHERE m.SQALE_DEBT_RATIO IS NOT NULL""")
cte("snaps", """
  SELECT * FROM snaps0 WHERE PROJECT_ID IN (
    SELECT PROJECT_ID FROM snaps0 GROUP BY 1 HAVING count(*) >= 5)""")
cte("linked_all", """
  SELECT b.*, s.DATE, """ + ", ".join(f"s.{m}" for m in MEAS) + """
  FROM base b ASOF LEFT JOIN snaps s ON b.PROJECT_ID = s.PROJECT_ID AND b.AUTHOR_DATE >= s.DATE""")
cte("linked", "SELECT * FROM linked_all WHERE DATE IS NOT NULL")
cte("linked_strict", """
  SELECT b.*, s.DATE, """ + ", ".join(f"s.{m}" for m in MEAS) + """
  FROM base b ASOF JOIN snaps s ON b.PROJECT_ID = s.PROJECT_ID AND b.AUTHOR_DATE > s.DATE""")
cte("cohort", """
  SELECT l.*, CAST(coalesce(ch.LINES_ADDED, 0) AS DOUBLE) AS LINES_ADDED,
         CAST(coalesce(ch.LINES_REMOVED, 0) AS DOUBLE) AS LINES_REMOVED,
         CAST(coalesce(ch.CHURN, 0) AS DOUBLE) AS CHURN,
         CAST(coalesce(b.BIC, 0) AS INTEGER) AS BIC,
         CAST(coalesce(r.HAS_REFACTORING, 0) AS INTEGER) AS HAS_REFACTORING,
         CAST(coalesce(r.REF_COUNT, 0) AS DOUBLE) AS REF_COUNT
  FROM linked l
  LEFT JOIN churn ch ON l.PROJECT_ID = ch.PROJECT_ID AND l.COMMIT_HASH = ch.COMMIT_HASH
  LEFT JOIN bic b ON l.PROJECT_ID = b.PROJECT_ID AND l.COMMIT_HASH = b.COMMIT_HASH
  LEFT JOIN refs r ON l.PROJECT_ID = r.PROJECT_ID AND l.COMMIT_HASH = r.COMMIT_HASH""")


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every CTE it needs, in definition order."""
    names = list(CTES)
    need: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for n in names:
            if n not in need and re.search(rf"\b{n}\b", text):
                need.add(n)
                frontier.append(CTES[n])
    used = [n for n in names if n in need]
    if not used:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in used) + "\n" + body.strip()


def rounded(body: str, cols: list[str], digits: int = 6) -> str:
    """Wrap ``body`` so the listed double columns are rounded like the Spark side."""
    if not cols:
        return body
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS _q"

# --- features ----------------------------------------------------------------------
cte("fe_log", """
  SELECT *, ln(1 + CHURN) AS log_churn, ln(1 + NCLOC) AS log_ncloc,
         ln(1 + SQALE_INDEX) AS log_sqale_index, ln(1 + REF_COUNT) AS log_ref_count
  FROM cohort""")
cte("fe_imp", "SELECT * REPLACE (" + ", ".join(
    f"coalesce({m}, median({m}) OVER (PARTITION BY PROJECT_ID), (SELECT median({m}) FROM fe_log)) AS {m}"
    for m in MEAS) + ", " + ", ".join(
    f"coalesce({c}, 0.0) AS {c}" for c in ["log_churn", "log_ncloc", "log_sqale_index", "log_ref_count"])
    + ") FROM fe_log")
cte("fe_first", "SELECT * REPLACE (" + ", ".join(
    f"coalesce({m}, median({m}) OVER (PARTITION BY PROJECT_ID), (SELECT median({m}) FROM cohort)) AS {m}" for m in MEAS)
    + ") FROM cohort")
cte("modeling", """
  SELECT *, SQALE_DEBT_RATIO * HAS_REFACTORING AS TDR_x_REF,
         SQALE_DEBT_RATIO * log_ref_count AS TDR_x_REFCOUNT,
         CAST(dense_rank() OVER (ORDER BY PROJECT_ID) - 1 AS INTEGER) AS PROJECT_IDX,
         CAST(row_number() OVER (PARTITION BY PROJECT_ID ORDER BY AUTHOR_DATE, COMMIT_HASH) - 1 AS BIGINT) AS TIME_IDX
  FROM fe_imp""")
cte("pan0", """
  SELECT PROJECT_ID, CAST(date_trunc('month', AUTHOR_DATE) AS TIMESTAMP) AS PERIOD_START,
         avg(SQALE_DEBT_RATIO) AS TDR_mean, max(SQALE_DEBT_RATIO) AS TDR_max,
         sum(CHURN) AS CHURN_sum, avg(NCLOC) AS NCLOC_mean, count(COMMIT_HASH) AS N_COMMITS,
         CAST(sum(BIC) AS BIGINT) AS BIC_COUNT, sum(REF_COUNT) AS REF_COUNT_sum
  FROM fe_imp GROUP BY 1, 2""")
cte("pan_fwd", """
  SELECT p.PROJECT_ID, p.PERIOD_START,
         avg(CASE WHEN c.AUTHOR_DATE <= p.PERIOD_START + INTERVAL 30 DAY THEN c.BIC END) AS BIC_RATE_NEXT_30D,
         avg(CASE WHEN c.AUTHOR_DATE <= p.PERIOD_START + INTERVAL 60 DAY THEN c.BIC END) AS BIC_RATE_NEXT_60D,
         avg(CASE WHEN c.AUTHOR_DATE <= p.PERIOD_START + INTERVAL 90 DAY THEN c.BIC END) AS BIC_RATE_NEXT_90D
  FROM pan0 p LEFT JOIN fe_imp c
    ON c.PROJECT_ID = p.PROJECT_ID AND c.AUTHOR_DATE > p.PERIOD_START
   AND c.AUTHOR_DATE <= p.PERIOD_START + INTERVAL 90 DAY
  GROUP BY 1, 2""")
cte("panel_all", """
  SELECT p.*, strftime(p.PERIOD_START, '%Y-%m') AS PERIOD,
         CAST(BIC_COUNT AS DOUBLE) / N_COMMITS AS BIC_RATE,
         lag(TDR_mean) OVER (PARTITION BY p.PROJECT_ID ORDER BY p.PERIOD_START) AS TDR_LAG1,
         TDR_mean - lag(TDR_mean) OVER (PARTITION BY p.PROJECT_ID ORDER BY p.PERIOD_START) AS DELTA_TDR,
         ln(1 + CHURN_sum) AS log_churn_sum, ln(1 + NCLOC_mean) AS log_ncloc,
         f.BIC_RATE_NEXT_30D, f.BIC_RATE_NEXT_60D, f.BIC_RATE_NEXT_90D
  FROM pan0 p LEFT JOIN pan_fwd f ON p.PROJECT_ID = f.PROJECT_ID AND p.PERIOD_START = f.PERIOD_START""")
cte("qedges", "SELECT quantile_cont(SQALE_DEBT_RATIO, [0, 0.25, 0.5, 0.75, 1]) AS e FROM modeling")
cte("quart", """
  SELECT m.*, CASE WHEN SQALE_DEBT_RATIO IS NULL THEN NULL
                   WHEN SQALE_DEBT_RATIO <= e[2] THEN 1 WHEN SQALE_DEBT_RATIO <= e[3] THEN 2
                   WHEN SQALE_DEBT_RATIO <= e[4] THEN 3 ELSE 4 END AS quartile
  FROM modeling m, qedges""")
cte("qspine", """
  SELECT * FROM (VALUES (1, 'Q1 (Low TD)'), (2, 'Q2'), (3, 'Q3'), (4, 'Q4 (High TD)')) AS t(quartile, Q)""")

# --- split and evaluation -------------------------------------------------------------
cte("msplit", """
  SELECT m.*, CASE WHEN TIME_IDX < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split,
         n AS project_n
  FROM modeling m JOIN (SELECT PROJECT_ID, count(*) AS n FROM modeling GROUP BY 1) c USING (PROJECT_ID)""")
cte("mtrain", "SELECT * FROM msplit WHERE split = 'train'")
cte("scores_long", """
  SELECT f.model, c.COMMIT_HASH, c.BIC AS label,
         ((CAST(c.COMMIT_HASH AS BIGINT) * f.mult + c.BIC * f.w) % 1000) / CAST(1000 AS DOUBLE) AS score
  FROM cohort c, (VALUES ('M0_dummy', 7919, 0), ('M1_lr_baseline', 7907, 60), ('M2_lr_tdr_rq1', 7901, 90),
                         ('M3_lr_tdr_ref_rq2', 7883, 120), ('M4_random_forest', 7879, 140),
                         ('M5_xgboost', 7919, 150)) AS f(model, mult, w)""")
cte("sg", """
  SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM scores_long GROUP BY 1, 2""")
cte("sgc", """
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg,
         CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS P,
         CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS N
  FROM sg WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("m_auc", """
  SELECT model, CAST(sum(pos * (N - cum_neg + neg * 0.5)) AS DOUBLE) / (max(P) * max(N)) AS auc_roc
  FROM sgc GROUP BY model""")
cte("m_ap", """
  SELECT model, sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / max(P) AS average_precision
  FROM sgc GROUP BY model""")
cte("m_thr", """
  SELECT model,
    coalesce(CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE score >= 0.5), 0), 0.0) AS precision,
    coalesce(CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE label = 1), 0), 0.0) AS recall,
    coalesce(CAST(2 * count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE)
             / nullif(2 * count(*) FILTER (WHERE score >= 0.5 AND label = 1)
                      + count(*) FILTER (WHERE score >= 0.5 AND label = 0)
                      + count(*) FILTER (WHERE score < 0.5 AND label = 1), 0), 0.0) AS f1,
    avg((score - label) * (score - label)) AS brier, count(*) AS n_test, avg(CAST(label AS DOUBLE)) AS base_rate
  FROM scores_long GROUP BY model""")
cte("m_names", """
  SELECT * FROM (VALUES ('M0_dummy', 'M0: Dummy', 0), ('M1_lr_baseline', 'M1: LR Baseline', 1),
                        ('M2_lr_tdr_rq1', 'M2: LR + TDR (RQ1)', 2), ('M3_lr_tdr_ref_rq2', 'M3: LR + TDR + Ref (RQ2)', 3),
                        ('M4_random_forest', 'M4: Random Forest', 4), ('M5_xgboost', 'M5: XGBoost ★', 5))
  AS t(model, Display, sort_key)""")
cte("m_cmp", """
  SELECT a.model AS Model, coalesce(n.Display, a.model) AS Display, round(auc_roc, 4) AS AUC_ROC,
         round(average_precision, 4) AS AUC_PR, round(f1, 4) AS F1, round(precision, 4) AS Precision,
         round(recall, 4) AS Recall, round(brier, 4) AS Brier, n_test AS N_test, round(base_rate, 4) AS BIC_rate_test
  FROM m_auc a JOIN m_ap p USING (model) JOIN m_thr t USING (model) LEFT JOIN m_names n USING (model)""")
cte("m_cm", """
  SELECT model, l.label, p.predicted,
         (SELECT count(*) FROM scores_long s WHERE s.model = m.model AND s.label = l.label
            AND CAST(s.score >= 0.5 AS INTEGER) = p.predicted) AS n
  FROM (SELECT DISTINCT model FROM scores_long) m, (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(predicted)""")

cte("fx_projects", """
  SELECT 'org.apache:' || n_name AS PROJECT_ID, n_name AS NAME, r_name AS REGION
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
