"""Preprocessing-stage queries (A, B, C, D1-D8)."""

from __future__ import annotations

from cohortlab.operators import profile
from cohortlab.operators.asof import asof_coverage
from cohortlab.plans.oracle import MEAS
from cohortlab.plans.registry import register

M = ", ".join(MEAS)


@register("commit_base", "SELECT * FROM base", ops="B8 C2 B2 B3 B1 D3")
def commit_base(s):
    return s.base


@register("churn", "SELECT * FROM churn", ops="D1 B6 B13")
def churn(s):
    return s.churn


@register("bic_labels", "SELECT * FROM bic", ops="B4 B5 B11 B12")
def bic_labels(s):
    return s.bic_labels


@register("ref_counts", "SELECT * FROM refs", ops="D2 B4")
def ref_counts(s):
    return s.refs


@register("snapshot_base", "SELECT * FROM snaps", doubles=MEAS, ops="C1 B9 C3 B3 B7")
def snapshot_base(s):
    return s.snapshots


@register("asof_link", "SELECT * FROM linked", doubles=MEAS, ops="C4 C5 G1")
def asof_link(s):
    return s.linked()


@register("asof_link_strict", "SELECT * FROM linked_strict", doubles=MEAS, ops="C4 S1")
def asof_link_strict(s):
    return s.linked(allow_exact=False)


@register("asof_coverage", """
  SELECT count(*) AS total_commits, count(DATE) AS linked, count(*) - count(DATE) AS unlinked,
         round(count(DATE) * 100.0 / count(*), 1) AS linked_pct,
         round((count(*) - count(DATE)) * 100.0 / count(*), 1) AS unlinked_pct
  FROM linked_all""", doubles=["linked_pct", "unlinked_pct"], ops="D8 S11")
def asof_coverage_q(s):
    return asof_coverage(s.linked(how="left", matched_col="_matched"))


@register("cohort", "SELECT * FROM cohort",
          doubles=MEAS + ["LINES_ADDED", "LINES_REMOVED", "CHURN", "REF_COUNT"], ops="C6 C7 C9 B6 B14")
def cohort(s):
    return s.cohort


@register("bic_by_project", """
  SELECT PROJECT_ID, count(*) AS N, CAST(sum(BIC) AS BIGINT) AS BIC_count, avg(BIC) AS BIC_rate,
         round(avg(BIC) * 100, 1) AS BIC_rate_pct
  FROM cohort GROUP BY PROJECT_ID""", doubles=["BIC_rate", "BIC_rate_pct"], ops="D7 F2 B13 H11")
def bic_by_project(s):
    return profile.bic_by_project(s.cohort)
