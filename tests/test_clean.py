import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import assemble, clean


def T(s):
    return dt.datetime.fromisoformat(s)


def test_dedup_keep_first_earliest(spark):
    df = spark.createDataFrame([("p", "h", T("2020-02-01 00:00:00"), True), ("p", "h", T("2020-01-01 00:00:00"), False)],
                               "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp, IN_MAIN_BRANCH boolean")
    out = clean.dedup_keep_first(df, ["PROJECT_ID", "COMMIT_HASH"], ["AUTHOR_DATE"]).collect()
    assert len(out) == 1 and out[0].AUTHOR_DATE == T("2020-01-01 00:00:00") and out[0].IN_MAIN_BRANCH is False


def test_a_dated_duplicate_beats_an_undated_one(spark):
    df = spark.createDataFrame([("p", "h", None, True), ("p", "h", T("2020-01-01 00:00:00"), None)],
                               "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp, IN_MAIN_BRANCH boolean")
    out = clean.dedup_keep_first(df, ["PROJECT_ID", "COMMIT_HASH"], ["AUTHOR_DATE"]).collect()
    assert [(r.AUTHOR_DATE, r.IN_MAIN_BRANCH) for r in out] == [(T("2020-01-01 00:00:00"), None)]


def test_clip_keeps_null_and_nan_becomes_null(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (float("nan"),), (2.5,)], "SQALE_DEBT_RATIO double")
    got = [r[0] for r in clean.clip_measures(df, ["SQALE_DEBT_RATIO"]).collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] is None and got[3] == 2.5


def test_ref_counts_null_type_and_modes(spark):
    df = spark.createDataFrame([("p", "a", None), ("p", "b", "X"), ("p", "b", "X"), ("p", "b", "Y")],
                               "PROJECT_ID string, COMMIT_HASH string, REFACTORING_TYPE string")
    d = {r.COMMIT_HASH: (r.REF_COUNT, r.HAS_REFACTORING) for r in assemble.ref_counts(df).collect()}
    assert d == {"a": (0, 1), "b": (2, 1)}
    o = {r.COMMIT_HASH: r.REF_COUNT for r in assemble.ref_counts(df, mode="operations").collect()}
    assert o == {"a": 0, "b": 3}


def test_null_inducing_hash_is_not_a_label(spark):
    szz = spark.createDataFrame([("p", "f", None), ("p", "f", "h1"), ("p", "g", "h1")],
                                "PROJECT_ID string, FAULT_FIXING_COMMIT_HASH string, FAULT_INDUCING_COMMIT_HASH string")
    rows = assemble.bic_labels(szz).collect()
    assert [(r.COMMIT_HASH, r.BIC) for r in rows] == [("h1", 1)]


def test_mixed_date_parse_and_bad_value(spark):
    df = spark.createDataFrame([("2020-01-02T03:04:05Z",), ("2020-01-02 03:04:05+02:00",), ("2020-01-02",)], "d string")
    got = [r.d for r in clean.parse_dates(df, "d").collect()]
    assert got == [T("2020-01-02 03:04:05"), T("2020-01-02 01:04:05"), T("2020-01-02 00:00:00")]
    bad = spark.createDataFrame([("2020-01-02",), ("x",)], "d string")
    with pytest.raises(ValueError):
        clean.parse_dates(bad, "d")
    assert clean.parse_dates(bad, "d", on_bad="drop").count() == 1


def test_min_rows_semi_join(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "PROJECT_ID string")
    out = clean.keep_groups_with_min_rows(df, "PROJECT_ID", 3)
    assert sorted(r[0] for r in out.collect()) == ["a", "a", "a"]


def test_cohort_zero_fill(spark):
    linked = spark.createDataFrame([("p", "a"), ("p", "b")], "PROJECT_ID string, COMMIT_HASH string")
    ch = spark.createDataFrame([("p", "a", 1, 2, 3)], "PROJECT_ID string, COMMIT_HASH string, LINES_ADDED bigint, LINES_REMOVED bigint, CHURN bigint")
    lab = spark.createDataFrame([("p", "b", 1)], "PROJECT_ID string, COMMIT_HASH string, BIC int")
    ref = spark.createDataFrame([("p", "a", 0, 1)], "PROJECT_ID string, COMMIT_HASH string, REF_COUNT bigint, HAS_REFACTORING int")
    c = {r.COMMIT_HASH: r for r in assemble.assemble_cohort(linked, ch, lab, ref).collect()}
    assert c["b"].CHURN == 0.0 and c["a"].BIC == 0 and c["b"].BIC == 1 and c["b"].HAS_REFACTORING == 0
    assert c["a"].REF_COUNT == 0.0 and c["a"].HAS_REFACTORING == 1
    assert not math.isnan(c["b"].LINES_ADDED)


def test_blank_boolean_raises(spark, tmp_path):
    from cohortlab.sources import csv as csv_src
    p = tmp_path / "c.csv"
    p.write_text('MERGE,PROJECT_ID,COMMIT_HASH,AUTHOR_DATE,IN_MAIN_BRANCH,X\n'
                 'False,p,h1,2020-01-01,True,"a ""q"""\nmaybe,p,h2,2020-01-02,False,y\n')
    with pytest.raises(ValueError, match="MERGE.: 1"):
        csv_src.read_csv(spark, str(p), csv_src.COMMITS)
    p.write_text('MERGE,PROJECT_ID,COMMIT_HASH,AUTHOR_DATE,IN_MAIN_BRANCH,X\nFalse,p,h1,2020-01-01,True,"a ""q"""\n'
                 'NA,p,h2,N/A,False,y\n')
    rows = csv_src.read_csv(spark, str(p), csv_src.COMMITS).collect()
    assert rows[0].PROJECT_ID == "p" and rows[0].IN_MAIN_BRANCH is True and rows[1].MERGE is None
    assert rows[1].AUTHOR_DATE is None
