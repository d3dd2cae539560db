import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.operators import buckets, features, panel, split


def T(s):
    return dt.datetime.fromisoformat(s)


def test_group_median_then_global_fallback(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), ("b", None), ("c", 10.0)],
                               "PROJECT_ID string, NCLOC double")
    out = features.impute_group_median(df, ["NCLOC"]).collect()
    got = sorted((r.PROJECT_ID, r.NCLOC) for r in out)
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 3.0), ("b", 3.0), ("c", 10.0)]


def test_log_before_imputation(spark):
    df = spark.createDataFrame([("a", None, 0.0, 1.0, 0.0), ("a", 4.0, 0.0, 1.0, 0.0)],
                               "PROJECT_ID string, NCLOC double, CHURN double, SQALE_INDEX double, REF_COUNT double")
    r = features.imputed_cohort(df).orderBy("log_ncloc").first()
    assert r.NCLOC == 4.0 and r.log_ncloc == 0.0


def test_dense_code_and_time_index(spark):
    rows = [("b", "h1", T("2020-01-02 00:00:00")), ("a", "h2", T("2020-01-01 00:00:00")),
            ("a", "h3", T("2020-01-01 00:00:00")), ("a", "h0", T("2020-03-01 00:00:00")),
            (None, "h4", T("2020-01-01 00:00:00"))]
    df = spark.createDataFrame(rows, "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp")
    codes = {r.COMMIT_HASH: r.PROJECT_IDX for r in features.dense_code(df).collect()}
    assert codes == {"h1": 1, "h2": 0, "h3": 0, "h0": 0, "h4": -1}
    ti = {r.COMMIT_HASH: r.TIME_IDX for r in features.time_index(df).collect()}
    assert ti == {"h2": 0, "h3": 1, "h0": 2, "h1": 0, "h4": 0}
    undated = df.union(spark.createDataFrame([("a", "h9", None), (None, "h8", None)], df.schema))
    got = {r.COMMIT_HASH: r.TIME_IDX for r in features.time_index(undated).collect()}
    assert got == ti | {"h9": 3, "h8": 1}


def test_running_index_matches_row_number(spark):
    rng = np.random.default_rng(1)
    base = T("2020-01-01 00:00:00")
    rows = [(str(rng.integers(0, 3)), f"h{i}", base + dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 40))))
            for i in range(500)]
    df = spark.createDataFrame(rows, "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp")
    got = features.time_index(df)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("PROJECT_ID").orderBy("AUTHOR_DATE", "COMMIT_HASH")) - 1)
    j = got.join(want, ["PROJECT_ID", "COMMIT_HASH"])
    assert j.filter(F.col("w") != F.col("TIME_IDX")).count() == 0 and j.count() == 500


@pytest.mark.parametrize("n,train", [(1, 0), (4, 3), (5, 4), (9, 7), (10, 8)])
def test_split_sizes(spark, n, train):
    base = T("2020-01-01 00:00:00")
    rows = [("p", f"h{i:02d}", base + dt.timedelta(days=i)) for i in range(n)]
    df = spark.createDataFrame(rows, "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp")
    sp = split.chrono_split(df)
    assert sp.filter("split = 'train'").count() == train
    if train:
        mx = sp.filter("split = 'train'").agg(F.max("AUTHOR_DATE")).first()[0]
        mn = sp.filter("split = 'test'").agg(F.min("AUTHOR_DATE")).first()[0]
        assert mx <= mn


def _commits(spark, rows):
    return spark.createDataFrame(rows, "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp, BIC int")


def test_forward_window_edges(spark):
    t0 = T("2020-03-01 00:00:00")
    us = dt.timedelta(microseconds=1)
    rows = [("p", "a", t0, 1), ("p", "b", t0 + us, 0), ("p", "c", t0 + dt.timedelta(days=30), 0),
            ("p", "d", t0 + dt.timedelta(days=30) + us, 1)]
    f = panel.forward_rates(_commits(spark, rows), taus=[30]).filter(F.col("PERIOD_START") == t0).first()
    assert f.BIC_RATE_NEXT_30D == 0.0           # only b and c are inside (t0, t0 + 30 d]


def test_forward_window_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = T("2020-01-01 00:00:00")
    rows = [(str(rng.integers(0, 2)), f"h{i}", base + dt.timedelta(hours=int(rng.integers(0, 24 * 400))),
             int(rng.integers(0, 2))) for i in range(600)]
    df = _commits(spark, rows)
    got = {(r.PROJECT_ID, r.PERIOD_START): (r.BIC_RATE_NEXT_30D, r.BIC_RATE_NEXT_90D)
           for r in panel.forward_rates(df, taus=[30, 90]).collect()}
    anchors = {(p, t.replace(day=1, hour=0, minute=0, second=0)) for p, _, t, _ in rows}
    for p, a in anchors:
        for tau, idx in ((30, 0), (90, 1)):
            ys = [y for q, _, t, y in rows if q == p and a < t <= a + dt.timedelta(days=tau)]
            want = sum(ys) / len(ys) if ys else None
            have = got.get((p, a), (None, None))[idx]
            assert (want is None and have is None) or abs(want - have) < 1e-12


def test_forward_rates_copy_no_commit(spark, monkeypatch):
    from cohortlab.functions import ordering
    plans, keep = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    rows = [("p", f"h{i}", T("2020-01-01 00:00:00") + dt.timedelta(days=i % 90), i % 2) for i in range(400)] + [(None, "n", None, 1)]
    out = panel.forward_rates(_commits(spark, rows), taus=[30, 60])
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert not any("explode" in p.lower() or "Generate" in p for p in plans)
    assert {r.PERIOD_START.month for r in out.collect()} == {1, 2, 3}


def test_forward_window_from_the_next_month(spark):
    rows = [("p", "a", T("2020-01-10 00:00:00"), 1), ("p", "b", T("2020-02-01 00:00:00"), 1),
            ("p", "c", T("2020-02-20 00:00:00"), 0), ("p", "d", T("2020-03-02 00:00:00"), 1)]
    f = {r.PERIOD_START.month: r.BIC_RATE_NEXT_30D for r in
         panel.forward_rates(_commits(spark, rows), taus=[30], anchor="period_end").collect()}
    assert f == {1: 0.5, 2: 1.0, 3: None}       # (1 Feb, 2 Mar], (1 Mar, 31 Mar], (1 Apr, 1 May]


def test_month_gap_lag_and_empty_window(spark):
    rows = [("p", "a", T("2020-01-10 00:00:00"), 1), ("p", "b", T("2020-03-10 00:00:00"), 0),
            ("p", "c", T("2020-05-01 00:00:00"), 1)]
    df = _commits(spark, rows).withColumns({"SQALE_DEBT_RATIO": F.lit(1.0), "CHURN": F.lit(1.0),
                                            "NCLOC": F.lit(1.0), "REF_COUNT": F.lit(0.0)})
    df = df.withColumn("SQALE_DEBT_RATIO", F.when(F.col("COMMIT_HASH") == "b", 3.0).otherwise(1.0))
    p = {r.PERIOD: r for r in panel.panel_with_forward(df).collect()}
    assert p["2020-03"].TDR_LAG1 == 1.0 and p["2020-03"].DELTA_TDR == 2.0
    assert p["2020-03"].BIC_RATE_NEXT_30D == 0.0 and p["2020-01"].BIC_RATE_NEXT_30D == 1.0
    # the only May commit sits exactly at the anchor instant: window (t0, t0 + 30 d] is empty
    assert p["2020-05"].BIC_RATE_NEXT_30D is None


def test_qcut_matches_numpy_and_duplicate_edges_raise(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=401).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r.quartile for r in buckets.qcut(df, "v").orderBy("v").collect()]
    e = np.quantile(x, [0, .25, .5, .75, 1])
    want = [int(np.searchsorted(e[1:-1], v, side="left")) + 1 for v in sorted(x)]
    assert got == want
    dup = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "v double")
    with pytest.raises(Exception):
        buckets.qcut(dup, "v").collect()


def test_empty_quartile_kept(spark):
    rows = [(float(i), i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "SQALE_DEBT_RATIO double, BIC int")
    out = buckets.rate_by_quartile(df).collect()
    assert [r.quartile for r in out] == [1, 2, 3, 4] and sum(r.n for r in out) == 8


def test_quantiles_with_heavy_tie_equal_numpy(spark):
    from cohortlab.functions.quantiles import quantile_values
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.zeros(1500), rng.exponential(size=800) * 1e6])
    df = spark.createDataFrame([(float(v), 1e8 + float(v), None) for v in x] + [(float("nan"), None, None)],
                               "v double, w double, n double")
    probs = [0, .25, .5, .75, 1, 0.3333]
    got = quantile_values(df, ["v", "w", "n"], probs)
    assert np.allclose(got["v"], np.quantile(x, probs), rtol=0, atol=1e-9)
    assert np.allclose(got["w"], np.quantile(1e8 + x, probs), rtol=1e-15)
    assert got["n"] == [None] * 6


def test_grouped_quantiles_equal_pandas_with_a_hot_tied_group(spark):
    import pandas as pd
    from cohortlab.functions.quantiles import grouped_medians, grouped_quantiles
    rng = np.random.default_rng(8)
    g = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))
    v = np.where(rng.random(3000) < 0.2, 0.0, rng.normal(size=3000) * 100)
    df = spark.createDataFrame([(str(a) if a != "c" else None, float(b)) for a, b in zip(g, v)], "g string, v double")
    frame = pd.DataFrame({"g": g, "v": v})
    want = frame.groupby("g")["v"].quantile([0.25, 0.5]).unstack()
    got = {r["g"] or "c": r["_q"] for r in grouped_quantiles(df, ["g"], ["v"], [0.25, 0.5]).collect()}
    med = {r["g"] or "c": r["m_v"] for r in grouped_medians(df, ["g"], ["v"], "m_").collect()}
    for k in want.index:
        assert np.allclose(got[k], want.loc[k].to_numpy(), atol=1e-9) and abs(med[k] - want.loc[k, 0.5]) < 1e-9


def test_nothing_stays_persisted(spark):
    from cohortlab.functions.quantiles import quantile_values
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "PROJECT_ID string, SQALE_DEBT_RATIO double")
    features.impute_group_median(df, ["SQALE_DEBT_RATIO"]).collect()
    quantile_values(df, ["SQALE_DEBT_RATIO"], [0.5])
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_rows_without_project_or_date_survive_split_and_index(spark):
    from cohortlab.operators import split
    rows = [("a", f"h{i}", T("2020-01-01 00:00:00") + dt.timedelta(days=i)) for i in range(5)]
    rows += [("a", "h9", None), (None, "n1", T("2020-01-01 00:00:00")), (None, "n2", None)]
    df = spark.createDataFrame(rows, "PROJECT_ID string, COMMIT_HASH string, AUTHOR_DATE timestamp")
    got = {r.COMMIT_HASH: (r.TIME_IDX, r.split) for r in split.chrono_split(df).collect()}
    assert len(got) == len(rows)
    assert got["h9"] == (5, "test") and got["n1"] == (0, "train") and got["n2"] == (1, "test")
