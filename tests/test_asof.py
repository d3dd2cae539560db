import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators.asof import DAY_MICROS, asof_coverage, asof_join

L_SCHEMA = "k string, id string, t timestamp"
R_SCHEMA = "k string, key string, d timestamp, v double"


def T(s):
    return dt.datetime.fromisoformat(s)


def run(spark, left, right, **kw):
    l_ = spark.createDataFrame(left, L_SCHEMA)
    r = spark.createDataFrame(right, R_SCHEMA)
    out = asof_join(l_, r, by=["k"], left_on="t", right_on="d", payload=["d", "key", "v"], tiebreak=["key"], **kw)
    return {row["id"]: (row["key"], row["v"]) for row in out.collect()}


@pytest.mark.parametrize("bucket", [None, 0])
def test_exact_match_allowed_and_strict(spark, bucket):
    kw = {} if bucket is None else {"bucket_micros": bucket}
    left = [("p", "c1", T("2020-01-02 00:00:00"))]
    right = [("p", "a", T("2020-01-01 00:00:00"), 1.0), ("p", "b", T("2020-01-02 00:00:00"), 2.0)]
    assert run(spark, left, right, **kw) == {"c1": ("b", 2.0)}
    assert run(spark, left, right, allow_exact=False, **kw) == {"c1": ("a", 1.0)}


def test_tied_snapshots_largest_tiebreak_wins(spark):
    left = [("p", "c1", T("2020-01-05 00:00:00"))]
    right = [("p", "a", T("2020-01-02 00:00:00"), 1.0), ("p", "b", T("2020-01-02 00:00:00"), 2.0)]
    assert run(spark, left, right) == {"c1": ("b", 2.0)}
    assert run(spark, left, right, bucket_micros=0) == {"c1": ("b", 2.0)}


def test_before_first_snapshot_and_coverage(spark):
    left = [("p", "c1", T("2019-01-01 00:00:00")), ("p", "c2", T("2021-01-01 00:00:00")),
            ("q", "c3", T("2021-01-01 00:00:00")), (None, "c4", T("2021-01-01 00:00:00"))]
    right = [("p", "a", T("2020-01-01 00:00:00"), 1.0), (None, "z", T("2000-01-01 00:00:00"), 9.0)]
    assert run(spark, left, right) == {"c2": ("a", 1.0)}
    l_ = spark.createDataFrame(left, L_SCHEMA)
    r = spark.createDataFrame(right, R_SCHEMA)
    lk = asof_join(l_, r, ["k"], "t", "d", ["v"], how="left", matched_col="_matched")
    cov = asof_coverage(lk).first()
    assert (cov.total_commits, cov.linked, cov.unlinked) == (4, 1, 3)


def test_bucket_carry_three_months_back(spark):
    left = [("p", "c1", T("2020-04-15 12:00:00"))]
    right = [("p", "a", T("2020-01-10 00:00:00"), 1.0)]
    for b in (DAY_MICROS, 30 * DAY_MICROS, 0):
        assert run(spark, left, right, bucket_micros=b) == {"c1": ("a", 1.0)}


def test_random_against_pandas_merge_asof(spark):
    rnd = random.Random(7)
    base = T("2020-01-01 00:00:00")
    left, right = [], []
    for i in range(400):
        k = rnd.choice("abcd")
        left.append((k, f"c{i}", base + dt.timedelta(hours=rnd.randint(0, 24 * 200))))
    for i in range(150):
        k = rnd.choice("abcde")
        right.append((k, f"s{i:04d}", base + dt.timedelta(hours=rnd.randint(0, 24 * 200)), float(i)))
    got_b = run(spark, left, right)
    got_u = run(spark, left, right, bucket_micros=0)
    got_w = run(spark, left, right, bucket_micros=7 * DAY_MICROS)
    lp = pd.DataFrame(left, columns=["k", "id", "t"]).sort_values("t")
    rp = pd.DataFrame(right, columns=["k", "key", "d", "v"]).sort_values(["d", "key"])
    m = pd.merge_asof(lp, rp, left_on="t", right_on="d", by="k", direction="backward").dropna(subset=["v"])
    want = {r.id: (r.key, r.v) for r in m.itertuples()}
    assert got_b == want == got_u == got_w
    # never a snapshot after the commit
    l_ = spark.createDataFrame(left, L_SCHEMA)
    r = spark.createDataFrame(right, R_SCHEMA).repartition(7)
    out = asof_join(l_.repartition(3), r, ["k"], "t", "d", ["d", "v"])
    assert out.filter(F.col("d") > F.col("t")).count() == 0


def test_hot_instants_on_both_sides(spark):
    rnd = random.Random(3)
    base = T("2021-01-01 00:00:00")
    left, right = [], []
    for i in range(300):
        k = rnd.choice("ab")
        t = base if i % 3 == 0 else base + dt.timedelta(hours=rnd.randint(0, 24 * 30))   # a hot instant
        left.append((k, f"c{i}", t))
    for i in range(120):
        k = rnd.choice("abc")
        t = base if i % 4 == 0 else base + dt.timedelta(hours=rnd.randint(-24 * 5, 24 * 30))
        right.append((k, f"s{i:04d}", t, float(i)))
    for how in ("inner", "left"):
        for exact in (True, False):
            a = run(spark, left, right, how=how, allow_exact=exact, bucket_micros=None)
            b = run(spark, left, right, how=how, allow_exact=exact)
            assert a == b and len(b) == (300 if how == "left" else len(a))


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_split_a_burst_and_match(spark, many_ranges):
    rnd = random.Random(5)
    base = T("2022-06-01 10:00:00")
    left, right = [], []
    for i in range(500):
        k = "hot" if i % 5 else rnd.choice("xy")
        # the hot key bursts inside one hour (distinct seconds)
        t = base + dt.timedelta(seconds=rnd.randint(0, 3599)) if k == "hot" else \
            base + dt.timedelta(hours=rnd.randint(-200, 200))
        left.append((k, f"c{i}", t))
    for i in range(200):
        k = "hot" if i % 4 else rnd.choice("xyz")
        t = base + dt.timedelta(seconds=rnd.randint(-600, 3599)) if k == "hot" else \
            base + dt.timedelta(hours=rnd.randint(-300, 200))
        right.append((k, f"s{i:04d}", t, float(i)))
    for exact in (True, False):
        assert run(spark, left, right, allow_exact=exact) == run(spark, left, right, bucket_micros=0, allow_exact=exact)


def test_one_instant_spreads_over_ranges(spark, many_ranges):
    """All rows of one project at one instant: ranges are cut by the tiebreak, none above twice the median."""
    from pyspark.sql import Window

    from cohortlab.functions.ordering import place_in_group, write_ordered
    df = spark.range(8000).selectExpr("IF(id % 5 = 0, CAST(id % 3 AS STRING), 'hot') AS k", "sha(CAST(id AS STRING)) AS h",
                                      "TIMESTAMP'2020-01-01' AS t").withColumn("k", F.when(F.col("k") != "1", F.col("k")))
    order = [F.col("t").asc_nulls_last(), F.col("h").asc()]
    cut = write_ordered(df, ["k"], order)
    sizes = sorted(r["count"] for r in cut.groupBy("_part").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = place_in_group(cut, ["k"], "i", "n")
    w = Window.partitionBy("k")
    want = df.select("*", (F.row_number().over(w.orderBy("t", "h")) - 1).alias("j"), F.count("*").over(w).alias("m"))
    both = got.join(want, "h")
    assert set(got.columns) == {"k", "h", "t", "i", "n"} and both.count() == 8000
    assert both.filter("i <> j OR n <> m").count() == 0
