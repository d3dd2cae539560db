"""Input mapping: exact rounding, half months from sums per day, one shuffle of the line items."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_hundredths_round_half_away_from_zero(spark):
    xs = [None, 0.0, -0.0, 0.005, 0.015, 0.045, 0.07, 0.08, 0.105, 0.145, 0.285, 1.005, -0.005, -0.015, -0.145, 0.0049999999999999996,
          49.0, 50.0, 12345678.125, -12345678.125, 1e12 + 0.125]
    xs += [k / 1000 for k in range(-200, 200)]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    plain = F.round(F.col("x") * F.lit(100))
    got = d.select("x", plain.cast("bigint").alias("want"), fixtures._r100("x").alias("got"),
                   plain.alias("r"), (F.col("x") * 100 >= 7.5).alias("eight"), (F.col("x") * 100 >= 6.5).alias("seven")).collect()
    for r in got:
        assert r["got"] == r["want"], r
        if r["x"] is not None:
            assert r["eight"] == (r["r"] >= 8) and r["seven"] == (r["r"] >= 7), r


def _write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_half_months_of_null_and_repeated_keys(spark, tmp_path):
    day = lambda m, k: dt.datetime(2024, m, k, 13, 5)
    _write(spark, tmp_path,
           nation=([(1, "A"), (1, "A"), (2, "B")], "n_nationkey int, n_name string"),
           supplier=([(10, 1), (20, 2), (None, 2)], "s_suppkey bigint, s_nationkey int"),
           lineitem=([(s, t, 0.05, 0.08, 1, 7, 3.0) for s, t in [(10, day(1, 1)), (10, day(1, 14)), (10, day(1, 15)), (10, day(1, 31)),
                                                                (10, None), (20, day(2, 14)), (None, day(2, 14)), (99, day(2, 14))]],
                     "l_suppkey bigint, l_shipdate timestamp, l_discount double, l_tax double, l_linenumber int, l_partkey bigint, l_quantity double"))
    got = {(r["PROJECT_ID"][-1], r["ANALYSIS_KEY"]): (r["n"], r["d"], r["t"], r["ln"], r["pk"], r["q"])
           for r in fixtures._snap_raw(spark, str(tmp_path)).collect()}
    line = lambda n: (n, 5 * n, 8 * n, n, 7 * n, 3 * n)
    assert got == {("A", "20240101"): line(4), ("A", "20240115"): line(4), ("A", None): line(2), ("B", "20240201"): line(1)}


def test_line_items_are_shuffled_once(spark, monkeypatch):
    """Commits lie in buckets of the key that line items are dealt by, and the written table is dealt as the join left it."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    from cohortlab.session import materialize_bucketed
    plans = {}

    def stage(df, name, keys):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        plans[name] = df.repartition(n, *keys)._jdf.queryExecution().executedPlan().toString()
        return materialize_bucketed(df, name, keys)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert fixtures.raw_tables(spark, SF, stage)["changes"].count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\bExchange\b", plans["raw_lineitem_commits"])) == 1


def test_staged_lines_hold_only_what_the_three_tables_read(spark, tmp_path):
    """NULL flags, taxes, discounts and part keys included; a repeated line stays two rows."""
    lines = [(1, 7, 3.0, "R", "F", 0.07, 0.08), (1, 7, 3.0, "R", "F", 0.07, 0.08), (1, None, 4.0, "R", "F", 0.01, 0.1),
             (2, 8, 5.0, "N", "O", 0.08, 0.09), (2, 9, 6.0, None, "F", 0.07, 0.08), (3, 9, None, "A", "F", None, None), (4, 1, 1.0, "R", "F", 0.08, 0.08)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, l_linestatus string, "
                                 "l_tax double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    commits = spark.createDataFrame([("P", "1"), ("P", "2"), ("P", "3"), ("Q", "3")], "PROJECT_ID string, COMMIT_HASH string")
    li = fixtures.lineitem_commits(spark, str(tmp_path), commits)
    assert not {"l_discount", "l_tax", "l_returnflag", "l_partkey"} & set(li.columns)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(fixtures.changes(spark, "", li)) == sorted([("P", "1", 3, 7), ("P", "1", 3, 7), ("P", "1", 4, 1), ("P", "2", 5, None),
                                                             ("P", "2", 6, 7), ("P", "3", None, None), ("Q", "3", None, None)], key=str)
    assert rows(fixtures.szz(spark, "", li)) == sorted([("P", "7", "1"), ("P", "7", "1"), ("P", None, "1")], key=str)
    assert rows(fixtures.refactoring(spark, "", li)) == sorted([("P", "1", "RF"), ("P", "1", "RF"), ("P", "2", "NO"), ("P", "2", None)], key=str)
