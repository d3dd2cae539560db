"""Tables with a row per group are written before they are joined: few groups don't move the rows, however many these are."""

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cohortlab.operators import asof, clean, features, split
from cohortlab.session import materialize, materialize_bucketed

N = 20_000


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + (k % 40) * 86_400)
    return materialize(spark.range(N).select(
        F.when(k % 7 > 0, F.concat(F.lit("a long name of a project "), (k % 7).cast("string"))).alias("PROJECT_ID"),
        F.sha2(k.cast("string"), 256).alias("COMMIT_HASH"), day.alias("AUTHOR_DATE"),
        F.when(k % 5 > 0, k.cast("double")).alias("NCLOC")), "rows")


@pytest.fixture
def small_broadcasts(spark):
    """Less than the groups' share of the rows, more than the written groups."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _snapshots(spark):
    rows = [(f"a long name of a project {p}", dt.datetime(2023, 11, 1 + d), f"{d}", float(d)) for p in range(1, 7) for d in (0, 20)]
    return spark.createDataFrame(rows, "PROJECT_ID string, DATE timestamp, ANALYSIS_KEY string, SIZE double")


WORK = {
    "kept groups": lambda d: clean.keep_groups_with_min_rows(d, "PROJECT_ID", 50),
    "medians": lambda d: features.impute_group_median(d, ["NCLOC"]),
    "codes": features.dense_code,
    "running index": features.time_index,
    "split": lambda d: split.chrono_split(d.withColumn("TIME_IDX", F.length("COMMIT_HASH"))),
    "as-of": lambda d: asof.asof_join(d, _snapshots(d.sparkSession), ["PROJECT_ID"], "AUTHOR_DATE", "DATE", ["SIZE"], ["ANALYSIS_KEY"], how="left"),
}


@pytest.mark.parametrize("name", WORK)
def test_few_groups_do_not_move_the_rows(rows, small_broadcasts, name):
    out = WORK[name](rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    n = rows.filter(F.col("PROJECT_ID").isNotNull()).count() if name == "kept groups" else N
    assert out.count() == n


def test_bucket_write_keeps_rows_and_needs_no_sort(spark, rows, monkeypatch):
    seen, save = [], DataFrameWriter.saveAsTable

    def spy(self, *a, **k):
        seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return save(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", spy)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    t = materialize_bucketed(rows, "bucketed", ["COMMIT_HASH"])
    assert int(seen[0]) > 0 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert t.count() == N and t.exceptAll(rows).count() == 0
    assert len(t.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Exchange" not in t.groupBy("COMMIT_HASH").count()._jdf.queryExecution().executedPlan().toString()


def test_modeling_table_is_read_from_the_ordered_rows(spark, rows, monkeypatch):
    """The running index writes the rows in order; the modeling table is not written a second time."""
    from cohortlab.functions import ordering
    from cohortlab.plans import study
    names = []
    for mod in (study, ordering):
        monkeypatch.setattr(mod, "materialize", lambda d, name: names.append(name) or materialize(d, name))
    s = study.Study(spark, raw={})
    wanted = {c: F.lit(1.0) for c in ("SQALE_DEBT_RATIO", "DUPLICATED_LINES_DENSITY", "log_churn", "log_ncloc", "log_sqale_index",
                                      "log_ref_count")}
    s.__dict__["imputed"] = rows.withColumns(wanted).withColumn("HAS_REFACTORING", F.lit(1))
    m = s.modeling
    assert m.count() == N and names.count("index") == 1 and "modeling_ready" not in names
    sizes = {r["PROJECT_ID"]: r["n"] for r in m.groupBy("PROJECT_ID").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in m.groupBy("PROJECT_ID").agg(F.min("TIME_IDX").alias("lo"), F.max("TIME_IDX").alias("hi"), F.countDistinct("TIME_IDX").alias("k")).collect():
        assert (r["lo"], r["hi"], r["k"]) == (0, sizes[r["PROJECT_ID"]] - 1, sizes[r["PROJECT_ID"]])


def test_asof_left_rows_are_reduced_without_a_sort(rows, monkeypatch):
    """The left side's instants are distinct keys, hashed; only the right rows carry a payload."""
    from cohortlab.functions import ordering
    plans = []
    monkeypatch.setattr(ordering, "materialize", lambda d, name: plans.append(
        d._jdf.queryExecution().executedPlan().toString()) or materialize(d, name))
    snaps = _snapshots(rows.sparkSession)
    out = asof.asof_join(rows, snaps, ["PROJECT_ID"], "AUTHOR_DATE", "DATE", ["SIZE"], ["ANALYSIS_KEY"], how="left")
    assert "Union" not in plans[0] and plans[0].count("SortAggregate") == 2   # partial and final, of the right side alone
    pairs = rows.join(snaps, "PROJECT_ID", "left").filter("DATE <= AUTHOR_DATE").groupBy("COMMIT_HASH").agg(
        F.max_by("SIZE", "DATE").alias("want"))
    wrong = out.join(pairs, "COMMIT_HASH", "left").filter(~F.col("SIZE").eqNullSafe(F.col("want")))
    assert out.count() == N and wrong.count() == 0


def test_imputed_rows_are_written_once(spark, rows, monkeypatch):
    """A study asked for the modeling table writes the imputed rows in their order only; either order gives the same rows."""
    from cohortlab.functions import ordering
    from cohortlab.plans import study
    names = []
    for mod in (study, ordering):
        monkeypatch.setattr(mod, "materialize", lambda d, name: names.append(name) or materialize(d, name))
    wanted = {c: F.col("NCLOC") for c in ("SQALE_DEBT_RATIO", "DUPLICATED_LINES_DENSITY", "SQALE_INDEX", "CHURN", "REF_COUNT")}
    cohort = rows.withColumns(wanted).withColumn("HAS_REFACTORING", F.lit(1))
    first, second = study.Study(spark, raw={}), study.Study(spark, raw={})
    for s in (first, second):
        s.__dict__["cohort"] = cohort
    modeling = first.modeling
    assert names.count("index") == 1 and "imputed" not in names
    late = first.imputed
    assert "imputed" not in names
    early = second.imputed
    assert names.count("imputed") == 1 and late.columns == early.columns
    assert early.count() == N and early.exceptAll(late).count() == 0
    assert second.modeling.count() == N and second.modeling.exceptAll(modeling).count() == 0
