"""Logical study tables derived from the driver's TPC-H-style parquet tables.

The mapping (orders -> commits, lineitem -> file changes / fault links /
refactorings, lineitem x supplier -> quality snapshots) is pure DataFrame code;
every derived table grows linearly with the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.sources.tables import LazyTables

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

#: bucket column of commit tables: rows of one commit meet, and line items can be dealt by it before their project is known
KEY = ["COMMIT_HASH"]

_READS: dict[tuple[int, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table.

    The scan DataFrame is reused per (session, path): listing files and
    reading footers is paid once, and identical scans let Spark reuse
    exchanges inside one plan.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READS[key] = df
    return df


def _ts(c):
    # driver timestamps are zone-less; the study works in UTC (session zone)
    return F.col(c).cast("timestamp")


def _r100(c):
    # half away from zero, as ``round`` has it, but without a decimal number for each row; the fraction of a double is exact
    x = F.col(c) * F.lit(100)
    whole = x.cast("bigint")
    return whole + F.when(x - whole >= 0.5, 1).when(x - whole <= -0.5, -1).otherwise(0)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == n.n_nationkey))
    return j.select(
        F.concat(F.lit(config.PROJECT_PREFIX), F.col("n_name")).alias("PROJECT_ID"),
        F.col("o_orderkey").cast("string").alias("COMMIT_HASH"),
        _ts("o_orderdate").alias("AUTHOR_DATE"),
        (F.col("o_orderstatus") != F.lit("P")).alias("IN_MAIN_BRANCH"),
        (F.col("o_orderpriority") == F.lit("5-LOW")).alias("MERGE"),
    )


def lineitem_commits(spark: SparkSession, sf_dir: str, commits_df: DataFrame | None = None) -> DataFrame:
    """lineitem rows with their commit key: the one join the three line-level tables share.

    The line items are dealt by the commits' own bucket column, so commits that lie in buckets are
    not moved, and the result is already dealt as its buckets are.  The sort of the join leaves the
    rows of a commit side by side, which the aggregates over the written table are quicker on.
    Only what the three tables read is moved and written: ``fix`` and ``ref`` are NULL on lines that
    are no fault link or refactoring, ``removed`` on lines that remove nothing.
    """
    li = read_table(spark, sf_dir, "lineitem")
    fix = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
           & (F.col("l_discount") * 100 >= 7.5))   # rounds to 8 or more
    ref = F.col("l_tax") * 100 >= 6.5              # rounds to 7 or more
    li = li.select(
        "l_orderkey", "l_quantity",
        F.when(~F.col("l_returnflag").eqNullSafe("N"), F.col("l_tax")).alias("removed"),
        F.when(fix, F.struct(F.col("l_partkey").alias("key"))).alias("fix"),
        F.when(ref, F.struct(F.concat("l_returnflag", "l_linestatus").alias("type"))).alias("ref"))
    cm = commits_df if commits_df is not None else commits(spark, sf_dir)
    k = cm.select("PROJECT_ID", "COMMIT_HASH")
    return li.join(k, F.col("l_orderkey").cast("string") == F.col("COMMIT_HASH")).drop("l_orderkey")


def changes(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    j = li if li is not None else lineitem_commits(spark, sf_dir)
    return j.select(
        "PROJECT_ID", "COMMIT_HASH",
        F.col("l_quantity").cast("bigint").alias("LINES_ADDED"),
        _r100("removed").alias("LINES_REMOVED"),
    )


def szz(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    j = li if li is not None else lineitem_commits(spark, sf_dir)
    return j.filter(F.col("fix").isNotNull()).select(
        "PROJECT_ID",
        F.col("fix.key").cast("string").alias("FAULT_FIXING_COMMIT_HASH"),
        F.col("COMMIT_HASH").alias("FAULT_INDUCING_COMMIT_HASH"),
    )


def refactoring(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    j = li if li is not None else lineitem_commits(spark, sf_dir)
    return j.filter(F.col("ref").isNotNull()).select("PROJECT_ID", "COMMIT_HASH", F.col("ref.type").alias("REFACTORING_TYPE"))


def _snap_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_linenumber", "l_partkey",
        "l_quantity")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # sums per nation's number and day first: half months, names and keys are made for each group, not for each row
    days = (li.join(s, li.l_suppkey == s.s_suppkey)
              .groupBy("s_nationkey", F.col("l_shipdate").cast("date").alias("l_shipdate"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(_r100("l_discount")).alias("d"), F.sum(_r100("l_tax")).alias("t"),
                   F.sum("l_linenumber").alias("ln"), F.sum("l_partkey").alias("pk"),
                   F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
              .join(n, F.col("s_nationkey") == n.n_nationkey))
    # every ship date belongs to the snapshot of its half month, dated the 1st or 15th
    half = F.when(F.dayofmonth("l_shipdate") < 15, 1).otherwise(15)
    return (days.groupBy("n_name", F.make_date(F.year("l_shipdate"), F.month("l_shipdate"), half).alias("l_shipdate"))
             .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "d", "t", "ln", "pk", "q")])
             .select(F.concat(F.lit(config.PROJECT_PREFIX), F.col("n_name")).alias("PROJECT_ID"),
                     F.date_format("l_shipdate", "yyyyMMdd").alias("ANALYSIS_KEY"),
                     _ts("l_shipdate").alias("DATE"), "n", "d", "t", "ln", "pk", "q"))


def sonar_analysis(spark: SparkSession, sf_dir: str, snap: DataFrame | None = None) -> DataFrame:
    return (snap if snap is not None else _snap_raw(spark, sf_dir)).select(
        "PROJECT_ID", "ANALYSIS_KEY", "DATE", F.col("ANALYSIS_KEY").alias("REVISION"))


def sonar_measures(spark: SparkSession, sf_dir: str, snap: DataFrame | None = None) -> DataFrame:
    r = snap if snap is not None else _snap_raw(spark, sf_dir)
    dbl = lambda e: e.cast("double")
    return r.select(
        "PROJECT_ID", "ANALYSIS_KEY",
        F.when(F.col("n") % 5 == 0, F.lit(None).cast("double"))
         .otherwise(dbl(F.col("d")) / F.col("n")).alias("SQALE_DEBT_RATIO"),
        dbl(F.col("pk")).alias("SQALE_INDEX"),
        dbl(F.col("n")).alias("CODE_SMELLS"),
        dbl(F.col("ln")).alias("COMPLEXITY"),
        F.when(F.col("ln") % 3 == 0, F.lit(None).cast("double"))
         .otherwise(dbl(F.col("ln") * 2)).alias("COGNITIVE_COMPLEXITY"),
        dbl(F.col("t") - 4).alias("DUPLICATED_LINES_DENSITY"),
        F.when(F.col("q") % 11 == 0, F.lit(None).cast("double"))
         .otherwise(dbl(F.col("q"))).alias("NCLOC"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project list (inventory only, like the study's project export)."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
             .select(F.concat(F.lit(config.PROJECT_PREFIX), F.col("n_name")).alias("PROJECT_ID"),
                     F.col("n_name").alias("NAME"), F.col("r_name").alias("REGION")))


def raw_tables(spark: SparkSession, sf_dir: str, stage=None) -> LazyTables:
    """The seven logical raw inputs of the study, keyed like its loader.

    ``stage(df, name, keys)`` (optional) writes the three shared intermediates (no keys: not in buckets) --
    commits, lineitem joined to its commit, half-month snapshot sums -- when one of
    their tables is first asked for, so the fixture joins run once; the seven tables
    are projections of them.
    """
    st = stage or (lambda d, _name, _keys: d)
    shared = LazyTables({
        "commits": lambda: st(commits(spark, sf_dir), "raw_commits", KEY),
        "lines": lambda: st(lineitem_commits(spark, sf_dir, shared["commits"]), "raw_lineitem_commits", KEY),
        "snapshots": lambda: st(_snap_raw(spark, sf_dir), "raw_snapshots", []),
    })
    return LazyTables({
        "commits": lambda: shared["commits"],
        "changes": lambda: changes(spark, sf_dir, shared["lines"]),
        "projects": lambda: projects(spark, sf_dir),
        "szz": lambda: szz(spark, sf_dir, shared["lines"]),
        "refactoring": lambda: refactoring(spark, sf_dir, shared["lines"]),
        "sonar_analysis": lambda: sonar_analysis(spark, sf_dir, shared["snapshots"]),
        "sonar_measures": lambda: sonar_measures(spark, sf_dir, shared["snapshots"]),
    })


def study_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The driver's tables that the study's inputs are mapped from."""
    return [read_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")]


def driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf_dir, t) for t in DRIVER_TABLES}


# Deterministic score fixture: per model, score = ((hash * mult + label * w) mod 1000) / 1000.
# Ties, both classes and probabilities in [0, 1) without any training.
SCORE_FIXTURE = [
    ("M0_dummy", 7919, 0),
    ("M1_lr_baseline", 7907, 60),
    ("M2_lr_tdr_rq1", 7901, 90),
    ("M3_lr_tdr_ref_rq2", 7883, 120),
    ("M4_random_forest", 7879, 140),
    ("M5_xgboost", 7919, 150),
]


def fixture_scores(cohort: DataFrame, key: str = "COMMIT_HASH", label: str = "BIC") -> DataFrame:
    """Long (model, key, label, score) table over every cohort row for every fixture model."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).cast("bigint").alias("mult"),
                                F.lit(w).cast("bigint").alias("w")) for m, a, w in SCORE_FIXTURE])
    d = cohort.select(F.col(key), F.col(label).cast("int").alias("label"), F.inline(models))
    score = ((F.col(key).cast("bigint") * F.col("mult") + F.col("label") * F.col("w")) % 1000) / F.lit(1000.0)
    return d.select("model", key, "label", score.alias("score"))


def csv_roundtrip(df: DataFrame, path: str, extra_col: str = "EXTRA_COL", extra: str = 'say "hi", ok') -> None:
    """Write ``df`` as an export-style CSV: columns in reversed order, one extra
    column, values quoted where needed (test input for the typed CSV reader)."""
    cols = list(reversed(df.columns))
    out = df.select(*[F.col(c).cast("string").alias(c) for c in cols],
                    F.lit(extra).alias(extra_col))
    out.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", False) \
       .option("nullValue", "NA").csv(path)
