"""Quantile buckets and rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab import config
from cohortlab.functions.quantiles import quantile_values
from cohortlab.functions.scalar import rate_bucket, short_project


def quantile_edges(df: DataFrame, col: str, q: int = 4) -> list[float]:
    """Exact, linearly interpolated edges at 0, 1/q, ..., 1 (no single-task value map)."""
    return quantile_values(df, [col], [i / q for i in range(q + 1)])[col]


def qcut(df: DataFrame, col: str, q: int = 4, out: str = "quartile") -> DataFrame:
    """Equal-frequency buckets 1..q like ``qcut``: right-closed, lowest edge included.

    Duplicate edges raise ``ValueError`` as qcut does.  NULL values get a NULL bucket.
    """
    e = quantile_edges(df, col, q)
    if e[0] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    if any(a >= b for a, b in zip(e, e[1:])):
        raise ValueError(f"duplicate quantile edges for {col}: {e}")
    x = F.col(col)
    b = F.when(x <= F.lit(e[1]), F.lit(1))
    for i in range(2, q):
        b = b.when(x <= F.lit(e[i]), F.lit(i))
    b = b.otherwise(F.lit(q))
    return df.withColumn(out, F.when(x.isNull(), F.lit(None).cast("int")).otherwise(b))


def _spine(spark: SparkSession, q: int, labels: list[str]) -> DataFrame:
    # literal table of q rows (fixed size): bucket number and label
    schema = T.StructType([T.StructField("quartile", T.IntegerType()), T.StructField("Q", T.StringType())])
    return spark.createDataFrame([(i + 1, labels[i]) for i in range(q)], schema)


def rate_by_quartile(df: DataFrame, col: str = "SQALE_DEBT_RATIO", label: str = "BIC") -> DataFrame:
    """Label rate, rate % and n per quartile; all four kept even if empty."""
    qd = qcut(df.select(col, label), col)
    agg = qd.filter(F.col("quartile").isNotNull()).groupBy("quartile").agg(
        F.avg(label).alias("BIC_rate"), F.count(F.lit(1)).alias("n"))
    sp = F.broadcast(_spine(df.sparkSession, 4, config.QUARTILE_LABELS))
    return (sp.join(agg, on="quartile", how="left")
              .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))
              .withColumn("pct", F.col("BIC_rate") * 100)
              .orderBy("quartile"))


def rate_by_quartile_and_flag(df: DataFrame, col: str = "SQALE_DEBT_RATIO", flag: str = "HAS_REFACTORING",
                              label: str = "BIC") -> DataFrame:
    """Rate % per quartile x flag (0/1), pivoted; a missing cell is 0."""
    qd = qcut(df.select(col, flag, label), col)
    g = (qd.filter(F.col("quartile").isNotNull())
           .groupBy("quartile").pivot(flag, [0, 1]).agg((F.avg(label) * 100).alias("pct")))
    g = g.withColumnsRenamed({"0": "pct_no_refactoring", "1": "pct_has_refactoring"})
    sp = F.broadcast(_spine(df.sparkSession, 4, config.QUARTILE_LABELS))
    return (sp.join(g, on="quartile", how="left")
              .na.fill(0.0, ["pct_no_refactoring", "pct_has_refactoring"])
              .orderBy("quartile"))


def project_rate_buckets(df: DataFrame, key: str = "PROJECT_ID", label: str = "BIC") -> DataFrame:
    """Per-project rate %, short name, three-way bucket, and the unweighted mean of rates."""
    ps = (df.groupBy(key).agg(F.avg(label).alias("mean"), F.count(F.lit(1)).alias("count"))
            .withColumn("pct", F.col("mean") * 100)
            .withColumn("short_name", short_project(key))
            .withColumn("bucket", rate_bucket("pct")))
    # window over the aggregated table: one row per project
    return (ps.withColumn("mean_of_rates_pct", F.avg("pct").over(Window.partitionBy()))
              .orderBy("pct", key))
