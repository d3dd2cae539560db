"""Chronological split and training-set statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.functions.quantiles import join_null_safe, median_struct, quantile_table
from cohortlab.operators.features import time_index
from cohortlab.session import materialize


def chrono_split(df: DataFrame, test_ratio: float = config.TEST_SIZE_RATIO, group: str = "PROJECT_ID",
                 index: str = "TIME_IDX") -> DataFrame:
    """First ``floor(n * (1 - test_ratio))`` commits of each project train, the rest test.

    Uses the running time index (computed bucket-wise, so no whole-project
    sort); the per-project size is a grouped count joined back, NULL being a
    project like any other, so no row is lost.
    """
    if index not in df.columns:
        df = time_index(df, group=group, out=index)
    n = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    cut = F.floor(F.col("_n") * F.lit(1.0 - test_ratio))
    return (join_null_safe(df, n, [group])
              .withColumn("split", F.when(F.col(index) < cut, F.lit("train")).otherwise(F.lit("test")))
              .withColumnRenamed("_n", "project_n"))


def split_summary(split_df: DataFrame, label: str = config.TARGET) -> DataFrame:
    """n and label % per side."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                         (F.avg(label) * 100).alias("bic_pct"))


def class_weights(train: DataFrame, label: str = config.TARGET) -> DataFrame:
    """neg, pos, neg/pos (2 dp) and balanced weights n / (2 n_c)."""
    n = F.count(F.lit(1))
    neg = F.count_if(F.col(label) == 0)
    pos = F.count_if(F.col(label) == 1)
    return train.agg(n.alias("n"), neg.alias("neg"), pos.alias("pos"),
                     F.round(F.try_divide(neg.cast("double"), pos), 2).alias("scale_pos_weight"),
                     F.try_divide(n.cast("double"), neg * 2).alias("weight_neg"),
                     F.try_divide(n.cast("double"), pos * 2).alias("weight_pos"))


def standardize_params(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population SD per feature; a zero SD becomes scale 1."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}__m"),
                 F.stddev_pop(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}__s")]
    wide = train.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}__m`, `{f}__s`" for f in features)
    long = wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, mean, sd)")
    return long.withColumn("scale", F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")))


def train_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact train median per feature, the fill value of the alternative matrix builder."""
    found = quantile_table(train, features, [0.5]).select("_var", F.get("_q", F.lit(0)).alias("train_median"))
    wanted = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return wanted.join(found, wanted["feature"] == found["_var"], "left").select("feature", "train_median")


def fill_train_median(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL -> train median for each feature (I3), medians as scalar subqueries."""
    return (df.withColumn("_med", median_struct(train, features))
              .withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"_med.{f}")) for f in features}).drop("_med"))


def project_vocabulary(train: DataFrame, group: str = "PROJECT_ID", drop_first: bool = True) -> DataFrame:
    """Indicator columns for the sorted train projects, first dropped.

    One row per kept project: its 0-based indicator position and column name.
    """
    keys = train.select(group).filter(F.col(group).isNotNull()).distinct()
    v = keys.withColumn("_pos", F.row_number().over(Window.orderBy(group)) - 1)
    if drop_first:
        v = v.filter(F.col("_pos") > 0).withColumn("_pos", F.col("_pos") - 1)
    return v.select(group, F.col("_pos").cast("int").alias("dummy_index"),
                    F.concat(F.lit("proj_"), F.col(group)).alias("dummy_col"))


def project_dummies(df: DataFrame, vocab: DataFrame, group: str = "PROJECT_ID") -> DataFrame:
    """Per row, the index and name of its single active indicator (NULL = all zero)."""
    return df.join(vocab, on=group, how="left")
