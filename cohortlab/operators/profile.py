"""Summaries and report tables.

All are aggregates with a partial (map-side) step; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.quantiles import grouped_medians, grouped_quantiles, quantile_table
from cohortlab.functions.scalar import short_project
from cohortlab.operators.comoments import pair_moments


def bic_by_project(cohort: DataFrame, key: str = "PROJECT_ID", label: str = "BIC") -> DataFrame:
    """Per-project N, positives, rate and rate % (1 dp), highest rate first."""
    return (cohort.groupBy(key)
                  .agg(F.count(F.lit(1)).alias("N"),
                       F.sum(label).cast("bigint").alias("BIC_count"),
                       F.avg(label).alias("BIC_rate"))
                  .withColumn("BIC_rate_pct", F.round(F.col("BIC_rate") * 100, 1))
                  .orderBy(F.col("BIC_rate").desc(), F.col(key)))


def _summary(df: DataFrame, col: str, prefix: str) -> DataFrame:
    med = quantile_table(df, [col], [0.5]).select(F.get("_q", F.lit(0))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_commits"),
                  F.first(med).alias(f"{prefix}_median"),
                  F.avg(col).alias(f"{prefix}_mean"),
                  F.max(col).alias(f"{prefix}_max"))


def churn_summary(churn_df: DataFrame) -> DataFrame:
    """Median, mean and max of CHURN over the per-commit churn table."""
    return _summary(churn_df, "CHURN", "churn")


def ref_count_summary(refs: DataFrame) -> DataFrame:
    """Median, mean and max of REF_COUNT over commits with refactoring rows."""
    return _summary(refs, "REF_COUNT", "ref_count")


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Size, projects, label and flag counts and rates, date range."""
    return cohort.agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.countDistinct("PROJECT_ID").alias("n_projects"),
        F.sum("BIC").cast("bigint").alias("n_bic"),
        (F.avg("BIC") * 100).alias("bic_pct"),
        F.count_if(F.col("BIC") == 0).alias("n_non_bic"),
        F.sum("HAS_REFACTORING").cast("bigint").alias("n_refactoring"),
        (F.avg("HAS_REFACTORING") * 100).alias("refactoring_pct"),
        F.to_date(F.min("AUTHOR_DATE")).alias("first_date"),
        F.to_date(F.max("AUTHOR_DATE")).alias("last_date"))


def project_report(df: DataFrame, key: str = "PROJECT_ID") -> DataFrame:
    """Table 2: per-project counts, rate % (2 dp), medians; short names; highest rate first."""
    t = (df.groupBy(key)
           .agg(F.count("COMMIT_HASH").alias("N_Commits"),
                F.sum("BIC").cast("bigint").alias("N_BIC"),
                F.round(F.avg("BIC") * 100, 2).alias("BIC_Rate_pct"),
                F.sum("HAS_REFACTORING").cast("bigint").alias("N_Refactoring")))
    med = (grouped_medians(df, [key], ["SQALE_DEBT_RATIO", "CHURN"], out_prefix="_m_")
           .withColumnsRenamed({"_m_SQALE_DEBT_RATIO": "TDR_Median", "_m_CHURN": "Churn_Median"}))
    t = t.join(med, on=key, how="left").select(key, "N_Commits", "N_BIC", "BIC_Rate_pct", "TDR_Median",
                                               "Churn_Median", "N_Refactoring")
    return (t.orderBy(F.col("BIC_Rate_pct").desc(), F.col(key))
             .withColumn(key, short_project(key)))


def describe_by_label(df: DataFrame, variables: Sequence[str], label: str = "BIC") -> DataFrame:
    """Table 1: N, mean, median, SD, min, max (4 dp) and missing % (2 dp) per variable
    for label = 0, label = 1 and all rows (D10).

    The variables are unpivoted to (Variable, value); the moments come from one
    aggregate with grouping sets ((Variable, label), (Variable)), the exact
    medians of the same sets from one ``grouped_quantiles`` (no unbounded value map).
    """
    variables = [v for v in variables if v in df.columns]
    long = (df.select(F.col(label).alias("_g"), *[F.col(v).cast("double").alias(v) for v in variables])
              .unpivot("_g", variables, "Variable", "value"))
    r4 = lambda c: F.round(c, 4)
    # each row counts for its label and for all rows
    both = (df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_all"), F.col(label).alias("_l"), *variables)
              .withColumn("_g", F.when(F.col("_all") == 0, F.col("_l"))))
    med = (grouped_quantiles(both, ["_all", "_g"], variables, [0.5])
           .select("_all", "_g", F.col("_var").alias("Variable"), F.get("_q", F.lit(0)).alias("_m_value")))
    agg = (long.groupingSets([["Variable", "_g"], ["Variable"]], "Variable", "_g")
               .agg(F.grouping("_g").alias("_all"),
                    F.count("value").alias("N"),
                    r4(F.avg("value")).alias("Mean"),
                    r4(F.stddev_samp("value")).alias("SD"),
                    r4(F.min("value")).alias("Min"),
                    r4(F.max("value")).alias("Max"),
                    F.round(F.avg(F.col("value").isNull().cast("double")) * 100, 2).alias("Missing_pct")))
    a = agg.withColumn("_all", F.col("_all").cast("int")).alias("a")
    m = med.alias("m")
    agg = a.join(m, on=[F.col("a.Variable") == F.col("m.Variable"), F.col("a._all") == F.col("m._all"),
                        F.col("a._g").eqNullSafe(F.col("m._g"))], how="left").select("a.*", F.col("m._m_value"))
    grp = F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.concat(F.lit(f"{label}="), F.col("_g").cast("string")))
    return agg.select("Variable", grp.alias("Group"), "N", "Mean", r4(F.col("_m_value")).alias("Median"),
                      "SD", "Min", "Max", "Missing_pct")


def corr_matrix(df: DataFrame, variables: Sequence[str], digits: int = 2) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form, rounded.

    The moments of all pairs come from one pass (``pair_moments``); a constant column
    yields NULL instead of an error.  The lower triangle is the mirror image.
    """
    variables = [v for v in variables if v in df.columns]
    up = _correlations(df, variables)
    both = F.when(F.col("var1") == F.col("var2"), F.array(F.struct("var1", "var2"))).otherwise(
        F.array(F.struct("var1", "var2"), F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"))))
    return up.select(F.inline(both), F.round("r", digits).alias("r"))


def _correlations(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    same = F.col("var1") == F.col("var2")
    r = F.try_divide(F.col("cov"), F.sqrt("var_1") * F.sqrt("var_2"))
    return pair_moments(df, variables).select(
        "var1", "var2", F.when(same, F.when(F.col("var_1") > 0, 1.0)).otherwise(r).alias("r"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, missing cells and missing % (2 dp, 0 when empty) per table."""
    parts = []
    for name, df in tables.items():
        ncol = len(df.columns)
        miss = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0).cast("bigint"))
        n = F.count(F.lit(1))
        parts.append(df.agg(F.lit(name).alias("File"), n.alias("Rows"), F.lit(ncol).cast("bigint").alias("Cols"),
                            miss.cast("bigint").alias("Missing_Cells"),
                            F.when(n * ncol > 0, F.round(miss * 100.0 / (n * ncol), 2))
                             .otherwise(F.lit(0.0)).alias("Missing_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vif(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Variance inflation factors over all complete rows, highest first.

    The correlations of all pairs come from one pass; on the driver the k x k matrix of
    the columns that vary is decomposed, and VIF_i is the i-th diagonal element of its
    (pseudo-)inverse, = 1 / (1 - R_i^2) of the OLS of x_i on the others with a constant.
    A constant column has none.  A column with a part in an exact dependency has an
    infinite one; the others keep theirs.
    """
    import numpy as np

    variables = [v for v in variables if v in df.columns]
    d = df.select(*[F.col(v).cast("double").alias(v) for v in variables]).na.drop()
    r = {(x["var1"], x["var2"]): x["r"] for x in _correlations(d, variables).collect()}
    vary = [v for v in variables if r.get((v, v)) is not None]
    corr = np.array([[r.get((a, b), r.get((b, a))) for b in vary] for a in vary], float).reshape(len(vary), len(vary))
    size, axes = np.linalg.eigh(corr)
    none = size < 1e-10                                   # directions without spread: exact dependencies
    tied = (axes[:, none] ** 2).sum(axis=1) > 1e-8
    inverse = ((axes[:, ~none] ** 2) / size[~none]).sum(axis=1)
    vals = {v: float("inf") if t else float(x) for v, t, x in zip(vary, tied, inverse)}
    out = df.sparkSession.createDataFrame([(v, vals.get(v)) for v in variables], "Variable string, VIF double")
    return out.orderBy(F.col("VIF").desc_nulls_last())
