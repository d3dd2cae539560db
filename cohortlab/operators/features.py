"""Feature derivation for the modeling table.

Group statistics are computed as grouped aggregates and joined back on the
group key (a hash aggregate with map-side partials), never as a window over a
whole group; they are written first, so that their size is known when the join is
planned.  Global statistics enter as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.functions.quantiles import grouped_medians, median_struct
from cohortlab.functions.scalar import log1p
from cohortlab.operators.ranking import running_index
from cohortlab.session import materialize

LOG_SOURCES = {"log_churn": "CHURN", "log_ncloc": "NCLOC", "log_sqale_index": "SQALE_INDEX",
               "log_ref_count": "REF_COUNT"}


def log_transforms(df: DataFrame) -> DataFrame:
    """log1p of the heavy-tailed columns that are present (H1)."""
    return df.withColumns({k: log1p(v) for k, v in LOG_SOURCES.items() if v in df.columns})


def log_moments(df: DataFrame) -> DataFrame:
    """Mean and sample SD of each log feature (D17), one row per feature."""
    cols = [c for c in LOG_SOURCES if c in df.columns]
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std)")


def impute_group_median(df: DataFrame, cols: Sequence[str], group: str = "PROJECT_ID") -> DataFrame:
    """NULL -> median of the row's group -> global median.

    Per-group medians are exact without an unbounded single-task value map
    (``grouped_medians``) and are joined back on ``group``; the global medians enter
    as one scalar subquery.  Rows without a group get the global one.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    gm = materialize(grouped_medians(df.filter(F.col(group).isNotNull()), [group], cols, out_prefix="_gm_"), "medians")
    out = df.join(gm, on=group, how="left").withColumn("_gl", median_struct(df, cols))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_gm_{c}"), F.col(f"_gl.{c}")) for c in cols})
    return out.drop("_gl", *[f"_gm_{c}" for c in cols])


def missing_counts(df: DataFrame, cols: Sequence[str], stage: str) -> DataFrame:
    """NULL count per column (D18), one row per column."""
    cols = [c for c in cols if c in df.columns]
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, n_missing)")
                .withColumn("stage", F.lit(stage)))


def handle_missing(df: DataFrame) -> DataFrame:
    """Group-median imputation of the debt measures, zero for the log features."""
    out = impute_group_median(df, config.TD_FEATURES)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in LOG_SOURCES if c in out.columns})


def interactions(df: DataFrame) -> DataFrame:
    """TDR x refactoring flag, and TDR x log refactoring count when present."""
    out = df.withColumn("TDR_x_REF", F.col("SQALE_DEBT_RATIO") * F.col("HAS_REFACTORING"))
    if "log_ref_count" in df.columns:
        out = out.withColumn("TDR_x_REFCOUNT", F.col("SQALE_DEBT_RATIO") * F.col("log_ref_count"))
    return out


def dense_code(df: DataFrame, col: str = "PROJECT_ID", out: str = "PROJECT_IDX") -> DataFrame:
    """0-based code of ``col`` in sorted order of its distinct values; NULL -> -1 (E5).

    The window runs over the distinct-value table only (one row per key); the
    code table is joined back.
    """
    keys = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = keys.withColumn(out, (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))
    return (df.join(materialize(codes, "codes"), on=col, how="left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(-1))))


def time_index(df: DataFrame, group: str = "PROJECT_ID", time: str = "AUTHOR_DATE",
               tiebreak: str = "COMMIT_HASH", out: str = "TIME_IDX") -> DataFrame:
    """Running 0-based commit index per project in time order, undated rows last."""
    return running_index(df, [group], [F.col(time).asc_nulls_last(), F.col(tiebreak).asc()], out)


def check_features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Names in ``wanted`` missing from ``df`` (B21); raises if any are missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return missing


def imputed_cohort(cohort: DataFrame, impute_first: bool = False) -> DataFrame:
    """cohort -> log transforms -> imputation, the order the study uses: a missing size has log 0.

    ``impute_first=True`` imputes the measures first, so the logs are of the imputed values.
    """
    if impute_first:
        return handle_missing(log_transforms(impute_group_median(cohort, config.TD_FEATURES)))
    return handle_missing(log_transforms(cohort))


def modeling_ready(imputed: DataFrame) -> DataFrame:
    """imputed cohort -> interactions -> project code -> time index (A10)."""
    d = interactions(imputed)
    d = dense_code(d)
    d = time_index(d)
    check_features(d, sorted(set(config.FEATURES_M3 + config.FEATURES_M1)))
    return d
