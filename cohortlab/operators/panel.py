"""Project x month panel.

The forward-looking rate of each (project, month) anchor -- mean label of the
commits in ``(month start, month start + tau]`` -- is the difference of two
prefix sums, divided by that of two prefix counts.  The commits are first
reduced to one row per (project, instant); these and the ends of all windows
are put into one order, and the sums up to each end are read off there.  No
commit is copied, no window spans a project and no (anchor, commit) pair is
formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.functions.ordering import running_sums
from cohortlab.functions.scalar import log1p, month_start


def panel_month(df: DataFrame, group: str = "PROJECT_ID", time: str = "AUTHOR_DATE") -> DataFrame:
    """Aggregate commits to project x calendar month (D9) with the rate, lag and delta."""
    p = (df.groupBy(group, month_start(time).alias("PERIOD_START"))
           .agg(F.avg("SQALE_DEBT_RATIO").alias("TDR_mean"),
                F.max("SQALE_DEBT_RATIO").alias("TDR_max"),
                F.sum("CHURN").alias("CHURN_sum"),
                F.avg("NCLOC").alias("NCLOC_mean"),
                F.count("COMMIT_HASH").alias("N_COMMITS"),
                F.sum("BIC").cast("bigint").alias("BIC_COUNT"),
                F.sum("REF_COUNT").alias("REF_COUNT_sum")))
    # lag over the panel: one row per project and month, so a project's
    # partition is bounded by its number of months, not its number of commits
    w = Window.partitionBy(group).orderBy("PERIOD_START")
    return (p.withColumn("PERIOD", F.date_format("PERIOD_START", "yyyy-MM"))
             .withColumn("BIC_RATE", F.try_divide(F.col("BIC_COUNT").cast("double"), F.col("N_COMMITS")))
             .withColumn("TDR_LAG1", F.lag("TDR_mean", 1).over(w))
             .withColumn("DELTA_TDR", F.col("TDR_mean") - F.col("TDR_LAG1"))
             .withColumn("log_churn_sum", log1p("CHURN_sum"))
             .withColumn("log_ncloc", log1p("NCLOC_mean")))


def forward_rates(df: DataFrame, taus: Sequence[int] = tuple(config.FORWARD_WINDOWS_DAYS),
                  group: str = "PROJECT_ID", time: str = "AUTHOR_DATE", label: str = "BIC",
                  anchor: str = "period_start") -> DataFrame:
    """Mean label per (project, anchor month) over ``(t0, t0 + tau days]`` for each tau.

    ``anchor='period_start'`` uses the month start as t0 (as the study does;
    the window overlaps the month itself); ``'period_end'`` uses the next
    month's start, a purely forward window.
    """
    taus = list(taus)
    months = df.select(group, month_start(time).alias("PERIOD_START")).distinct()
    t0 = F.add_months("PERIOD_START", 1 if anchor == "period_end" else 0).cast("timestamp")
    ends = {0: t0} | {tau: t0 + F.make_dt_interval(F.lit(tau)) for tau in taus}
    points = (months.filter(F.col("PERIOD_START").isNotNull())
              .select(group, "PERIOD_START", *[F.unix_micros(e).alias(str(tau)) for tau, e in ends.items()])
              .unpivot([group, "PERIOD_START"], [str(tau) for tau in ends], "_end", "_t"))
    instants = (df.groupBy(group, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
                  .agg(F.sum(label).alias("_y"), F.count(label).alias("_n")).filter(F.col("_t").isNotNull()))
    # at one instant the commits come first: a window's end counts them, its start leaves them out
    upto = running_sums(instants.unionByName(points, allowMissingColumns=True), [group],
                        [F.col("_t").asc(), F.col("_end").asc_nulls_first()], ["_y", "_n"])
    at = lambda c, tau: F.max(F.when(F.col("_end") == str(tau), F.col(c)))
    rate = lambda tau: F.try_divide((at("cum__y", tau) - at("cum__y", 0)).cast("double"), at("cum__n", tau) - at("cum__n", 0))
    return (upto.filter(F.col("_end").isNotNull()).groupBy(group, "PERIOD_START")
                .agg(*[rate(tau).alias(f"BIC_RATE_NEXT_{tau}D") for tau in taus]))


def panel_with_forward(df: DataFrame, taus: Sequence[int] = tuple(config.FORWARD_WINDOWS_DAYS),
                       anchor: str = "period_start") -> DataFrame:
    """Panel plus forward rates; rows without any commit in a window get NULL."""
    p = panel_month(df)
    f = forward_rates(df, taus, anchor=anchor)
    return p.join(f, on=["PROJECT_ID", "PERIOD_START"], how="left")


def final_panel(df: DataFrame, taus: Sequence[int] = tuple(config.FORWARD_WINDOWS_DAYS)) -> DataFrame:
    """The persisted panel: first month of each project (no lag) dropped."""
    return panel_with_forward(df, taus).filter(F.col("DELTA_TDR").isNotNull())


def forward_rate_means(panel_all: DataFrame, taus: Sequence[int] = tuple(config.FORWARD_WINDOWS_DAYS)) -> DataFrame:
    """Mean forward rate per tau over all panel rows before the lag drop."""
    wide = panel_all.agg(*[F.avg(f"BIC_RATE_NEXT_{t}D").alias(f"m{t}") for t in taus])
    stack = ", ".join(f"{t}, m{t}" for t in taus)
    return wide.selectExpr(f"stack({len(taus)}, {stack}) AS (tau_days, mean_forward_rate)") \
               .withColumn("tau_days", F.col("tau_days").cast("int"))
