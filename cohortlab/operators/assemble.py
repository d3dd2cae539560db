"""Pre-aggregation of fact tables and cohort assembly.

Every fact table is reduced to one row per (project, commit) *before* it is
joined (the aggregate has a map-side partial step), and all left joins use the
same key, so the assembled cohort is shuffled by that key once and the
following joins reuse the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import clean
from cohortlab.operators.asof import asof_join
from cohortlab.sources.tables import LazyTables

KEY = ["PROJECT_ID", "COMMIT_HASH"]


def clean_tables(raw: Mapping[str, DataFrame], on_bad_dates: str = "raise") -> LazyTables:
    """The study's cleaning step applied to the logical raw tables (B2-B7), each when first asked for."""
    def dated(name: str, col: str, keys: list[str]) -> DataFrame:
        return clean.dedup_keep_first(clean.parse_dates(raw[name], col, on_bad_dates), keys, [col])

    return LazyTables({name: lambda name=name: raw[name] for name in raw} | {
        "commits": lambda: dated("commits", "AUTHOR_DATE", KEY),
        "changes": lambda: clean.fill_zero(raw["changes"], ["LINES_ADDED", "LINES_REMOVED"]),
        "sonar_analysis": lambda: dated("sonar_analysis", "DATE", ["PROJECT_ID", "ANALYSIS_KEY"]),
        "sonar_measures": lambda: clean.clip_measures(raw["sonar_measures"], config.TD_FEATURES),
        "szz": lambda: clean.distinct_rows(raw["szz"]),
        "refactoring": lambda: clean.distinct_rows(raw["refactoring"]),
    })


def commit_base(commits: DataFrame, min_commits: int = config.MIN_COMMITS_PER_PROJECT) -> DataFrame:
    """Main-branch, non-merge commits of projects with >= ``min_commits`` of them."""
    c = clean.main_branch_non_merge(commits)
    return clean.keep_groups_with_min_rows(c, "PROJECT_ID", min_commits)


def churn(changes: DataFrame) -> DataFrame:
    """Per-commit sums of added and removed lines; CHURN = added + removed."""
    ch = clean.drop_null_keys(changes, KEY)
    return (ch.groupBy(*KEY)
              .agg(F.sum("LINES_ADDED").cast("bigint").alias("LINES_ADDED"),
                   F.sum("LINES_REMOVED").cast("bigint").alias("LINES_REMOVED"))
              .withColumn("CHURN", F.col("LINES_ADDED") + F.col("LINES_REMOVED")))


def bic_labels(szz: DataFrame) -> DataFrame:
    """Distinct (project, inducing commit) pairs flagged BIC = 1."""
    return (szz.select("PROJECT_ID", F.col("FAULT_INDUCING_COMMIT_HASH").alias("COMMIT_HASH"))
               .transform(lambda d: clean.drop_null_keys(d, KEY))
               .distinct()
               .withColumn("BIC", F.lit(1)))


def ref_counts(refactoring: DataFrame, mode: str = "distinct_types") -> DataFrame:
    """REF_COUNT and HAS_REFACTORING per commit.

    ``distinct_types`` (default, as the study computes it: rows are distinct on
    (project, commit, type) first, so the count is of distinct non-null
    types); ``operations`` counts every non-null row of the raw table.
    """
    r = clean.drop_null_keys(refactoring, KEY)
    if mode == "distinct_types":
        r = r.select(*KEY, "REFACTORING_TYPE").distinct()
    elif mode != "operations":
        raise ValueError(mode)
    return (r.groupBy(*KEY).agg(F.count("REFACTORING_TYPE").alias("REF_COUNT"))
             .withColumn("HAS_REFACTORING", F.lit(1)))


def snapshot_base(sonar_analysis: DataFrame, sonar_measures: DataFrame,
                  min_snapshots: int = config.MIN_SONAR_SNAPSHOTS) -> DataFrame:
    """Snapshots with their measures, non-null debt ratio, >= ``min_snapshots`` per project."""
    sa = sonar_analysis.select("PROJECT_ID", "ANALYSIS_KEY", "DATE")
    sm = clean.drop_null_keys(sonar_measures, ["PROJECT_ID", "ANALYSIS_KEY"])
    s = sa.join(sm, on=["PROJECT_ID", "ANALYSIS_KEY"], how="inner")
    s = s.filter(F.col(config.TD_PRIMARY).isNotNull())
    return clean.keep_groups_with_min_rows(s, "PROJECT_ID", min_snapshots)


def link_snapshots(base: DataFrame, snapshots: DataFrame, allow_exact: bool = True,
                   how: str = "inner", bucket_micros: int | None = None,
                   matched_col: str | None = None) -> DataFrame:
    """Leakage-free as-of link of each commit to its latest earlier snapshot."""
    kw = {} if bucket_micros is None else {"bucket_micros": bucket_micros}
    meas = [c for c in config.TD_FEATURES if c in snapshots.columns]
    return asof_join(base, snapshots, by=["PROJECT_ID"], left_on="AUTHOR_DATE", right_on="DATE",
                     payload=["DATE"] + meas, tiebreak=["ANALYSIS_KEY"], allow_exact=allow_exact,
                     how=how, matched_col=matched_col, **kw)


def assemble_cohort(linked: DataFrame, churn_df: DataFrame, labels: DataFrame,
                    refs: DataFrame) -> DataFrame:
    """Left joins with zero fill on the commit key."""
    on = KEY[::-1]   # sorted by the hash first: names of projects share their first bytes
    c = (linked
         .join(churn_df.select(*KEY, "LINES_ADDED", "LINES_REMOVED", "CHURN"), on=on, how="left")
         .join(labels.select(*KEY, "BIC"), on=on, how="left")
         .join(refs.select(*KEY, "HAS_REFACTORING", "REF_COUNT"), on=on, how="left"))
    c = c.select(*KEY, *[x for x in c.columns if x not in KEY])
    return c.withColumns({
        "CHURN": F.coalesce(F.col("CHURN"), F.lit(0)).cast("double"),
        "LINES_ADDED": F.coalesce(F.col("LINES_ADDED"), F.lit(0)).cast("double"),
        "LINES_REMOVED": F.coalesce(F.col("LINES_REMOVED"), F.lit(0)).cast("double"),
        "BIC": F.coalesce(F.col("BIC"), F.lit(0)).cast("int"),
        "HAS_REFACTORING": F.coalesce(F.col("HAS_REFACTORING"), F.lit(0)).cast("int"),
        "REF_COUNT": F.coalesce(F.col("REF_COUNT"), F.lit(0)).cast("double"),
    })
