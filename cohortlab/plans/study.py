"""The study as lazily built stage DataFrames.

``Study`` memoises each stage's *plan* (not its data); every accessor returns
a DataFrame that Catalyst optimises as a whole.  The cohort and the rows of the
modeling table in their time order -- the tables the original pipeline persists --
are written to the shared checkpoint folder and read back, which cuts lineage
between stages (A9, A10, A13) and keeps downstream plans small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import assemble, features, panel
from cohortlab.plans import handoff
from cohortlab.session import materialize, materialize_bucketed, settings
from cohortlab.sources import fixtures


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 raw: Mapping[str, DataFrame] | None = None, asof_bucket_micros: int | str = "quantile",
                 min_commits: int = config.MIN_COMMITS_PER_PROJECT,
                 min_snapshots: int = config.MIN_SONAR_SNAPSHOTS, materialize_stages: bool = True,
                 impute_first: bool = False):
        if raw is None and sf_dir is None:
            raise ValueError("give sf_dir or raw tables")
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw = raw
        self.asof_bucket_micros = asof_bucket_micros
        self.min_commits = min_commits
        self.min_snapshots = min_snapshots
        self.materialize_stages = materialize_stages
        self.impute_first = impute_first
        self.fits: dict = {}  # split tables and fitted models of this study

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.materialize_stages else df

    def stage_bucketed(self, df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
        if not keys:
            return self.stage(df, name)
        return materialize_bucketed(df, name, keys) if self.materialize_stages else df

    def fingerprint(self) -> str:
        """What the study's results depend on: its input files and its parameters."""
        raw = self._raw.values() if self._raw is not None else fixtures.study_tables(self.spark, self.sf_dir)
        return handoff.fingerprint(self.spark, *raw, stage="study", min_commits=self.min_commits,
                                   min_snapshots=self.min_snapshots, impute_first=self.impute_first)

    # -- sources -------------------------------------------------------------
    @cached_property
    def raw(self) -> Mapping[str, DataFrame]:
        if self._raw is not None:
            return self._raw
        return fixtures.raw_tables(self.spark, self.sf_dir, self.stage_bucketed)

    @cached_property
    def clean(self) -> Mapping[str, DataFrame]:
        return assemble.clean_tables(self.raw)

    # -- preprocessing ---------------------------------------------------------
    @cached_property
    def base(self) -> DataFrame:
        # the count per project and both sides of the as-of join read the distinct commits, which stay in their buckets
        return assemble.commit_base(self.stage_bucketed(self.clean["commits"], "commits", fixtures.KEY), self.min_commits)

    @cached_property
    def churn(self) -> DataFrame:
        return assemble.churn(self.clean["changes"])

    @cached_property
    def bic_labels(self) -> DataFrame:
        return assemble.bic_labels(self.clean["szz"])

    @cached_property
    def refs(self) -> DataFrame:
        return assemble.ref_counts(self.clean["refactoring"])

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.stage(assemble.snapshot_base(self.clean["sonar_analysis"], self.clean["sonar_measures"],
                                                 self.min_snapshots), "snapshots")

    @cached_property
    def linked_all(self) -> DataFrame:
        """Every base commit with its as-of match (NULL payload when none) and ``_matched``, by commit key."""
        linked = assemble.link_snapshots(self.base, self.snapshots, how="left",
                                         bucket_micros=self.asof_bucket_micros, matched_col="_matched")
        # where the matches are few enough to be sent to the commits, these are written bucket by bucket as they lie
        with settings(self.spark, sources__bucketing__autoBucketedScan__enabled="false"):
            return self.stage_bucketed(linked, "linked", fixtures.KEY)

    def linked(self, allow_exact: bool = True, how: str = "inner",
               matched_col: str | None = None) -> DataFrame:
        if allow_exact:
            d = self.linked_all
            if how == "inner":
                d = d.filter(F.col("_matched"))
            return d if matched_col == "_matched" else (
                d.withColumnRenamed("_matched", matched_col) if matched_col else d.drop("_matched"))
        return assemble.link_snapshots(self.base, self.snapshots, allow_exact=allow_exact, how=how,
                                       bucket_micros=self.asof_bucket_micros, matched_col=matched_col)

    @cached_property
    def cohort(self) -> DataFrame:
        parts = self.linked(), self.churn, self.bic_labels, self.refs
        # all lie in buckets of the hash, a part of the joins' key: so they meet without an exchange
        with settings(self.spark, requireAllClusterKeysForCoPartition="false"):
            return self.stage(assemble.assemble_cohort(*parts), "cohort")

    # -- features --------------------------------------------------------------
    @cached_property
    def _imputed_rows(self) -> DataFrame:
        return features.imputed_cohort(self.cohort, self.impute_first)

    @cached_property
    def imputed(self) -> DataFrame:
        if "modeling" in self.__dict__:   # the modeling table has these rows and columns, written in order
            return self.modeling.select(*self._imputed_rows.columns)
        # several consumers: staged, so nothing stays in executors' memory behind the study
        return self.stage(self._imputed_rows, "imputed")

    @cached_property
    def modeling(self) -> DataFrame:
        # the running index writes the rows in their order, once, if nobody has asked for the imputed ones before;
        # reading them adds each one's place
        return features.modeling_ready(self.__dict__["imputed"] if "imputed" in self.__dict__ else self._imputed_rows)

    @cached_property
    def panel_all(self) -> DataFrame:
        return panel.panel_with_forward(self.imputed)

    @cached_property
    def panel(self) -> DataFrame:
        return self.panel_all.filter("DELTA_TDR IS NOT NULL")
