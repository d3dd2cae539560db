"""Distributed running indexes and prefix sums.

A running index or cumulative sum over a whole group (or a whole table) is a
window whose partition is the group: one task must sort all of it.  Here the
ordered dimension is first cut into ranges; per-range totals form a small
table (one row per group and range) on which the prefix offsets are taken,
and each range is then worked through on its own and shifted by its offset.  The
result is exactly the single-window result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.ordering import place_in_group, write_ordered
from cohortlab.functions.quantiles import edges_of, join_null_safe, range_of


def running_index(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], out: str = "row_idx",
                  group_size: str | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_by``; a NULL key is a group.

    The ranges are cut over (key, ``order_by``) as a whole, so rows of one instant
    spread over ranges by the columns that break the tie.  ``group_size`` optionally
    adds the group's row count.
    """
    return place_in_group(write_ordered(df, partition_by, order_by, "index"), partition_by, out, group_size)


def descending_cumulative(counts: DataFrame, partition_by: Sequence[str], score: str,
                          sums: Sequence[str]) -> DataFrame:
    """Cumulative sums of ``sums`` over rows with score >= the current one, per group.

    ``counts`` holds one row per (group, distinct score).  Buckets are cut at the
    group's own approximate score quantiles, so they are equal-count wherever the
    scores lie.
    """
    part = list(partition_by)
    edges = counts.groupBy(*part).agg(edges_of(F.col(score)).alias("_se"))
    d = join_null_safe(counts, edges, part).withColumn("_sb", range_of(F.col(score), F.col("_se"))).drop("_se")
    tot = d.groupBy(*part, "_sb").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wb = Window.partitionBy(*part).orderBy(F.col("_sb").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_sb", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                      for c in sums])
    w = (Window.partitionBy(*part, "_sb").orderBy(F.col(score).desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = d.select("*", *[F.sum(c).over(w).alias(f"_i_{c}") for c in sums])
    res = join_null_safe(inner, offs, part + ["_sb"])
    return res.select(*counts.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}")
                                         for c in sums])
