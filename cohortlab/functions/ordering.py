"""Tables cut into ranges of a composite order, for work that follows an order without a window over a whole group.

``write_ordered`` range-partitions rows by (group, order columns), sorts each range and
writes it with the range's number and each row's place.  The range edges are sampled from
the values of *all* order columns, so rows of one hot group, and rows of one hot instant
that differ in a later column, spread over as many ranges as their number asks for.  What
crosses a range border is one small row per (group, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.quantiles import join_null_safe
from cohortlab.session import materialize


def write_ordered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ordered") -> DataFrame:
    """``df`` with ``_at``, growing along (``by``, ``order``), and ``_part``, the number of the row's range; written."""
    keys = [*(F.col(c) for c in by), *order]
    placed = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    # a range's rows are numbered from its own multiple of 2**33
    return materialize(placed, name).withColumn("_part", F.shiftright("_at", 33))


def place_in_group(ordered: DataFrame, by: Sequence[str], out: str, group_size: str | None = None) -> DataFrame:
    """0-based place of each row in its group of a ``write_ordered`` table, ``_at`` and ``_part`` dropped.

    A row's place is its distance from the group's first row in the range, plus the
    group's rows in earlier ranges: prefix counts over one row per (group, range).
    """
    by = list(by)
    parts = ordered.groupBy(*by, "_part").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    cols = [(F.col("_lo") - F.coalesce(before, F.lit(0))).alias("_base")]
    if group_size:
        cols.append(F.sum("_n").over(w).alias(group_size))
    base = materialize(parts.select(*by, "_part", *cols), "range-bases")
    placed = join_null_safe(ordered, base, [*by, "_part"])
    return placed.withColumn(out, F.col("_at") - F.col("_base")).drop("_base", "_at", "_part")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """``df`` with ``cum_<c>`` for each column of ``sums``: its sum over the group's rows up to and with the row.

    NULL counts as 0.  Sums inside each range, plus the group's sums over earlier ranges.
    """
    by = list(by)
    d = write_ordered(df, by, order, "running").withColumns({f"_s_{c}": F.coalesce(F.col(c), F.lit(0)) for c in sums})
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*by, "_part").agg(*[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums])
    before = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_i_{c}": F.sum(f"_s_{c}").over(inside) for c in sums})
    return join_null_safe(d, before, [*by, "_part"]).select(
        *df.columns, *[(F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}") for c in sums])
