"""Backward as-of join.

For every left row, take the last right row of the same key whose time is
``<=`` the left time (``<`` with ``allow_exact=False``).  Spark has no public
as-of join for DataFrames.  The match depends only on (key, left time), and of
equal right instants only the largest tiebreak can win, so both sides are first
reduced, each by a partial aggregate, to one row per (key, instant).  On these rows
``last(payload, ignorenulls)`` over an ordered window finds the match, and an
equality join on (key, instant) brings it back to the left rows.  No pair of
rows is ever formed.

Scale: a window partitioned by the key alone would put a hot key (say a third of
all rows) into one task.  The instants are range-partitioned by (key, time), so a
hot key covers as many ranges as its instants ask for; each range gets one *carry*,
the key's last right row of all earlier ranges, from a table with one row per (key,
range).  A hot instant is one row here, and in the join back its left rows are split
like any skewed side of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.ordering import write_ordered
from cohortlab.session import materialize

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              payload: Sequence[str], tiebreak: Sequence[str] = (), allow_exact: bool = True,
              how: str = "inner", bucket_micros: int | str | None = "quantile",
              matched_col: str | None = None) -> DataFrame:
    """Attach to each ``left`` row the ``payload`` of its backward as-of match.

    ``by``: equality keys (NULL keys never match).  ``tiebreak``: right columns
    ordering rows with equal time; the largest wins (S2).  ``how='inner'``
    drops unmatched left rows (C5), ``'left'`` keeps them with NULL payload.
    ``matched_col`` adds a boolean match flag.

    By default the instants are cut into ranges of equal count (``"quantile"``; they
    are written to the shared folder once); a number gives ranges of fixed width,
    ``None`` one window per key.
    """
    by, payload, tiebreak = list(by), list(payload), list(tiebreak)
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    clash = [c for c in payload if c in left.columns and c not in by]
    if clash:
        raise ValueError(f"payload columns already on the left: {clash}")
    keys = [F.col(k) for k in by]
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("_t")
    row = F.struct(F.struct(*[F.col(c) for c in tiebreak] or [F.lit(0)]).alias("_tb"), F.struct(*payload).alias("_p"))
    known = lambda d: d.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*by, "_t"]))
    # each side by itself: the left rows' aggregate carries no payload, so it hashes and does not sort them
    l_ = known(left.select(*keys, moment(left_on))).distinct().withColumn("_l", F.lit(True))
    r = known(right.select(*keys, moment(right_on), row.alias("_m"))).groupBy(*by, "_t").agg(F.max("_m").alias("_m"))
    instants = l_.join(r, [*by, "_t"], "full").select(*by, "_t", "_m", F.coalesce("_l", F.lit(False)).alias("_l"))
    m = _last_before(instants, by, allow_exact, bucket_micros)
    if bucket_micros == "quantile":
        m = materialize(m, "asof-matches")   # its size decides whether the left rows have to move to meet it

    match = m.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_t").alias("_mt"), "_p")
    on = F.unix_micros(F.col(left_on).cast("timestamp")) == F.col("_mt")
    for k in by:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    if how == "inner":
        match = match.filter(F.col("_p").isNotNull())
    out = left.join(match, on, how)
    sel = [F.col(c) for c in left.columns] + [F.col(f"_p.{c}").alias(c) for c in payload]
    if matched_col:
        sel.append(F.col("_p").isNotNull().alias(matched_col))
    return out.select(*sel)


def _last_before(instants: DataFrame, by: list[str], allow_exact: bool, bucket_micros: int | str | None) -> DataFrame:
    """``(*by, _t, _p)``: for each instant of the left its match's payload, or NULL."""
    if bucket_micros == "quantile":
        d = write_ordered(instants, by, [F.col("_t")], "asof-instants")
    else:
        d = instants.withColumn("_part", F.floor(F.col("_t") / int(bucket_micros)) if bucket_micros else F.lit(0))
    # one row per (key, instant): the frame's end decides between <= and <
    w = (Window.partitionBy(*by, "_part").orderBy("_t")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow if allow_exact else -1))
    own = F.last("_m", ignorenulls=True).over(w)
    d = d.select(*by, "_part", "_t", "_l", "_m", own.alias("_own"))
    if not bucket_micros:
        return d.filter("_l").select(*by, "_t", F.col("_own._p").alias("_p"))
    parts = d.groupBy(*by, "_part").agg(F.max(F.when(F.col("_m").isNotNull(), F.struct("_t", "_m"))).alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*by, "_part", F.last("_c", ignorenulls=True).over(earlier).alias("_c"))
    return d.filter("_l").join(carry, [*by, "_part"]).select(*by, "_t", F.coalesce("_own._p", "_c._m._p").alias("_p"))


def asof_coverage(linked_left: DataFrame, matched_col: str = "_matched") -> DataFrame:
    """Link coverage over *all* left rows (D8, S11): total, linked, unlinked, percents."""
    n = F.count(F.lit(1))
    k = F.count_if(F.col(matched_col))
    return linked_left.agg(
        n.alias("total_commits"),
        k.alias("linked"),
        (n - k).alias("unlinked"),
        F.round(F.try_divide(k * 100.0, n), 1).alias("linked_pct"),
        F.round(F.try_divide((n - k) * 100.0, n), 1).alias("unlinked_pct"),
    )
