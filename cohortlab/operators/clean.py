"""Cleaning, de-duplication and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalar import clip_lower, nan_to_null, parse_timestamp_mixed
from cohortlab.session import materialize


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per key: the smallest by ``order`` then by every other column, NULL last.

    Written as ``min(struct)`` per key, so it is a hash aggregate with a map-side
    partial step: a key holding a third of the rows is reduced before the
    shuffle instead of being sorted in one task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    payload = order + rest
    if not payload:
        return df.select(*keys).distinct()
    # a struct compares its fields in turn and NULL comes first, hence the flag before each
    m = F.min(F.struct(*[x for c in payload for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))])).alias("_first")
    # a sort aggregate: the last key, a hash or date, tells most rows apart by its first bytes
    out = df.groupBy(*reversed(keys)).agg(m)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload]).select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct."""
    return df.distinct()


def clip_measures(df: DataFrame, cols: Sequence[str], lower=0) -> DataFrame:
    """NaN -> NULL, then clip below at ``lower`` keeping NULL."""
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: clip_lower(nan_to_null(F.col(c).cast("double")), lower) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                           for c in cols if c in df.columns})


def parse_dates(df: DataFrame, col: str, on_bad: str = "raise") -> DataFrame:
    """Mixed-format timestamp parse to UTC.

    ``on_bad='raise'`` counts unparseable non-null values and raises with the
    count (one aggregate job); ``'drop'`` removes them; ``'null'`` keeps NULL.
    Columns that already are timestamps are only cast.
    """
    dt = df.schema[col].dataType.simpleString()
    if dt.startswith("timestamp") or dt == "date":
        return df.withColumn(col, F.col(col).cast("timestamp"))
    parsed = parse_timestamp_mixed(col)
    out = df.withColumn("_parsed", parsed)
    if on_bad == "raise":
        bad = out.filter(F.col(col).isNotNull() & F.col("_parsed").isNull()).count()
        if bad:
            raise ValueError(f"{bad} unparseable values in {col}")
    elif on_bad == "drop":
        out = out.filter(F.col("_parsed").isNotNull() | F.col(col).isNull())
    return out.withColumn(col, F.col("_parsed")).drop("_parsed")


def main_branch_non_merge(df: DataFrame, branch: str = "IN_MAIN_BRANCH", merge: str = "MERGE") -> DataFrame:
    """Conjunctive flag filter."""
    return df.filter(F.col(branch) & ~F.col(merge))


def keep_groups_with_min_rows(df: DataFrame, key: str | Sequence[str], min_rows: int) -> DataFrame:
    """Semi-join on ``HAVING count(*) >= min_rows``.

    The per-key count is a partial aggregate (skew-safe).  The surviving keys are
    written, so their size is known when the join is planned, and few of them don't
    move the rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ok = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= F.lit(min_rows)).select(*keys))
    return df.join(materialize(ok, "kept-groups"), on=keys, how="left_semi")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A NULL key is not an identity: never group or join on it."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else (cond & c)
    return df.filter(cond) if cond is not None else df
