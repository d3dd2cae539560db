"""Scalar column expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab import config


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_lower(c, lower=0) -> Column:
    """``clip(lower=...)`` that keeps NULL as NULL (``greatest`` would not, S6)."""
    c = _c(c)
    return F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)


def nan_to_null(c) -> Column:
    """Map floating NaN to NULL so aggregates skip it the way pandas does."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def null_to_zero(c, dtype: str | None = None) -> Column:
    c = F.coalesce(_c(c), F.lit(0))
    return c.cast(dtype) if dtype else c


def log1p(c) -> Column:
    return F.log1p(_c(c).cast("double"))


# Formats tried in order after the ISO-8601 default (B2).
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
]


def parse_timestamp_mixed(c) -> Column:
    """Parse mixed-format date strings to a UTC ``TIMESTAMP``; NULL when nothing fits."""
    c = F.trim(_c(c).cast("string"))
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def month_start(c) -> Column:
    """Start of the calendar month as a TIMESTAMP (H7)."""
    return F.date_trunc("month", _c(c).cast("timestamp"))


def short_project(c) -> Column:
    """Drop the literal project prefix (H6), not a regex."""
    return F.replace(_c(c), F.lit(config.PROJECT_PREFIX), F.lit(""))


def rate_bucket(pct) -> Column:
    """Three-way bucket on a percentage (B19): high > 15, mid > 8, else low."""
    pct = _c(pct)
    hi, mid = config.RATE_BUCKET_EDGES
    return (F.when(pct > hi, F.lit("high"))
             .when(pct > mid, F.lit("mid"))
             .otherwise(F.lit("low")))
