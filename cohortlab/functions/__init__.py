"""Column-level helpers (JVM-side expressions only)."""

from cohortlab.functions.scalar import (  # noqa: F401
    clip_lower, nan_to_null, null_to_zero, parse_timestamp_mixed, log1p,
    month_start, short_project, rate_bucket,
)
