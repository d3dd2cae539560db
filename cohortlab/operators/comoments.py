"""Pair-complete second moments of any number of columns.

Spark's ``corr`` is one expression per pair: 240 columns would make 28,920 of them.  Here
each task adds up whole matrices, an Arrow batch at a time: with ``Z`` the values less a
shift (0 where missing) and ``W`` the 0/1 presence, ``Z'Z``, ``Z'W``, ``(Z*Z)'W`` and
``W'W`` hold all that a pair's covariance and deviations need over the rows where both
values are present.  The sums of the tasks are added per pair by an ordinary aggregate.
The shift is a value from the middle of the column, so large means don't cancel and a
constant column is exactly 0.  A task holds four matrices of columns x columns doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a variance below this share of the mean square around the shift is rounding
ZERO = 1e-13


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(var1, var2, n, cov, var_1, var_2)`` for every ordered pair with ``var1`` up to ``var2`` in ``columns``.

    Sums of products around the means (not divided by ``n``), over the rows with both
    values; NaN counts as missing.  Pairs without a common row have ``n`` = 0.
    """
    names = list(columns)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    d = df.select(*[number(c).alias(f"_{i}") for i, c in enumerate(names)])
    middle = d.agg(*[F.percentile_approx(f"_{i}", 0.5, 100).alias(f"_{i}") for i in range(len(names))])
    shifted = d.withColumn("_m", middle.select(F.struct("*")).scalar()).select(
        *[(F.col(f"_{i}") - F.col(f"_m._{i}")).alias(f"_{i}") for i in range(len(names))])
    k = len(names)
    # a row without values adds nothing, and gives every pair of an empty table its row
    none = df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"_{i}") for i in range(k)])
    shifted = shifted.unionByName(none)

    def add_up(batches):
        zz, zw, qw, ww = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            w = (~np.isnan(x)).astype(float)
            z = np.nan_to_num(x, nan=0.0)
            zz += z.T @ z
            zw += z.T @ w
            qw += (z * z).T @ w
            ww += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (i.astype("i4"), j.astype("i4"), ww[i, j], zz[i, j], zw[i, j], zw[j, i], qw[i, j], qw[j, i])],
            names=["i", "j", "n", "xy", "x", "y", "xx", "yy"])

    sums = (shifted.mapInArrow(add_up, "i int, j int, n double, xy double, x double, y double, xx double, yy double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")]))
    about = lambda s, a, b: F.col(s) - F.coalesce(F.try_divide(F.col(a) * F.col(b), F.col("n")), F.lit(0.0))
    spread = lambda s, a: F.when(about(s, a, a) > F.col(s) * ZERO, about(s, a, a)).otherwise(0.0)
    label = F.array(*map(F.lit, names))
    return sums.select(F.get(label, "i").alias("var1"), F.get(label, "j").alias("var2"), F.col("n").cast("long").alias("n"),
                       about("xy", "x", "y").alias("cov"), spread("xx", "x").alias("var_1"), spread("yy", "y").alias("var_2"))
