"""Exact quantiles per group from mergeable sketches.

Two scans, at every size.  The first builds one KLL sketch per (group, column) with
partial aggregates; the values at a wanted rank less and plus the sketch's rank error
bracket the true one.  The second counts the rows between the brackets, which collapse
before the shuffle, and keeps only the values inside them; exact ranks follow from the
counts.  A tied value is one row however often it occurs.  Results equal linear
interpolation (numpy's default) exactly: a rank outside its bracket, which takes an error
of three times the sketch's 99 % bound, raises an error instead of giving a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: size of a sketch, and three times its rank error (fixed values: the KLL double sketch's 99 % bound is 2.296 / k ** 0.9723)
SKETCH = 4096
SLACK = 3 * 2.296 / SKETCH ** 0.9723
#: half widths of a bracket, as shares of the values; a group takes the least that is above the slack and two of its values
WIDTHS = (0.003, 0.01, 0.05, 1.0)
SIDE = 16
RANGES = SIDE * SIDE
ACCURACY = 10_000
_PROBS = [i / RANGES for i in range(1, RANGES)]


def edges_of(value: Column) -> Column:
    """Aggregate: approximate cut points of a group's values into ``RANGES`` ranges."""
    return F.percentile_approx(value, _PROBS, ACCURACY)


def range_of(value: Column, edges: Column) -> Column:
    """Number of edges <= value, by two scans of ``SIDE - 1`` edges; non-decreasing in value."""
    upto = lambda part: F.size(F.filter(part, lambda e: e <= value))
    coarse = upto(F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda k: F.get(edges, k * SIDE - 1)))
    # the coarse place is bound once, as the only element of an array
    return F.get(F.transform(F.array(coarse), lambda c: c * SIDE + upto(F.slice(edges, c * SIDE + 1, SIDE - 1))), F.lit(0))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the left side's key columns stay."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _ranks(n: Column, probs: Sequence[float]) -> list[Column]:
    """For each probability, the 0-based ranks between which it lies (two columns each)."""
    pos = [(n - 1) * F.lit(float(p)) for p in probs]
    return [x for p in pos for x in (F.floor(p), F.least(F.floor(p) + 1, n - 1))]


def _brackets(values: DataFrame, g: list[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per group: ``_b``, per column its number of values and the brackets ``lo`` and ``hi`` of the wanted ranks."""
    wide = values.groupBy(*g).agg(*[x for i, c in enumerate(cols) for x in (
        F.kll_sketch_agg_double(c, SKETCH).alias(f"_s{i}"), F.count(c).alias(f"_n{i}"))])

    # ranks of a sketch must be literals: those of every width are read, and the group's size picks one
    clip = lambda x: min(max(x, 0.0), 1.0)
    ends = lambda sign: F.lit([clip(p + sign * w) for p in probs for w in WIDTHS]).cast("array<double>")

    def bracket(i: int) -> Column:
        n = F.col(f"_n{i}")
        width = F.lit(len(WIDTHS) - 1)
        for k in range(len(WIDTHS) - 2, -1, -1):
            width = F.when(n * (WIDTHS[k] - SLACK) >= 2, k).otherwise(width)

        def at(sign: int) -> Column:
            all_ = F.when(n > 0, F.kll_sketch_get_quantile_double(f"_s{i}", ends(sign)))
            return F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda j: F.get(all_, j * len(WIDTHS) + width))

        return F.struct(n.alias("n"), at(-1).alias("lo"), at(1).alias("hi"))

    return wide.select(*g, F.array(*[bracket(i) for i in range(len(cols))]).alias("_b"))


def grouped_quantiles(df: DataFrame, group: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(*group, _var, _q)``: per group and column the quantiles of its non-missing values."""
    g, k = list(group), [*group, "_var"]
    wanted, probs = [float(p) for p in probs], sorted({float(p) for p in probs})
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    values = df.select(*g, *[number(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    names = [f"_v{i}" for i in range(len(cols))]
    b = _brackets(values, g, names, probs)
    if g:
        met = join_null_safe(values, b, g)
    else:
        met = values.withColumn("_b", b.scalar())
    cells = met.select(*g, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_var"), F.col(v).alias("_v"), F.get("_b", F.lit(i)).alias("_b"))
        for i, (c, v) in enumerate(zip(cols, names))]))).filter(F.col("_v").isNotNull())
    lo, hi = (lambda j: F.get("_b.lo", F.lit(j))), (lambda j: F.get("_b.hi", F.lit(j)))
    inside, below = F.lit(False), F.lit(0)
    for j in range(len(probs)):
        inside = inside | F.col("_v").between(lo(j), hi(j))
        below = below + (F.col("_v") > hi(j)).cast("int")
    cells = cells.withColumns({"_in": inside, "_k": below}).filter(F.col("_in") | (F.col("_k") < len(probs)))
    # rows between two brackets count together, at the end of the lower one
    x = (F.when(F.col("_in"), F.col("_v")).when(F.col("_k") == 0, F.lit(float("-inf")))
         .otherwise(F.get("_b.hi", F.col("_k") - 1)))
    counts = cells.groupBy(*k, x.alias("_x"), (~F.col("_in")).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_b.n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*k).orderBy("_x", "_gap"))
    value = F.when(F.col("_gap"), F.raise_error(F.lit("a quantile lies outside its sketch's bracket")).cast("double")).otherwise(F.col("_x"))
    at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), value))
    found = counts.withColumn("_upto", upto).groupBy(*k).agg(
        F.max("_n").alias("_n"), F.array(*[at(r) for r in _ranks(F.col("_n"), probs)]).alias("_at"))
    parts = []
    for i, p in enumerate(probs):
        pos, low, high = (F.col("_n") - 1) * F.lit(p), F.get("_at", F.lit(2 * i)), F.get("_at", F.lit(2 * i + 1))
        parts.append(low + (high - low) * (pos - F.floor(pos)))
    return found.select(*k, F.array(*[parts[probs.index(p)] for p in wanted]).alias("_q"))


def grouped_medians(df: DataFrame, group: Sequence[str], cols: Sequence[str], out_prefix: str = "") -> DataFrame:
    """Exact median of each column per group, one row per group with a value (``out_prefix + col``)."""
    q = grouped_quantiles(df, group, cols, [0.5])
    return q.groupBy(*group).agg(*[
        F.max(F.when(F.col("_var") == c, F.get("_q", F.lit(0)))).alias(out_prefix + c) for c in cols])


def median_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    """Scalar subquery: a struct of the exact medians of whole columns (NULL where there is no value)."""
    q = grouped_quantiles(df, [], cols, [0.5])
    return q.agg(F.struct(*[F.max(F.when(F.col("_var") == c, F.get("_q", F.lit(0)))).alias(c) for c in cols])).scalar()


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(_var, _q)``: quantiles of whole columns."""
    return grouped_quantiles(df, [], cols, probs)


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns as Python floats (one row per column is read)."""
    got = {r["_var"]: list(r["_q"]) for r in quantile_table(df, cols, probs).collect()}
    return {c: got.get(c, [None] * len(probs)) for c in cols}
