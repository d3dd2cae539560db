"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage)."""
    return materialize(df, f"llm-{name}")


def word_array(text: Column) -> Column:
    """Words (runs of non-space characters) of a text; NULL and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def row_key(*values: Column) -> Column:
    """64-bit hash of what a verdict follows from; tells apart rows that share an id or have none."""
    return F.xxhash64(*[F.struct(v.isNull().alias("none"), v.alias("value")) for v in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of longs, as ``(node, root)``.

    Alternating large-star / small-star rounds: every node is hung under the
    smallest node it knows, first from the larger side, then from the smaller one.
    Each round is two joins-free aggregations (``min`` per node, combined before
    the shuffle) and two joins; its result is a written table in the shared
    folder, so a lost executor costs one round.  ``root`` is the smallest node of
    the component.  Only nodes with an edge appear.  Raises if the fixed point is
    not reached (the number of rounds grows with log² of the largest component).
    """
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
              .filter("a <> b").distinct(), "edges")
    for k in range(max_rounds):
        # large star: each node's larger neighbours go under its smallest neighbour
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
                 .filter("a <> b").distinct())
        large = stage(large, f"large{k}")
        # small star: each node's smaller neighbours (and itself) go under the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = (joined.select(F.col("m").alias("a"), F.col("b"))
                 .union(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct())
        small = stage(small, f"small{k}")
        # a star forest has each node once as a child, and no child as a parent
        n, kids = small.agg(F.count("b"), F.count_distinct("b")).first()
        if n == kids and small.select(F.col("a").alias("b")).join(small.select("b"), "b", "left_semi").isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        e = small
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def slices(texts: list | pa.Array, max_chars: int = 1 << 20):
    """Consecutive ``(lo, hi)`` ranges of a batch holding about ``max_chars`` characters (Arrow: bytes) each.

    A Python worker then holds the words of about one megabyte of text at a time,
    or those of one longer document.
    """
    if isinstance(texts, pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    else:
        sizes = [len(t) if t is not None else 0 for t in texts]
    lo = used = 0
    for i, size in enumerate(sizes):
        used += size
        if used >= max_chars:
            yield lo, i + 1
            lo, used = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def release_memory() -> None:
    """Give a Python worker's freed memory back: it idles beside the JVM until the next Python stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
