"""Records of large CSV files whose quoted fields may hold line breaks, read by many tasks.

A CSV file can be cut at any line break that lies outside quotes, but whether one does
depends on all quotes before it.  The files are read as lines, in Spark's own byte ranges:

1. per range, count the lines with an odd number of quotes (each turns "outside" into
   "inside" and back);
2. a prefix sum over the ranges of a file tells on which side each range starts, and which
   earlier range holds the start of the record that is open there;
3. each task follows its ranges from the true side: lines between two odd lines are joined
   to one record, all others are records as they stand.  A record that crosses a range's
   border comes out in pieces, at most two a range, which are put together by key.

Doubled quotes inside a field count twice, so they change nothing.  A quote inside an
unquoted field is not CSV and would open a field here.  Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: ranges told to every task by broadcast (some 100 bytes each); more are joined by a shuffle
BROADCAST_RANGES = 500_000
#: bytes of ranges for one task, where there are more than a few tasks per core
TASK_BYTES = 64 << 20


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Size of each file, from the listing alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


class _Settings:
    """Read settings that hold while ranges are cut, so that both passes see the same ranges."""

    def __init__(self, spark: SparkSession, split_bytes: int | None, total: int | None = None):
        self.spark, self.old = spark, {}
        cores = spark.sparkContext.defaultParallelism
        self.new = {"spark.sql.files.minPartitionNum": str(cores)}
        if total is not None:   # a task takes many short ranges, so their number doesn't make that of the tasks
            self.new["spark.sql.files.maxPartitionNum"] = str(max(4 * cores, total // TASK_BYTES))
        if split_bytes:
            self.new["spark.sql.files.maxPartitionBytes"] = str(split_bytes)

    def __enter__(self):
        for k, v in self.new.items():
            self.old[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def split_records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``(record)``: every record below the header of each file, quotes and inner line breaks as they stand; written.

    ``split_bytes``: size of a byte range, the session's unless given.
    """
    total = file_sizes(spark, path).agg(F.sum("length")).first()[0] or 0
    with _Settings(spark, split_bytes, total):
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
        lines = lines.withColumn("_odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
        ranges = materialize(lines.groupBy("_file", "_block").agg(F.count_if("_odd").alias("_turns")), "csv-ranges")
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        known = ranges.withColumn("_inside", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)) % 2 == 1)
        # a range without a turn hands an open record on; any other that ends inside holds its start
        holds = ((F.col("_inside").cast("int") + F.col("_turns")) % 2 == 1) & (F.col("_turns") > 0)
        known = known.select("_file", "_block", F.when(F.col("_inside"), F.last(
            F.when(holds, F.col("_block")), ignorenulls=True).over(earlier)).alias("_owner"), F.lit(True).alias("_known"))
        if ranges.count() <= BROADCAST_RANGES:
            told = lines.join(F.broadcast(known), ["_file", "_block"], "left")
        else:
            told = (lines.withColumn("_at", F.monotonically_increasing_id()).join(known, ["_file", "_block"], "left")
                    .repartition("_file", "_block")   # a split skewed range comes together again
                    .sortWithinPartitions("_file", "_block", "_at").drop("_at"))
        told = told.withColumn("_known", F.coalesce("_known", F.raise_error(F.lit("byte ranges changed between two reads")).cast("boolean")))
        pieces = materialize(told.mapInArrow(_follow, "record string, _file string, _key long, _order long"), "csv-records")
    joined = (pieces.filter(F.col("_key").isNotNull()).groupBy("_file", "_key")
              .agg(F.array_sort(F.collect_list(F.struct("_order", "record"))).alias("p"))
              .select(F.array_join(F.col("p.record"), "\n").alias("record")))
    whole = pieces.filter(F.col("_key").isNull()).select("record").unionByName(joined.select("record"))
    whole = whole.select(F.regexp_replace("record", "\r$", "").alias("record"))
    return whole.filter(F.length("record") > 0)


def _follow(batches):
    """Lines in file order, with their range and the open record's key, to records and pieces."""
    # range, key of an inherited record, lines of the record that is open, whether the header is still to come
    now, owner, open_, header = None, None, None, False

    def piece(key, order, lines, file):
        return pa.RecordBatch.from_arrays(
            [pa.array(["\n".join(lines)]), pa.array([file]), pa.array([key], pa.int64()), pa.array([order], pa.int64())],
            names=["record", "_file", "_key", "_order"])

    def whole(records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [records, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=["record", "_file", "_key", "_order"])

    def left_open():
        # at a range's end: the record goes on in a later range
        if open_ is not None:
            if header:
                raise ValueError(f"{now[0]}: the header is longer than a byte range")
            yield piece(now[1] if owner is None else owner, now[1], open_, now[0])

    for b in batches:
        files, blocks, value = b.column("_file").to_pylist(), b.column("_block").to_pylist(), b.column("value")
        at = b.column("_block").to_numpy()
        name = b.column("_file").dictionary_encode().indices.to_numpy()
        ends = np.append(np.flatnonzero((at[1:] != at[:-1]) | (name[1:] != name[:-1])) + 1, len(at))   # of runs of one range
        odd = b.column("_odd").to_numpy(zero_copy_only=False)
        owners = b.column("_owner")
        i, n = 0, len(files)
        while i < n:
            if (files[i], blocks[i]) != now:
                yield from left_open()
                now, owner = (files[i], blocks[i]), owners[i].as_py()
                open_, header = ([] if owner is not None else None), blocks[i] == 0
            end = ends[np.searchsorted(ends, i, "right")]
            lines, turn = value.slice(i, end - i), odd[i:end].astype(np.int64)
            after = (np.cumsum(turn) + (open_ is not None)) % 2        # whether each line ends inside quotes
            starts = np.flatnonzero((after + turn) % 2 == 0)           # lines that begin a record
            first = int(starts[0]) if len(starts) else end - i
            if open_ is not None:
                open_ += lines.slice(0, first).to_pylist()
                if first and not after[first - 1]:
                    if owner is not None:
                        yield piece(owner, now[1], open_, now[0])
                    elif not header:
                        yield whole(pa.array(["\n".join(open_)], pa.string()))
                    header, owner, open_ = False, None, None
            if len(starts):
                if after[-1]:
                    open_ = lines.slice(int(starts[-1])).to_pylist()
                bounds = starts if after[-1] else np.append(starts, end - i)
                if header and len(bounds) > 1:
                    bounds, header = bounds[1:], False
                if len(bounds) > 1:
                    yield whole(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines), "\n"))
            i = end
    yield from left_open()
