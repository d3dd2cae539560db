"""Typed CSV scans bound by header name, and CSV report sinks.

Spark's CSV reader with a user schema binds columns by *position*; here every
column is read as a string by header name, the null tokens are mapped to
NULL, and only then are the needed columns selected and cast.  Column pruning
still reaches the scan (only selected columns are parsed).
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.functions.scalar import parse_timestamp_mixed
from cohortlab.session import materialize
from cohortlab.sources.csv_records import file_sizes, split_records

# logical schemas (column -> type), see the study's loaders
COMMITS = {"PROJECT_ID": "string", "COMMIT_HASH": "string", "AUTHOR_DATE": "timestamp",
           "IN_MAIN_BRANCH": "boolean", "MERGE": "boolean"}
CHANGES = {"PROJECT_ID": "string", "COMMIT_HASH": "string", "LINES_ADDED": "bigint", "LINES_REMOVED": "bigint"}
SZZ = {"PROJECT_ID": "string", "FAULT_FIXING_COMMIT_HASH": "string", "FAULT_INDUCING_COMMIT_HASH": "string"}
REFACTORING = {"PROJECT_ID": "string", "COMMIT_HASH": "string", "REFACTORING_TYPE": "string"}
SONAR_ANALYSIS = {"PROJECT_ID": "string", "ANALYSIS_KEY": "string", "DATE": "timestamp", "REVISION": "string"}
SONAR_MEASURES = {"PROJECT_ID": "string", "ANALYSIS_KEY": "string", **{m: "double" for m in config.TD_FEATURES}}
SCHEMAS = {"commits": COMMITS, "changes": CHANGES, "szz": SZZ, "refactoring": REFACTORING,
           "sonar_analysis": SONAR_ANALYSIS, "sonar_measures": SONAR_MEASURES}


def _nullify(c: Column) -> Column:
    return F.when(F.trim(c).isin(*config.NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def _typed(c: Column, dtype: str) -> Column:
    """The value, or NULL where the text is NULL or not of the type."""
    c = _nullify(c)
    if dtype == "timestamp":
        return parse_timestamp_mixed(c)
    if dtype == "boolean":
        t = F.lower(F.trim(c))
        return (F.when(t.isin("true", "t", "1", "yes"), F.lit(True))
                 .when(t.isin("false", "f", "0", "no"), F.lit(False))
                 .otherwise(F.lit(None).cast("boolean")))
    if dtype in ("bigint", "int"):
        # '12.0' style integers are accepted, fractions are not
        whole = c.try_cast("double")
        return F.coalesce(c.try_cast(dtype), F.when(whole == F.floor(whole), whole.try_cast(dtype)))
    if dtype == "double":
        return c.try_cast("double")
    return c


_FORMAT = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def _strings(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    """Every column as text, named by the header.

    Files that fit one byte range are read whole, a task each, as Spark does with quoted
    line breaks; if any file is larger, all are read range by range (``csv_records``).
    """
    df = spark.read.options(**_FORMAT).option("header", True).csv(path)
    limit = split_bytes or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if (file_sizes(spark, path).agg(F.max("length")).first()[0] or 0) <= limit:
        return df
    row = F.from_csv("record", F.lit(", ".join(f"`{c.replace('`', '``')}` STRING" for c in df.columns)), _FORMAT)
    return split_records(spark, path, split_bytes).select(row.alias("r")).select(
        *[F.col("r").getField(c).alias(c) for c in df.columns])


def _typed_columns(df: DataFrame, path: str, schema: Mapping[str, str], columns: Sequence[str] | None):
    want = list(columns or schema.keys())
    missing = [c for c in want if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    typed = {c: _typed(F.col(f"`{c}`"), schema[c]) for c in want}
    bad = {c: _nullify(F.col(f"`{c}`")).isNotNull() & t.isNull() for c, t in typed.items() if schema[c] != "string"}
    return typed, bad


def read_csv_checked(spark: SparkSession, path: str, schema: Mapping[str, str], columns: Sequence[str] | None = None,
                     split_bytes: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``(good rows, quarantine, bad values per column)`` of one scan.

    The typed rows are written to the shared folder in one pass; rows with text that is
    not of its column's type are set aside there, as text, and counted from there.
    """
    df = _strings(spark, path, split_bytes)
    typed, bad = _typed_columns(df, path, schema, columns)
    wrong = F.filter(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()]).cast("array<string>"), lambda c: c.isNotNull())
    raw = F.struct(wrong.alias("columns"), F.struct(*[F.col(f"`{c}`").alias(c) for c in typed]).alias("row"))
    # the list of bad columns is made for bad rows only
    any_bad = reduce(or_, bad.values(), F.lit(False))
    rows = materialize(df.select(*[t.alias(c) for c, t in typed.items()], F.when(any_bad, raw).alias("_raw")), "csv-typed")
    aside = rows.filter(F.col("_raw").isNotNull())
    # counted on the written rows that were set aside: an observed metric would leave the session with a part that
    # Spark ML's model summaries can't serialise
    counts = aside.agg(*[F.count_if(F.array_contains("_raw.columns", c)).alias(c) for c in bad]).first().asDict() if bad else {}
    return rows.filter(F.col("_raw").isNull()).drop("_raw"), aside.select("_raw.row.*"), counts


def read_csv(spark: SparkSession, path: str, schema: Mapping[str, str] | None = None,
             columns: Sequence[str] | None = None, infer: bool = False, on_bad: str = "raise",
             split_bytes: int | None = None) -> DataFrame:
    """Headered CSV -> typed DataFrame, binding by header name.

    ``schema`` maps the wanted columns to types; ``infer=True`` reads every
    column with type inference (the fully inferred project list, A3).  Quoted
    fields may hold line breaks; files larger than a byte range (``split_bytes``, the
    session's unless given) are still read by several tasks.

    Text that is not NULL and not of its column's type is bad (``12.7`` in an
    integer column, an impossible date).  ``on_bad='raise'`` reads strictly, in one scan
    (``read_csv_checked``), and raises with the counts and the quarantine's place;
    ``'drop'`` leaves out rows with any; ``'null'`` reads it as NULL.
    """
    if on_bad not in ("raise", "drop", "null"):
        raise ValueError("on_bad must be 'raise', 'drop' or 'null'")
    if infer:
        return (spark.read.options(**_FORMAT).option("header", True).option("inferSchema", True)
                .option("nullValue", "").csv(path))
    if schema is None:
        return _strings(spark, path, split_bytes)
    if on_bad == "raise" and any(schema[c] != "string" for c in columns or schema):
        good, quarantine, counts = read_csv_checked(spark, path, schema, columns, split_bytes)
        if any(counts.values()):
            raise ValueError(f"{path}: unparseable values: {({c: k for c, k in counts.items() if k})}; "
                             f"rows with a _raw value in {os.path.dirname(quarantine.inputFiles()[0])}")
        return good
    df = _strings(spark, path, split_bytes)
    typed, bad = _typed_columns(df, path, schema, columns)
    if on_bad == "drop":
        for b in bad.values():
            df = df.filter(~b)
    return df.select(*[t.alias(c) for c, t in typed.items()])


def read_study_csvs(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """The seven raw study inputs from CSV exports (keys as in ``SCHEMAS`` plus ``projects``)."""
    out = {}
    for name, p in paths.items():
        out[name] = read_csv(spark, p, infer=True) if name == "projects" else read_csv(spark, p, SCHEMAS[name])
    return out


def write_csv_report(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Headered CSV sink for report tables (A11); tiny reports are coalesced to one file."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
