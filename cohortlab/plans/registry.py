"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle each.

Every query reads the driver's tables (through the fixture mapping) in full.
Spark outputs pass through ``finalize``: doubles rounded to 6 places and
timestamps made zone-less, exactly as the oracle SQL does on its side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.plans import oracle
from cohortlab.plans.study import Study
from cohortlab.session import apply_conf, ensure_checkpoint_dir


@dataclass
class Query:
    name: str
    build: Callable[[Study], DataFrame]
    sql: str | None = None            # body; CTEs are added automatically
    doubles: list[str] = field(default_factory=list)
    ops: str = ""                     # inventory ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | None = None, ops: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, list(doubles or []), ops)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # "+ 0.0" folds a negative zero into 0.0 (same on the oracle side)
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_SHARED: dict[tuple[int, str], Study] = {}


def share_study(study: Study) -> None:
    """Make later query calls on the same (session, directory) reuse ``study``'s
    materialized stages (a pipeline run followed by report queries)."""
    _SHARED[(id(study.spark), study.sf_dir)] = study


def _study_cache(spark: SparkSession, sf_dir: str) -> Study:
    return _SHARED.get((id(spark), sf_dir)) or Study(spark, sf_dir)


def spark_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_conf(spark)
        ensure_checkpoint_dir(spark)
        return finalize(q.build(_study_cache(spark, sf_dir)))
    run.__name__ = f"q_{name}"
    return run


def sql_for(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    return oracle.with_ctes(oracle.rounded(q.sql, q.doubles))


# importing the query modules fills REGISTRY
from cohortlab.plans import (queries_eval, queries_features, queries_models, queries_more,  # noqa: E402,F401
                             queries_prep)
