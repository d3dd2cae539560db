"""Session construction and cluster-safe settings."""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# what the results depend on: forced on every session
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
# how plans are run: only for sessions built here, a cluster's own configuration stays
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, app: str = "cohortlab",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package's required settings.

    ``master`` is only set when given (local tests); on a cluster the launcher
    decides.  The UI stays off: no port beyond Spark's own RPC is opened.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEMORY", "8g"))
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in (DEFAULT_CONF | REQUIRED_CONF).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Force the semantic settings (time zone, ANSI) on an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the plans that are run inside; ``a__b`` stands for ``spark.sql.a.b``."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is local (tests) a private
    scratch folder is created; on a cluster a missing setting is an error, because
    executors could not see each other's files.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises
            d = None
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="cohortlab-ckpt-", dir=os.environ.get("COHORTLAB_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    d = checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_RUN_ID = uuid.uuid4().hex[:12]
_SEQ = itertools.count()
_TABLES: list[str] = []


def clean_outputs(spark: SparkSession) -> None:
    """Delete what ``materialize``, ``materialize_bucketed`` and the scratch outputs of this process wrote."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/cohortlab-{_RUN_ID}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this run's part of the shared folder; ``clean_outputs`` deletes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortlab-{_RUN_ID}/{next(_SEQ):05d}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage between stages (a lost executor never forces a recompute of
    the upstream joins) and keeps later plans small; the read-back scan gets
    Parquet statistics, pushdown and pruning.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, bucketed by ``keys``: aggregates and joins on them need no exchange.

    One file per bucket, as many buckets as shuffle partitions unless a number is given;
    the table is external, its files lie in the shared folder.  Rows are not sorted: scans
    of buckets don't tell an order, so the sort would be done again by whoever needs it.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"cohortlab_{_RUN_ID}_{path.rsplit('/', 1)[1].replace('-', '_')}"
    _TABLES.append(table)
    # a task has one bucket: with a writer kept open per bucket its rows need no sort by the bucket's number
    with settings(spark, maxConcurrentOutputFileWriters="8"):
        (df.repartition(n, *keys).write.bucketBy(n, *keys)
           .format("parquet").option("path", path).saveAsTable(table))
    return spark.table(table)
