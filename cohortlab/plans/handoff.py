"""Stage outputs that name what they were made from and become visible whole.

A stage's output is a folder with one subfolder per version and a manifest, ``_CURRENT.json``.
A version's files are written first; then the manifest, which holds the version's name, the
fingerprint of the stage's inputs and the size of every file, replaces the old one in one
rename.  So a reader sees the last whole output or none: files of a run that died are never
read, and an output whose files are missing or cut short is refused.

The fingerprint covers what a stage is computed from: the names, sizes and times of its
input files (or the versions of the stages it reads) and its parameters.  A stage asked for
again with the same fingerprint is read; with another it is stale and is made anew.

Tables are range-clustered: files and row groups hold neighbouring keys, so that a filter on
the leading column reads the files (and row groups) whose statistics hold it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_CURRENT.json"


class BrokenStage(RuntimeError):
    """A stage's manifest and its files don't agree."""


class MissingStage(RuntimeError):
    """A stage was never completed here."""


@dataclass
class Version:
    name: str
    fingerprint: str
    files: dict[str, int]      # name in the version's folder -> bytes


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Data files of a folder or file: name, bytes, time of change."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if s.isFile()]
    return sorted(f for f in found if not f[0].startswith(("_", ".")))


def fingerprint(spark: SparkSession, *inputs: str | DataFrame, **params) -> str:
    """Hash of the files of ``inputs`` (paths, or tables by the files they read) and of ``params``."""
    parts = []
    for x in inputs:
        paths = [x] if isinstance(x, str) else sorted(x.inputFiles())
        parts.append([(p, _listing(spark, p)) for p in paths])
    return hashlib.sha256(json.dumps([parts, sorted(params.items())], default=str).encode()).hexdigest()


def current(spark: SparkSession, path: str) -> Version | None:
    """The completed version at ``path``, checked against its files; ``None`` if there is none."""
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        version = Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    except (Py4JJavaError, TypeError, ValueError) as e:
        raise BrokenStage(f"{path}: unreadable manifest") from e
    finally:
        stream.close()
    there = {name: size for name, size, _ in _listing(spark, f"{path}/{version.name}")}
    if there != version.files:
        raise BrokenStage(f"{path}: files of {version.name} differ from the manifest")
    return version


def read(spark: SparkSession, path: str) -> DataFrame:
    """The completed output at ``path``."""
    version = current(spark, path)
    if version is None:
        raise MissingStage(f"{path}: no completed output")
    return spark.read.parquet(f"{path}/{version.name}")


def version_of(spark: SparkSession, path: str) -> str:
    version = current(spark, path)
    if version is None:
        raise MissingStage(f"{path}: no completed output")
    return version.name


def write(df: DataFrame, path: str, made_from: str, cluster: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a new version, make it current in one rename, drop the old one; returns the output."""
    spark = df.sparkSession
    if cluster:
        df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    name = f"v-{made_from[:12]}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    version = Version(name, made_from, {n: size for n, size, _ in _listing(spark, f"{path}/{name}")})
    fs, old = _fs(spark, path)
    before = [s.getPath() for s in fs.listStatus(old) if s.isDirectory() and s.getPath().getName() != name]
    _replace(spark, f"{path}/{MANIFEST}", json.dumps(asdict(version)))
    for p in before:
        fs.delete(p, True)
    return read(spark, path)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path``, then rename it over."""
    fs, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(tmp, jvm.org.apache.hadoop.fs.Path(path), options)


def reuse(spark: SparkSession, path: str, made_from: str, build: Callable[[], DataFrame], cluster: Sequence[str] = ()) -> DataFrame:
    """The output at ``path`` if it was made from the same inputs, else ``build()`` written there.

    A broken output counts as none.
    """
    try:
        version = current(spark, path)
    except BrokenStage:
        version = None
    if version is not None and version.fingerprint == made_from:
        return spark.read.parquet(f"{path}/{version.name}")
    return write(build(), path, made_from, cluster)
