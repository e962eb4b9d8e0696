"""Session helpers: staging of intermediate tables and input parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: what ``spark.checkpoint.dir`` names.

    Only a local master may do without the setting; it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="maskwright-")
    return _LOCAL_DIRS[context.applicationId]


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_maskwright_code", None) == context.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    where = os.path.join(tempfile.mkdtemp(prefix="code-"), "maskwright_code.zip")
    with zipfile.ZipFile(where, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(where)
    context._maskwright_code = context.applicationId


# Paths of staged tables, by the owners that are open now (the last one owns).
_OWNERS: list[list[tuple[SparkSession, str]]] = []


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    system, where = _at(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


@contextmanager
def staged_tables() -> Iterator[None]:
    """Tables that are staged inside are deleted on leaving; write what is to stay before that.

    Staged tables hold texts and values in clear. Those of no owner stay until the application ends, as results that are
    not computed yet may read them.
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        for spark, path in _OWNERS.pop():
            delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Cuts the lineage at a durable table (a lost executor does not bring back
    the regex work) and gives the optimizer real sizes for join decisions. The table is deleted by its owner (see
    ``staged_tables``) or at the end of the application.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append((spark, path))
    df.write.parquet(path)
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_files(spark: SparkSession, cost: int = 16 * 1024) -> Iterator[None]:
    """What is read inside counts a file's opening as so many bytes.

    Spark takes opening a file for 4 MB, so that a task reads 32 small files, and as many tasks as there are files / 32 pass
    the driver. Files are read when results are written, so that belongs inside too.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(cost))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Rows for a task whose work is by the row, not by the byte.
ROWS_A_TASK = 20_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: no task gets larger as the input grows, and few rows still meet all cores."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal small rows with much work each over tasks by their number.

    Splits of files and shuffle partitions are measured in bytes, which says nothing of the work on a row: a partition of
    64 MB holds millions of orders. ``rows`` is how many there are, about.
    """
    return df.repartition(tasks_for(df.sparkSession, rows), *[F.col(k) for k in keys])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give an input with fewer splits than cores one shuffle by ``key``.

    Small inputs arrive as one or two splits and would keep the cores idle
    during the regex work; an input with enough splits is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df if splits >= wanted else df.repartition(4 * wanted, F.col(key))
