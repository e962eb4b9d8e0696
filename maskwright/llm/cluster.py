"""What the operators need of the cluster: their code on the executors, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from maskwright.session import ship

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests on one machine) below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="stage-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is computed inside leaves no shuffle files behind.

    By default they stay on the executors' disks until the driver happens to collect garbage, which a driver with little to do
    does not; all shuffles of a run of many steps would be on disk at once.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again; only after what was made of them is a table itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The size that the session is set up for; every degree of parallelism here follows it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(frame: DataFrame, name: str) -> str:
    """A column name like `name` that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name
