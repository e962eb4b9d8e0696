"""Document streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.strategies import Strategy
from maskwright.operators import mapping as maps
from maskwright.operators.detect import Profile
from maskwright.operators.joins import lookup
from maskwright.operators.rewrite import kept_spans, prepare, replace_spans, sanitise
from maskwright.session import delete, exists, list_folder, stage


def sanitise_stream(docs: DataFrame, strategy: str | Strategy = "redact", profile: Profile = "patterns", **options) -> DataFrame:
    """Stateless strategies on a stream: one row in, one row out, no state."""
    return sanitise(docs, strategy, profile, **options)


class MappingLog:
    """A carried mapping in a folder, as a log of what each batch changed.

    ``delta/batch=N`` holds the rows that batch N added or changed, ``tops/batch=N`` the highest number of each category
    after it, ``snapshot/batch=N`` the whole mapping after it. Rows lie in folders by the hash of their key, so a batch
    reads only the folders of its own keys, writes only its own rows, and numbers from the tops. Every
    ``compact_every`` batches the log becomes a snapshot, and what lies before the snapshot before is deleted.

    A batch depends on the batches before it alone, so running it again after a failure overwrites the same rows with
    the same numbers; for that the snapshot before the last one and the changes after it stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, compact_every: int = 16):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.compact_every = compact_every

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _batches(self, kind: str, last: int) -> list[int]:
        """The complete batches of a kind up to ``last``, in order."""
        folders = list_folder(self.spark, f"{self.path}/{kind}")
        numbers = sorted(int(f.partition("=")[2]) for f in folders if f.startswith("batch="))
        return [n for n in numbers if n <= last and exists(self.spark, f"{self.path}/{kind}/batch={n}/_SUCCESS")]

    def _rows(self, kind: str, batch: int) -> DataFrame:
        schema = maps.SCHEMA + ", bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/batch={batch}").withColumn("_batch", F.lit(batch))

    def _write(self, kind: str, batch: int, rows: DataFrame) -> None:
        bucketed = rows.withColumn("bucket", self._bucket("norm"))
        bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={batch}")

    def read(self, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """The mapping after ``batch`` (empty before the first one); of some buckets, or all."""
        snapshots = self._batches("snapshot", batch)
        parts = [self._rows("snapshot", snapshots[-1])] if snapshots else []
        parts += [self._rows("delta", n) for n in self._batches("delta", batch) if not snapshots or n > snapshots[-1]]
        if not parts:
            return self.spark.createDataFrame([], maps.SCHEMA)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if len(parts) > 1:
            latest = F.max_by(F.struct(*maps.COLUMNS), "_batch").alias("row")
            rows = rows.groupBy("placeholder").agg(latest).select("row.*")
        return rows.select(*maps.COLUMNS)

    def tops(self, batch: int) -> DataFrame:
        """Highest number of each category after ``batch``."""
        found = self._batches("tops", batch)
        if not found:
            return self.spark.createDataFrame([], "category string, top int")
        return self.spark.read.schema("category string, top int").parquet(f"{self.path}/tops/batch={found[-1]}")

    def extend(self, batch: int, spans: DataFrame) -> DataFrame:
        """Log what the batch's spans change; returns the rows of all their keys after it."""
        found = stage(maps.entities(spans), "entities")
        touched = [r.b for r in found.select(self._bucket("norm").alias("b")).distinct().collect()]  # as many as buckets at most
        known = self.read(batch - 1, touched).join(found.select("norm"), "norm", "left_semi")
        known = stage(known.select(*maps.COLUMNS), "known")
        tops = self.tops(batch - 1)
        self._write("delta", batch, maps.extension(known, found, tops))
        delta = self._rows("delta", batch)
        after = tops.unionByName(maps.highest(delta)).groupBy("category").agg(F.max("top").alias("top"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tops/batch={batch}")  # one row a category
        if self.compact_every and batch % self.compact_every == self.compact_every - 1:
            self.compact(batch)
        return delta.select(*maps.COLUMNS)

    def compact(self, batch: int) -> None:
        """Write the mapping after ``batch`` as a snapshot, and delete what lies before the snapshot before."""
        self._write("snapshot", batch, self.read(batch))
        snapshots = self._batches("snapshot", batch)
        if len(snapshots) < 2:
            return
        kept = snapshots[-2]
        for kind, first in (("snapshot", kept), ("delta", kept + 1), ("tops", kept)):
            for old in self._batches(kind, first - 1):
                delete(self.spark, f"{self.path}/{kind}/batch={old}")


def encode_batch(log: MappingLog, output: str, profile: Profile = "patterns"):
    """``foreachBatch`` function: extend the carried mapping by a batch, and write the batch's sanitised texts next to the
    other batches. What it reads and writes of the mapping goes with the batch's own values."""

    def run(docs: DataFrame, batch: int) -> None:
        prepared = prepare(docs)
        spans = stage(kept_spans(prepared, profile), "spans")
        keyed = log.extend(batch, spans).where(F.col("norm").isNotNull()).select("norm", F.col("placeholder").alias("value"))
        done = replace_spans(prepared, lookup(spans, keyed, ["norm"]))
        done.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={batch}")

    return run


def encode_stream(docs: DataFrame, log_path: str, output: str, checkpoint: str, profile: Profile = "patterns",
                  trigger: dict | None = None, compact_every: int = 16):
    """Start a query that sanitises a stream with one mapping for all of it.

    ``trigger`` holds the arguments of DataStreamWriter.trigger(); by default
    the query takes what is there and ends.
    """
    log = MappingLog(docs.sparkSession, log_path, compact_every=compact_every)
    return (
        docs.writeStream.foreachBatch(encode_batch(log, output, profile))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
