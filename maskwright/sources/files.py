"""Text files and mapping files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import lit, u
from maskwright.operators import mapping as maps
from maskwright.session import small_files, spread, stage
from maskwright.sources import textfiles

_STEM = u(r"([^/]*?)(\.[^./]*)?$")


def read_documents(spark: SparkSession, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of a Parquet table, with only the columns that are needed."""
    rows = spark.read.parquet(path).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return spread(rows, "doc_id")


def read_texts(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """One row per file: doc_id (rank of the path, from 1), path, text.

    Ranks are made of the paths alone, by range partitions; the contents are read once, joined to them and staged. Names
    that start with ``_`` or ``.`` are no documents, nor are files of no bytes, which Spark's readers skip.
    """
    with small_files(spark):
        found = spark.read.format("binaryFile").load(path)
        paths = stage(
            found.select("path").repartitionByRange("path").sortWithinPartitions("path")
            .withColumn("_at", F.monotonically_increasing_id()), "paths")
        placed = paths.withColumn("_part", F.shiftright("_at", 33))
        starts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        # one row a partition
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
        ranks = placed.join(starts, "_part").select("path", (F.col("_base") + F.col("_at") - F.col("_first") + 1).alias("doc_id"))
        texts = found.select("path", F.decode("content", encoding).alias("text"))
        return stage(texts.join(ranks, "path").select("doc_id", "path", "text"), "texts")


def write_text_files(texts: DataFrame, path: str, name: str = "name", text: str = "text", encoding: str = "utf-8",
                     mode: str = "append") -> None:
    """Each row's text as a file of its own, with the row's name."""
    textfiles.register(texts.sparkSession)
    texts.select(F.col(name).alias("name"), F.col(text).alias("text")).write.format(textfiles.FORMAT).option(
        "encoding", encoding).mode(mode).save(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path and size in MB of every file, without reading the contents."""
    return spark.read.format("binaryFile").load(path).select(
        "path", (F.col("length") / F.lit(1024 * 1024)).alias("size_mb"))


def output_names(files: DataFrame) -> DataFrame:
    """Default names of the sanitised text, mapping and decoded text."""
    stem = F.expr(f"regexp_extract(path, {lit(_STEM)}, 1)")
    suffix = F.expr(f"regexp_extract(path, {lit(_STEM)}, 2)")
    return files.withColumns({
        "sanitized_name": F.concat(stem, F.lit("_sanitized"), suffix),
        "mapping_name": F.concat(stem, F.lit("_mapping.json")),
        "decoded_name": F.concat(stem, F.lit("_decoded"), suffix),
    })


def write_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sanitised texts as Parquet (doc_id, name and text)."""
    texts.write.mode(mode).parquet(path)


def write_mapping(mapping: DataFrame, path: str, mode: str = "errorifexists") -> None:
    mapping.write.mode(mode).parquet(path)


def write_mapping_json(mapping: DataFrame, path: str, created: str, mode: str = "errorifexists") -> None:
    """A mapping as JSON lines in as many files as it has partitions: one line
    per placeholder below ``entries``, one per scope below ``headers``."""
    maps.entries(mapping).write.mode(mode).json(f"{path}/entries")
    maps.headers(mapping, created).write.mode(mode).json(f"{path}/headers")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(maps.SCHEMA).parquet(path)


def read_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    return maps.from_entries(spark.read.schema(maps.ENTRY_SCHEMA).json(f"{path}/entries"))


def read_mapping_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(maps.HEADER_SCHEMA).json(f"{path}/headers")
