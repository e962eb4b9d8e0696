"""Joins that stay balanced when single keys or documents are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Left join with a table that has one row per key.

    A key is hot if it holds more rows than a shuffle partition on average (or than ``hot_rows``), so there are fewer hot
    keys than partitions. ``left`` is read several times, so it should be a table.
    They are counted (aggregated before the shuffle), and their rows of ``right``, as few, are broadcast; all other keys
    go through the ordinary join. Both parts together are the whole input, at any size.
    """
    spark = left.sparkSession
    share = hot_rows or left.count() / int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = left.groupBy(*keys).count().where(F.col("count") > share).select(*keys).collect()  # fewer than partitions
    if not hot:
        return left.join(right, keys, "left")
    hot_keys = F.broadcast(spark.createDataFrame(hot, left.select(*keys).schema))
    hot_right = F.broadcast(right.join(hot_keys, keys, "left_semi"))
    spread_out = left.join(hot_keys, keys, "left_semi").join(hot_right, keys, "left")
    return spread_out.unionByName(left.join(hot_keys, keys, "left_anti").join(right, keys, "left"))


def _in_blocks(spans: DataFrame, size: int) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return spans.withColumn("block", F.explode(F.sequence(F.expr(f"start div {size}"), F.floor(last / size).cast("bigint"))))


def without_overlaps(spans: DataFrame, others: DataFrame, doc: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """Interval anti-join: the spans that intersect none of ``others``.

    Both sides are cut into blocks of text positions, so the join key is
    (document, block) and a long document spreads over many tasks.
    """
    probe = _in_blocks(spans.select(doc, "start", "end").distinct(), size)
    build = _in_blocks(
        others.select(F.col(doc), F.col("start"), F.col("end")).distinct(), size
    ).select(F.col(doc).alias("o_doc"), F.col("block").alias("o_block"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    touched = probe.join(
        build,
        (F.col(doc) == F.col("o_doc")) & (F.col("block") == F.col("o_block"))
        & (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start")),
        "left_semi",
    ).select(doc, "start", "end").distinct()
    return spans.join(touched, [doc, "start", "end"], "left_anti")


def attach(docs: DataFrame, parts: DataFrame, doc: str, name: str, items: Column) -> DataFrame:
    """Collect a document's parts in an array and put it next to its text.

    Only the parts are grouped; the text moves once, for the join by document.
    """
    per_doc = parts.groupBy(doc).agg(F.array_sort(F.collect_list(items)).alias(name))
    return docs.join(per_doc, doc, "left")
